"""Exact deduplication against immutable snapshots.

A snapshot holds the distinct digests of stored documents, dealt over buckets by digest, and one static
binary-fuse filter per bucket. An incoming batch is first grouped by digest, which settles the copies inside it.
Its distinct digests are screened by the filters; the few positives join the exact buckets, and texts of
all groups of more than one row are compared byte by byte. Filters, buckets and digests are only ever dealt by
bucket or digest: nothing that grows with the corpus is broadcast or collected.

Copies are combined on the map side, so a text that a third of all rows share costs one row per task, and the rows
of such a text meet their group in several parts. A batch that is larger than the snapshot is screened in several parts a
bucket, each with a copy of the bucket's filter. Snapshots can be kept: ``write_snapshot``, ``read_snapshot``.

Defined cases: null text counts as empty; texts are equal when identical after lower-casing A-Z; the row with the
largest id stays, a null id being smallest; among rows equal in id and text one stays; empty tables give no rows;
texts are hashed whole, however long; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volpanel.llm import fuse_filter
from volpanel.llm.tables import ascii_lower, likely, slot_bitmap, spread_join, stage

KEYS_PER_BUCKET = 20_000
FILTER_SCHEMA = "bucket bigint, seed string, segment int, segments int, prints binary"


@dataclass
class Snapshot:
    """Stored digests (``bucket, key, sha, size, keep``), their filters, and the number of buckets."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, doc_id: str, text: str, *extra: Column) -> DataFrame:
    """Per row: id, a row number that tells equal rows apart, and the SHA-256 of the normalised text."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(normalised(F.col(text)), 256).alias("sha"),
        *extra,
    )


def grouped(rows: DataFrame) -> DataFrame:
    """Copies of one batch: one row per digest, with its size and the row to keep."""
    return rows.groupBy("sha").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "row")).alias("keep")
    )


def _key(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("bigint")


def build_snapshot(rows: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> Snapshot:
    """Immutable snapshot of digest rows: exact buckets and a filter for each."""
    distinct = stage(grouped(rows).withColumn("key", _key(F.col("sha"))), "dedup-stored")
    buckets = max(1, -(-distinct.count() // keys_per_bucket))
    groups = distinct.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("bigint"))

    def make(bucket: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, prints = fuse_filter.build(bucket["key"].to_numpy())
        row = [int(bucket["bucket"].iloc[0]), str(seed), segment, segments, prints]
        return pd.DataFrame([row], columns=["bucket", "seed", "segment", "segments", "prints"])

    filters = groups.select("bucket", "key").groupBy("bucket").applyInPandas(make, FILTER_SCHEMA)
    return Snapshot(groups, stage(filters, "dedup-filters"), buckets)


def write_snapshot(snapshot: Snapshot, path: str) -> None:
    """Keep a snapshot in a new folder. Its number of buckets is written last; without it the folder can't be read."""
    snapshot.groups.write.parquet(f"{path}/groups")
    snapshot.filters.write.parquet(f"{path}/filters")
    snapshot.groups.sparkSession.range(1).select(F.lit(snapshot.buckets).alias("buckets")).write.parquet(f"{path}/buckets")


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    buckets = spark.read.parquet(f"{path}/buckets").first()["buckets"]
    return Snapshot(spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/filters"), buckets)


def screen(batch: DataFrame, snapshot: Snapshot, keys_per_part: int = KEYS_PER_BUCKET) -> DataFrame:
    """Digests of a grouped batch that a filter of the snapshot lets through: sha, bucket.

    Buckets follow the snapshot; a batch of more digests is dealt to parts of its buckets, so that no task holds
    much more than ``keys_per_part`` of them.
    """
    parts = max(1, -(-batch.count() // (snapshot.buckets * keys_per_part)))
    keyed = batch.select(
        "sha", _key(F.col("sha")).alias("key"), F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("bigint").alias("part")
    ).withColumn("bucket", F.pmod("key", F.lit(snapshot.buckets)).cast("bigint"))
    filters = snapshot.filters.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))

    def probe(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if incoming.empty or filters.empty:
            return incoming.loc[[], ["sha", "bucket"]]
        f = filters.iloc[0]
        hit = fuse_filter.contains(incoming["key"].to_numpy(), int(f.seed), int(f.segment), int(f.segments), f.prints)
        return incoming.loc[hit, ["sha", "bucket"]]

    return (
        keyed.groupBy("bucket", "part")
        .cogroup(filters.groupBy("bucket", "part"))
        .applyInPandas(probe, "sha string, bucket bigint")
    )


def exact_groups(docs: DataFrame, stored: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): digest rows of ``docs``, and per digest size, row to keep and whether it was stored before.

    ``stored`` tells the rows of the snapshot from those of the incoming batch.
    """
    rows = stage(digests(docs, doc_id, text, F.coalesce(stored, F.lit(False)).alias("stored")), "dedup-rows")
    snapshot = build_snapshot(rows.where("stored"))
    batch = stage(grouped(rows.where("NOT stored")), "dedup-batch")
    positives = screen(batch, snapshot)
    known = (
        positives.join(snapshot.groups, ["bucket", "sha"])
        .select("sha", F.col("size").alias("stored_size"), F.col("keep").alias("stored_keep"))
    )
    incoming = batch.join(known, "sha", "left").select(
        "sha",
        (F.col("size") + F.coalesce(F.col("stored_size"), F.lit(0))).alias("size"),
        F.greatest("keep", "stored_keep").alias("keep"),
        F.col("stored_size").isNotNull().alias("was_stored"),
    )
    untouched = snapshot.groups.join(known, "sha", "left_anti").select(
        "sha", "size", "keep", F.lit(True).alias("was_stored")
    )
    groups = stage(incoming.unionByName(untouched), "dedup-groups")
    compared = groups.join(_compared(docs, groups, text), "sha", "left")
    differs = (F.col("size") > 1) & ((F.col("variants") != 1) | (F.col("n") != F.col("size")))
    message = F.concat(F.lit("different texts share the digest "), F.col("sha"))
    return rows, compared.select(
        "sha",
        F.when(differs, F.raise_error(message).cast("bigint")).otherwise(F.col("size")).alias("size"),
        "keep",
        "was_stored",
    )


def _compared(docs: DataFrame, groups: DataFrame, text: str) -> DataFrame:
    """Byte check: number of distinct texts and rows per digest that several rows share.

    A bitmap of the shared digests keeps nearly all other texts out of the shuffle.
    """
    copied = stage(groups.where("size > 1").select("sha"), "dedup-copied")
    texts = docs.select(normalised(F.col(text)).alias("bytes")).withColumn("sha", F.sha2("bytes", 256))
    texts = likely(texts, F.col("sha"), slot_bitmap(copied, "sha"))
    same = texts.groupBy("sha", "bytes").agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("sha").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"))


def deduplicate(docs: DataFrame, stored: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, was_stored."""
    rows, groups = exact_groups(docs, stored, doc_id, text)
    named = rows.withColumn("name", F.col("row").cast("string"))
    return spread_join(named, F.col("sha"), "name", groups, "sha", "size").select(
        "doc_id",
        F.col("found.keep.doc_id").alias("keep_id"),
        F.col("found.size").alias("group_size"),
        (F.col("row") == F.col("found.keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("found.was_stored").alias("was_stored"),
    )


def keep_one(docs: DataFrame, stored: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only rows of texts that recur are shuffled."""
    decided = deduplicate(docs, stored, doc_id, text)
    copied = decided.where("group_size > 1").groupBy("text_sha256", "doc_id")
    kept = stage(
        copied.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
        .where("kept")
        .select(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_keep"), "rows"),
        "dedup-kept",
    )
    bitmap = slot_bitmap(kept, "_sha")
    sha = F.sha2(normalised(F.col(text)), 256)
    alone = likely(docs, sha, bitmap, inside=False)
    # A text in the bitmap by chance has no kept row and stays as it is.
    near = likely(docs, sha, bitmap)
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    packed = near.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_id"), sha.alias("_row_sha"))
    joined = packed.join(kept, F.col("_row_sha") == F.col("_sha"), "left")
    stays = joined.where(F.col("_sha").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    if not kept.where("rows > 1").isEmpty():
        same = Window.partitionBy("_row_sha", "_id").orderBy("_sha")
        stays = stays.withColumn("_n", F.row_number().over(same)).where(F.col("_sha").isNull() | (F.col("_n") == 1))
    return alone.unionByName(stays.select(*names))
