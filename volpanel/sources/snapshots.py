"""Date-partitioned dataset with committed snapshots.

Rows are written to a folder of their own commit; a manifest then lists, per date, the commit that holds it, its rows and
a checksum of its content. A commit takes effect by the creation of one small file that must not exist yet: a writer that stops
before leaves the old snapshot, and of two writers at once the second fails. Readers start from the newest of these files
and read nothing that its manifest does not list, so they never see half a commit or list folders to learn dates.

Layout below the dataset's path: ``data/commit=…/year=…/quote_date=…``, ``manifests/<commit>``, ``log/<version>``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.session import create_file, list_names, read_file
from volpanel.sources.partitions import repeated_partitions

PARTITIONS = ("commit", "year", "quote_date")
MANIFEST = "quote_date date, commit string, row_count bigint, checksum decimal(38,0)"


def content_checksum(columns: list[str]) -> Column:
    """Sum of the rows' hashes: the same in any order, and copies of a row count."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)]).cast("decimal(20,0)")).cast("decimal(38,0)")


def summarized(rows: DataFrame) -> DataFrame:
    """Rows and checksum per date."""
    columns = [c for c in rows.columns if c not in PARTITIONS]
    return rows.groupBy("quote_date").agg(F.count(F.lit(1)).alias("row_count"), content_checksum(columns).alias("checksum"))


def version(spark: SparkSession, path: str) -> int:
    """Newest committed version, 0 before the first."""
    return max((int(n) for n in list_names(spark, f"{path}/log") if n.isdigit()), default=0)


def manifest(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """One row per date of a snapshot; a date listed twice is an error."""
    at = version(spark, path) if at is None else at
    if not at:
        return spark.createDataFrame([], MANIFEST)
    found = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{read_file(spark, f'{path}/log/{at:010d}')}")
    twice = repeated_partitions(found).take(1)
    if twice:
        raise ValueError(f"version {at} lists {twice[0]['quote_date']} more than once")
    return found


def stage_rows(df: DataFrame, path: str) -> str:
    """Write the rows of a commit to be; nothing reads them before ``publish``."""
    commit = uuid.uuid4().hex
    dated = df.withColumn("year", F.year("quote_date"))
    dated.hint("rebalance", "quote_date").write.partitionBy("year", "quote_date").parquet(f"{path}/data/commit={commit}")
    return commit


def publish(spark: SparkSession, path: str, commit: str, base: int) -> int:
    """Make a staged commit the newest version: its dates replace those of version ``base``, all others stay.

    Fails if another version followed ``base`` in the meantime, and for a commit without rows.
    """
    rows = spark.read.parquet(f"{path}/data/commit={commit}")
    fresh = summarized(rows).withColumn("commit", F.lit(commit))
    if fresh.isEmpty():
        raise ValueError("an empty commit was staged")
    if fresh.where("quote_date IS NULL").take(1):
        raise ValueError("rows without a quote date can't be committed")
    kept = manifest(spark, path, base).join(fresh.select("quote_date"), "quote_date", "left_anti")
    columns = ["quote_date", "commit", "row_count", "checksum"]
    kept.select(*columns).unionByName(fresh.select(*columns)).coalesce(1).write.parquet(f"{path}/manifests/{commit}")
    if not create_file(spark, f"{path}/log/{base + 1:010d}", commit):
        raise RuntimeError(f"version {base + 1} was committed by another writer")
    return base + 1


def commit(df: DataFrame, path: str) -> int:
    """Replace the dates that ``df`` holds, all at once; returns the new version."""
    base = version(df.sparkSession, path)
    return publish(df.sparkSession, path, stage_rows(df, path), base)


def load(
    spark: SparkSession, path: str, dates: list[dt.date | str] | None = None, at: int | None = None, verify: bool = False
) -> DataFrame:
    """Rows of a snapshot, or of some of its dates; an absent or repeated date is an error, known from the manifest alone.

    ``verify`` reads the rows once more beforehand and compares their number and checksum with the manifest.
    """
    listed = manifest(spark, path, at)
    if dates is not None:
        wanted = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in dates})
        if not dates or len(wanted) != len(dates):
            raise ValueError("dates must be given, each of them once")
        listed = listed.where(F.col("quote_date").isin(wanted))
        present = {r[0] for r in listed.select("quote_date").collect()}
        missing = [d.isoformat() for d in wanted if d not in present]
        if missing:
            raise FileNotFoundError(f"no partition for quote dates: {missing[:5]}")
    commits = [r[0] for r in listed.select("commit").distinct().collect()]
    if not commits:
        raise FileNotFoundError(f"nothing was committed to {path}")
    # Commits and dates prune folders; the join drops dates that a later commit replaced.
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/commit={c}" for c in commits])
    if dates is not None:
        rows = rows.where(F.col("quote_date").isin(wanted))
    rows = rows.join(listed.select("commit", "quote_date"), ["commit", "quote_date"], "left_semi")
    if verify:
        same = ["quote_date", "row_count", "checksum"]
        bad = listed.select(*same).exceptAll(summarized(rows).select(*same)).take(1)
        if bad:
            raise ValueError(f"the rows of {bad[0]['quote_date']} are not those that were committed")
    return rows.drop("commit")
