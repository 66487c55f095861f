"""Reading, staging and counting helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from volpanel.session import drop_scratch, scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of an Arrow batch while a table is staged. A task and its Python worker hold several batches each, so
#: Spark's own bound of 64 MB would cost hundreds of MB of an executor with texts or sets of shingles.
BATCH_BYTES = 4 << 20
#: Rows that are read at a time while a table is staged, texts and sets of some KB each: Spark's own 4,096 are tens of MB a task.
READ_ROWS = 512
#: Bytes that a task collects before it writes them; the format's own bound is 128 MB.
GROUP_BYTES = 16 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned inside reads few rows at a time and gives Python workers ``BATCH_BYTES`` at most, but whole rows."""
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _write(df: DataFrame, path: str) -> None:
    with small_batches(df.sparkSession):
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage, survives lost executors, and gives the planner the true size of the table.
    """
    path = scratch_path(df.sparkSession, label)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that go together once what was derived from them is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        _write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        drop_scratch(self.spark, *self.paths)
        self.paths = []


#: A key of more rows than this is hot; its row of the other side is repeated for so many parts.
HOT_ROWS, HOT_PARTS = 1000, 32


def spread_join(left: DataFrame, key: Column, own: str, right: DataFrame, right_key: str, rows: str) -> DataFrame:
    """Left join that deals a hot key's rows over several tasks; adds a struct ``found`` of the right side's columns.

    ``own`` is a column of ``left`` that tells its rows apart and is no key of ``right``; ``right`` has one row per key, with
    the number of ``rows`` that ask for it. Only hot rows of ``right`` are repeated, at most ``HOT_PARTS`` in ``HOT_ROWS`` of
    the rows on the left. Rows that a hot key answered, and those without a key, go on under their own name.
    """
    names = [F.col(c) for c in right.columns]
    hot = right.where(F.col(rows) > HOT_ROWS).select(
        F.col(right_key).alias("_key"),
        F.struct(*names).alias("_hot"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HOT_PARTS - 1).cast("bigint"))).alias("_part"),
    )
    cold = right.where(F.col(rows) <= HOT_ROWS).select(F.col(right_key).alias("_key"), F.struct(*names).alias("_cold"))
    asked = left.withColumn("_key", F.coalesce(key, F.col(own))).withColumn("_part", F.pmod(F.xxhash64(own), F.lit(HOT_PARTS)))
    first = asked.join(hot, ["_key", "_part"], "left")
    second = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_key")).otherwise(F.col(own)))
    return second.join(cold, "_key", "left").select(
        *[F.col(c) for c in left.columns], F.coalesce("_hot", "_cold").alias("found")
    )


def word_tokens(text: Column) -> Column:
    """Tokens of a document for budgets and packing: its words and one end marker; null counts as empty."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + F.lit(1)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """A-Z only; every other letter keeps its case. Pure ASCII, told by its size, takes the fast way."""
    mixed = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mixed)


def tasks(spark: SparkSession) -> int:
    """Partitions for a stage that is dealt by a key: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a shared bitmap of keys: 8 MB at most, whatever the number of keys.
SLOTS = 1 << 26


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def in_slots(slots: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Whether each slot is set in the bitmap."""
    at = slots.to_numpy()
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def slot_bitmap(keys: DataFrame, key: str, slot: Column | None = None) -> np.ndarray:
    """Bitmap of the hash slots that the keys fall into; ``slot`` tells a key's slot where it isn't the usual one."""
    slots = keys.select((slot_of(F.col(key)) if slot is None else slot).alias("slot"))
    chunks = slots.groupBy(F.expr("slot div 32768").alias("chunk")).agg(
        F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits")
    )
    bitmap = np.zeros(SLOTS // 8, dtype=np.uint8)
    for row in chunks.toLocalIterator():
        bits = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        bitmap[row["chunk"] * 4096 : row["chunk"] * 4096 + len(bits)] = bits
    return bitmap


def likely(df: DataFrame, key: Column, bitmap: np.ndarray | Broadcast, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose key falls into a slot of the bitmap: all that have one of its keys, and few others.

    With ``inside=False`` all other rows, which surely have none of its keys. Spares the shuffle of wide rows that a join
    would not change. The bitmap's size is fixed, so it may be shared.
    """
    shared = bitmap if isinstance(bitmap, Broadcast) else df.sparkSession.sparkContext.broadcast(bitmap)
    names = df.columns

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_slots(batch.column(batch.num_columns - 1), shared.value)
            yield batch.filter(pa.array(hit == inside)).select(range(batch.num_columns - 1))

    given = df.select(*[F.col(f"`{c}`") for c in names], slot_of(key).alias("_slot"))
    return map_batches(given, screened, df.schema)


def map_batches(df: DataFrame, fn, schema: StructType) -> DataFrame:
    """``mapInArrow`` by position, so that any column names will do, dots and repeats included."""
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fn(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*schema.names)
