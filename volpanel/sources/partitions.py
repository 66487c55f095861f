"""Date-partitioned Parquet datasets and result sinks."""

from __future__ import annotations

import datetime as dt

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from volpanel.session import drop_scratch, path_exists, scratch_path

PARTITIONS = ("year", "quote_date")
#: Further folder levels, for the columns that a dataset has: what one feed delivers never replaces another's.
FEED_PARTITIONS = ("underlying_symbol", "option_root")


def partition_columns(df: DataFrame) -> tuple[str, ...]:
    """Year, date, and the feed columns present."""
    return (*PARTITIONS, *[c for c in FEED_PARTITIONS if c in df.columns])


def write_date_partitions(df: DataFrame, path: str, partitions: tuple[str, ...] | None = None, mode: str = "overwrite") -> None:
    """Write by year, date, underlying and root, replacing (or, in mode append, adding to) only the partitions present;
    an empty frame is an error.

    The rebalance hint lets adaptive execution merge small dates and split a heavy one, so a date
    holding much of the data is written by several tasks. Rows are counted while they are written, so
    nothing runs twice.
    """
    written = Observation()
    dated = df.withColumn("year", F.year("quote_date")).observe(written, F.count(F.lit(1)).alias("rows"))
    (
        dated.hint("rebalance", "quote_date")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*(partitions or partition_columns(df)))
        .parquet(path)
    )
    if not written.get.get("rows"):
        raise ValueError("an empty date partition was written")


def merge_date_partitions(
    df: DataFrame, path: str, unite: Callable[[DataFrame], DataFrame], partitions: tuple[str, ...] | None = None
) -> None:
    """Bring rows into a dataset that may already hold some of their partitions.

    The partitions that ``df`` touches are read, united with the new rows by ``unite`` (which drops copies and
    refuses conflicts), written aside, and put back; all others stay. Bringing the same rows again changes nothing.
    """
    spark = df.sparkSession
    keys = partitions or partition_columns(df)
    fresh_path, merged_path = scratch_path(spark, "fresh"), scratch_path(spark, "merged")
    df.withColumn("year", F.year("quote_date")).write.parquet(fresh_path)
    schema = df.withColumn("year", F.year("quote_date")).schema
    fresh = spark.read.schema(schema).parquet(fresh_path)
    touched = fresh.select(*keys).distinct()
    rows = fresh
    if path_exists(spark, path):
        # A calendar bounds the dates of a batch; the list prunes folders of the dataset.
        dates = [r[0] for r in touched.select("quote_date").distinct().collect()]
        held = spark.read.schema(schema).parquet(path).where(F.col("quote_date").isin(dates))
        rows = fresh.unionByName(held.join(touched, list(keys), "left_semi").select(*fresh.columns))
    unite(rows.drop("year")).write.parquet(merged_path)
    merged = spark.read.schema(df.schema).parquet(merged_path)
    if not touched.isEmpty():
        write_date_partitions(merged, path, keys)
    drop_scratch(spark, fresh_path, merged_path)


def add_new_rows(
    rows: DataFrame, path: str, key: tuple[str, ...], complete: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> None:
    """Add the rows that a dataset does not hold yet; ``rows`` has no copies, and ``complete`` derives the columns it lacks.

    Held rows are read but not moved: hashes of keys find those that meet, and only these are compared as they are. Rows that
    share a key and differ are an error before anything is written. Bringing the same rows again changes nothing.
    """
    spark = rows.sparkSession
    fresh_path = scratch_path(spark, "fresh")
    rows.write.parquet(fresh_path)
    fresh = spark.read.schema(rows.schema).parquet(fresh_path)
    hashed = F.xxhash64(*key).alias("_key")
    held = spark.createDataFrame([], rows.schema)
    if path_exists(spark, path):
        # A calendar bounds the dates of a batch; the list prunes folders of the dataset.
        dates = [r[0] for r in fresh.select("quote_date").distinct().collect()]
        whole = complete(fresh).withColumn("year", F.year("quote_date")).schema
        held = spark.read.schema(whole).parquet(path).where(F.col("quote_date").isin(dates)).select(*rows.columns)
    both = fresh.select(hashed, F.lit(True).alias("new")).unionByName(held.select(hashed, F.lit(False).alias("new")))
    met_path = scratch_path(spark, "met")
    met = both.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("new").alias("new")).where("n > 1 AND new")
    met.select("_key").write.parquet(met_path)
    met = spark.read.schema("_key bigint").parquet(met_path)
    added = fresh
    if not met.isEmpty():
        tagged = fresh.withColumn("_key", hashed)
        close = [tagged.join(met, "_key", "left_semi").drop("_key"), held.withColumn("_key", hashed).join(met, "_key", "left_semi").drop("_key")]
        variants = close[0].unionByName(close[1]).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("variants"))
        shown = [tuple(r) for r in variants.where("variants > 1").drop("variants").take(5)]
        if shown:
            raise ValueError(f"Conflicting duplicate contracts for keys: {shown}")
        lacking = tagged.join(met, "_key", "left_anti").drop("_key")
        added = lacking.unionByName(close[0].exceptAll(close[1]))
    if not added.isEmpty():
        write_date_partitions(complete(added), path, mode="append")
    drop_scratch(spark, fresh_path, met_path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Lazy scan of a partitioned dataset; filters on year and date prune folders."""
    return spark.read.parquet(path)


def scan_parquet(spark: SparkSession, root: str) -> DataFrame:
    """Lazy recursive scan of plain Parquet files."""
    return spark.read.option("recursiveFileLookup", True).parquet(root)


def partition_index(dataset: DataFrame, by_file: bool = False) -> DataFrame:
    """Rows and an order-independent content checksum per date (and file)."""
    columns = [c for c in dataset.columns if c not in partition_columns(dataset)]
    file_path = F.col("_metadata.file_path")
    keys = [F.col("quote_date"), *([file_path.alias("file_path")] if by_file else [])]
    hashed = dataset.select(*keys, F.xxhash64(*columns).alias("_h"), file_path.alias("_file"))
    names = ["quote_date", *(["file_path"] if by_file else [])]
    per_file = hashed.groupBy(*names, "_file").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("h"))
    return per_file.groupBy(*names).agg(
        F.sum("n").alias("row_count"), F.bit_xor("h").alias("checksum"), F.count(F.lit(1)).alias("files")
    ).withColumn("year", F.year("quote_date"))


def repeated_partitions(index: DataFrame) -> DataFrame:
    """Entries of a partition index that name a date (and file, if it has files) more than once."""
    key = [c for c in ("quote_date", "file_path") if c in index.columns]
    return index.groupBy(*key).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


def available_dates(dataset: DataFrame) -> DataFrame:
    return dataset.select("quote_date").distinct()


def load_dates(dataset: DataFrame, dates: list[dt.date | str]) -> DataFrame:
    """Rows of the given dates; asking for nothing or for an absent date is an error."""
    if not dates:
        raise ValueError("no quote dates were requested")
    if len({str(d) for d in dates}) != len(dates):
        raise ValueError("a quote date was requested twice")
    wanted = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in dates})
    rows = dataset.where(F.col("quote_date").isin(wanted))
    present = {r[0] for r in rows.select("quote_date").distinct().collect()}
    missing = [d.isoformat() for d in wanted if d not in present]
    if missing:
        raise FileNotFoundError(f"no partition for quote dates: {missing[:5]}")
    return rows


def load_date(dataset: DataFrame, date: dt.date | str) -> DataFrame:
    return load_dates(dataset, [date])


def write_result(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Parquet or JSON result; the schema is kept even without rows."""
    if file_format not in ("parquet", "json"):
        raise ValueError(f"unsupported result format {file_format}")
    df.write.mode("overwrite").format(file_format).save(path)
