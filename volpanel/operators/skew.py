"""Spreading of heavy groups over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parallelism(df: DataFrame) -> int:
    """Partitions for compute-heavy stages: three per core, and never below the shuffle setting."""
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_groups(
    df: DataFrame, key: tuple[str, ...], within: tuple[str, ...], rows_per_task: int = 5000
) -> DataFrame:
    """Partition by group, and split a group of more than ``rows_per_task`` rows over several tasks.

    Ordinary groups stay whole, so a later partial aggregation emits each group once; a heavy group
    gets as many salts as its size asks for and is combined again by the final aggregation.
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_task)).cast("bigint")
    salted = df.join(sizes, list(key)).withColumn("_salt", F.pmod(F.xxhash64(*within), salts))
    return salted.repartition(parallelism(df), *key, "_salt").drop("_n", "_salt")


def exact_median(df: DataFrame, key: tuple[str, ...], value: str, out: str = "median", accuracy: int = 10000) -> DataFrame:
    """Exact median per group without ever holding a group in one task.

    A mergeable sketch brackets the median between two data values a few ranks in ``accuracy``
    apart. Values below the bracket are only counted; the few inside are counted per value and
    walked in order. Groups of any size are combined on the map side in every pass.
    """
    keys = list(key)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    margin = 2.0 / accuracy
    bracket = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], accuracy).alias("_q"),
    )
    # One slot collects everything below the bracket, the others one value each.
    placed = rows.join(bracket, keys).where(F.col("_v") <= F.col("_q")[1])
    slot = F.when(F.col("_v") >= F.col("_q")[0], F.col("_v"))
    counted = placed.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.col("_slot").asc_nulls_first())
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto)
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def at(rank):
        return F.min(F.when(F.col("_upto") > rank, F.col("_slot")))

    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2.0).alias(out))
