"""Incremental ingest of daily archives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from volpanel.operators import audit, clean
from volpanel.operators.keys import CONTRACT_KEY
from volpanel.sources import vendor
from volpanel.sources.partitions import add_new_rows

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def archive_stream(spark: SparkSession, root: str) -> DataFrame:
    """Newly arriving daily calcs archives."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", vendor.ARCHIVE_GLOB)
        .load(root)
    )
    return audit.with_file_columns(files).where("file_kind = 'daily_calcs'")


def start_clean_sink(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    rules: clean.CleanRules = clean.CleanRules(),
    early_closes: list | None = None,
    key: tuple[str, ...] = CONTRACT_KEY,
) -> StreamingQuery:
    """Clean every micro-batch and add it to the partitions of its dates, underlyings and roots.

    A date may arrive in any number of batches: rows that it does not hold yet are added, so no row is lost, a replayed
    batch changes nothing, and rows that contradict each other or what is held stop the stream. What is held is not written
    again, and columns that follow from others are derived after the shuffles. The query stops once everything present at its start
    is processed; the next start continues from its checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        distinct = clean.deduplicate(clean.quality_filter(parse(batch), rules), key).rows.drop("copies")
        add_new_rows(distinct, out, key, lambda rows: clean.with_contract_columns(rows, early_closes, rules))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_ingest(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    underlying: str,
    option_root: str,
    rules: clean.CleanRules = clean.CleanRules(),
) -> StreamingQuery:
    """Ingest newly arrived daily archives of one underlying and root."""
    return start_clean_sink(
        archive_stream(spark, root),
        out,
        checkpoint,
        lambda batch: vendor.ingest(batch, underlying, option_root).drop("option_root"),
        rules,
    )
