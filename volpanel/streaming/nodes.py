"""Node collapse over a stream of quotes with duplicates dropped."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

NODE_GROUP = ("root", "expiration", "strike")


def unique_quotes(quotes: DataFrame, event_time: str, duplicate_key: tuple[str, ...], delay: str = "7 days") -> DataFrame:
    """Quotes of a stream; copies of a quote inside the watermark count once."""
    return quotes.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(duplicate_key))


def _sums() -> list[Column]:
    iv, vega = F.col("implied_volatility_1545"), F.col("vega_1545")
    return [
        F.sum(iv * vega).alias("iv_vega"),
        F.sum(vega).alias("node_vega"),
        F.sum("trade_volume").alias("trade_volume"),
        F.count(F.lit(1)).alias("collapsed_contract_count"),
    ]


def _utc_day(stamp: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(stamp) / 86400).cast("int"))


def streaming_nodes(
    quotes: DataFrame,
    event_time: str,
    duplicate_key: tuple[str, ...],
    delay: str = "7 days",
    group: tuple[str, ...] = NODE_GROUP,
) -> DataFrame:
    """Daily windows of vega-weighted nodes; copies of a quote inside the watermark count once."""
    unique = unique_quotes(quotes, event_time, duplicate_key, delay)
    collapsed = unique.groupBy(F.window(event_time, "1 day"), *group).agg(*_sums())
    # Windows start at UTC midnight whatever the session time zone.
    return collapsed.withColumn("quote_date", _utc_day("window.start")).drop("window")


def start_node_sink(nodes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every changed node with its batch number; readers take the newest version."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch rewrites its own folder, so each batch lands exactly once.
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        nodes.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_parts_sink(
    unique: DataFrame, event_time: str, out: str, checkpoint: str, group: tuple[str, ...] = NODE_GROUP
) -> StreamingQuery:
    """Collapse the quotes that each micro-batch brings to parts of daily nodes, which ``merged_nodes`` adds up.

    Quotes come without copies, so parts only add: no node is held as state or written again when it grows, and the
    stream's one state is that of ``unique_quotes``. Quotes without a time are nodes without a date.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = batch.groupBy(_utc_day(event_time).alias("quote_date"), *group).agg(*_sums())
        # A replayed batch rewrites its own folder, so each batch lands exactly once.
        parts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        unique.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_nodes(parts: DataFrame, key: tuple[str, ...] = ("quote_date", *NODE_GROUP)) -> DataFrame:
    """Nodes out of the parts of all batches, with the weighted volatility."""
    columns = ("iv_vega", "node_vega", "trade_volume", "collapsed_contract_count")
    rows = parts.groupBy(*key).agg(*[F.sum(c).alias(c) for c in columns])
    return rows.withColumn("node_iv", F.try_divide("iv_vega", "node_vega")).drop("iv_vega")


class LateRows(StreamingQueryListener):
    """Counts the rows that queries left out because they arrived behind the watermark, over every progress event.

    ``recentProgress`` of a query forgets all but its newest events; a listener started before the query sees each of them.
    """

    def __init__(self, spark: SparkSession):
        self._counts: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        spark.streams.addListener(self)
        self._spark = spark

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        with self._lock:
            run = str(event.progress.runId)
            self._counts[run] = self._counts.get(run, 0) + late

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def of(self, query: StreamingQuery, wait: float = 60.0) -> int:
        """Late rows of a query that has ended. Events come in order, so all of its progress is in when its end is."""
        run = str(query.runId)
        if not self._end_of(run).wait(wait):
            raise TimeoutError("the end of the query was not reported")
        with self._lock:
            return self._counts.get(run, 0)

    def require_none(self, query: StreamingQuery) -> None:
        """Raise if an ended query left out late rows; they have to be brought again with a longer delay."""
        late = self.of(query)
        if late:
            raise ValueError(f"{late} quotes arrived behind the watermark")

    def close(self) -> None:
        self._spark.streams.removeListener(self)


def compact_versions(spark: SparkSession, out: str, compacted: str, key: tuple[str, ...] = ("quote_date", *NODE_GROUP)) -> None:
    """Write the newest version of every node once, as batch 0 of a fresh folder."""
    versions = spark.read.parquet(out)
    columns = [c for c in versions.columns if c not in (*key, "batch_id")]
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch_id").alias("n"))
    newest.select(*key, "n.*").write.mode("overwrite").parquet(f"{compacted}/batch_id=0")


def latest_nodes(versions: DataFrame, key: tuple[str, ...] = ("quote_date", *NODE_GROUP)) -> DataFrame:
    """Newest version of every node, with the weighted volatility."""
    columns = ("iv_vega", "node_vega", "trade_volume", "collapsed_contract_count")
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch_id").alias("n"))
    rows = newest.select(*key, "n.*")
    return rows.withColumn("node_iv", F.try_divide("iv_vega", "node_vega")).drop("iv_vega")


def node_quality(nodes: DataFrame, by: tuple[str, ...] = ("quote_date",)) -> DataFrame:
    """Node and expiry counts per date of the streamed nodes."""
    per_expiry = nodes.groupBy(*by, "root", "expiration").agg(F.count(F.lit(1)).alias("n"))
    return per_expiry.groupBy(*by).agg(
        F.sum("n").alias("surface_node_count"),
        F.count_distinct("expiration").alias("valid_expiry_count"),
        F.count_distinct("root").alias("root_count"),
    )
