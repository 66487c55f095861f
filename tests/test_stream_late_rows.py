"""Late rows of long streams are counted over every micro-batch."""

import os
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from volpanel.session import scratch_path, set_times_by_name
from volpanel.streaming import nodes

SCHEMA = (
    "quote_ts timestamp, root string, expiration date, strike double, implied_volatility_1545 double, vega_1545 double, "
    "trade_volume bigint"
)


def arrive(folder, number, day, strike):
    stamp = datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(days=day)
    table = pa.table(
        {
            "quote_ts": pa.array([stamp], pa.timestamp("us", "UTC")), "root": ["R"], "expiration": pa.array([date(2021, 1, 1)], pa.date32()),
            "strike": [float(strike)], "implied_volatility_1545": [0.2], "vega_1545": [1.0], "trade_volume": pa.array([1], pa.int64()),
        }
    )
    path = folder / f"{number:04d}.parquet"
    pq.write_table(table, path)
    os.utime(path, (1_600_000_000 + number, 1_600_000_000 + number))


def test_an_early_late_row_is_still_counted_after_many_batches(spark, tmp_path):
    folder = tmp_path / "arrivals"
    folder.mkdir()
    for i in range(20):
        arrive(folder, i, 0 if i == 3 else 30 + i, 1000 + i)
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.numRecentProgressUpdates": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    late = nodes.LateRows(spark)
    try:
        raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        built = nodes.streaming_nodes(raw, "quote_ts", ("quote_ts", "root", "strike"), "7 days")
        query = nodes.start_node_sink(built, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert len(query.recentProgress) <= 8
        assert not any(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
        assert late.of(query) == 1
        with pytest.raises(ValueError, match="1 quotes arrived behind"):
            late.require_none(query)
    finally:
        late.close()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert nodes.latest_nodes(spark.read.parquet(str(tmp_path / "out"))).count() == 19


def test_files_get_times_in_the_order_of_their_names(spark):
    path = scratch_path(spark, "times")
    spark.range(40).repartitionByRange(4, "id").write.parquet(path)
    set_times_by_name(spark, path)
    local = path.removeprefix("file:")
    names = sorted(n for n in os.listdir(local) if n.startswith("part-"))
    times = [os.path.getmtime(os.path.join(local, n)) for n in names]
    assert times == sorted(times) and len(set(times)) == len(times)
    with pytest.raises(ValueError):
        set_times_by_name(spark, "/tmp/elsewhere")
