"""The streamed nodes of the registered queries: parts of micro-batches, what is held as state, rows without a date."""

from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from volpanel.plans import queries_storage
from volpanel.streaming import nodes


@pytest.fixture
def lines(tmp_path):
    """Ninety rows of thirty days, every third one again, and three without a date."""
    rows = []
    for i in range(90):
        stamp = None if i < 3 else datetime(2020, 1, 1) + timedelta(days=i % 30)
        rows.append((stamp, i, i % 3, "AB"[i % 2], float(1 + i % 4), 0.25, 7, 1000.0))
        if i % 3 == 0:
            rows.append(rows[-1])
    names = ("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_partkey", "l_extendedprice")
    kinds = (pa.timestamp("us"), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
    pq.write_table(pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))}), tmp_path / "lineitem.parquet")
    return str(tmp_path), sorted(set(rows), key=str)


def test_state_and_batches_do_not_grow_with_the_table(spark, lines, monkeypatch):
    folder, unique = lines
    queries = []
    plain = nodes.start_parts_sink

    def started(*args):
        queries.append(plain(*args))
        return queries[-1]

    monkeypatch.setattr(nodes, "start_parts_sink", started)
    monkeypatch.setattr(queries_storage, "ARRIVALS", 2)
    monkeypatch.setattr(queries_storage, "ARRIVAL_ROWS", 12)
    monkeypatch.setattr(queries_storage, "PER_BATCH", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = queries_storage.streamed_nodes(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = Counter()
    for stamp, _, number, root, strike, *_ in unique:
        day = stamp.date() if stamp else None
        want[day, root, day + timedelta(days=number * 125 - 120) if day else None, strike] += 1
    assert {(r.quote_date, r.root, r.expiration, r.strike): r.collapsed_contract_count for r in found} == dict(want)
    assert len(found) == len(want) and sum(n for key, n in want.items() if key[0] is None) == 3
    for r in found:
        n = r.collapsed_contract_count
        assert (r.trade_volume, round(r.node_vega, 9), round(r.node_iv, 9)) == (n * r.strike, round(n * r.strike / 10, 9), 0.25)
    progress = [p for p in queries[0].recentProgress if p.numInputRows]
    # 120 rows make ten files, two a batch; copies are the only state.
    assert len(progress) >= 4
    assert all(len(p.stateOperators) == 1 for p in progress)
