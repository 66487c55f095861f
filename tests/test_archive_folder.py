"""Archives of the quotes: days inside them, equal rows, rows without a date, and tasks for many small files."""

from datetime import date, datetime

from volpanel.plans import catalog
from volpanel.plans.queries_storage import archive_folder
from volpanel.sources import archive_source

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, " \
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def lines(spark, folder, *dated):
    """A table with so many equal lines per date."""
    rows = [(1, 2, 3, 2, 4.0, 500.0, 0.05, 0.02, "R", "O", day) for day, copies in dated for _ in range(copies)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_scan_tells_days_and_keeps_equal_and_undated_rows(spark, tmp_path):
    table = lines(spark, tmp_path, (datetime(1997, 3, 4), 25_000), (datetime(1997, 3, 5), 2), (None, 3))
    found = {r.quote_date: r["rows"] for r in catalog.QUERIES["archive_scan"](spark, table).collect()}
    assert found == {date(1997, 3, 4): 25_000, date(1997, 3, 5): 2, None: 3}
    listed = {r.trade_date: r for r in catalog.QUERIES["archive_inventory"](spark, table).collect()}
    assert {d: r["rows"] for d, r in listed.items()} == {date(1997, 3, 1): 25_002, None: 3}
    assert all(r.hashes_match and r.sizes_match and r.all_readable for r in listed.values())


def test_an_archive_holds_more_than_a_batch(spark, tmp_path):
    _, noted = archive_folder(spark, lines(spark, tmp_path, (datetime(1997, 3, 4), 25_000)))
    assert [r["rows"] for r in noted.collect()] == [25_000]


def test_many_small_archives_share_partitions(spark):
    small = [archive_source.Archive(f"a{i:04d}", date(2020, 1, 1), 1000) for i in range(5000)]
    parts = archive_source.shared_partitions(small)
    assert 32 <= len(parts) < 120
    assert [a.path for p in parts for a in p.members] == [a.path for a in small]
    large = [archive_source.Archive(str(i), date(2020, 1, 1), 64 << 20) for i in range(50)]
    assert len(archive_source.shared_partitions(large)) == 50
