import hashlib
import zipfile
from datetime import date

import pytest
from corpus import archive_name, business_days, day_quotes, write_archive, write_corpus
from pyspark.sql import functions as F

from volpanel.operators import audit, clean
from volpanel.sources import early_close, partitions, vendor
from volpanel.sources.schema import DOCUMENTED_COLUMNS
from volpanel.operators.keys import CONTRACT_KEY
from volpanel.streaming.ingest import start_clean_sink, start_ingest

WINDOW = (date(2020, 1, 1), date(2020, 12, 31))


def test_discovery_inventory_and_layout(spark, tmp_path):
    days = write_corpus(tmp_path, 3, nested=True)
    write_archive(tmp_path / "UnderlyingOptionsEODCalcs_2020-02.zip", [])
    (tmp_path / "notes.txt").write_text("x")
    files = vendor.discover(spark, str(tmp_path))
    found = vendor.require_daily_files(files, *WINDOW)
    listed = vendor.inventory(found).orderBy("trade_date").collect()
    assert [r.trade_date for r in listed] == days
    for row in listed:
        content = open(row.file_path.removeprefix("file:"), "rb").read()
        assert row.file_size == len(content) and row.sha256 == hashlib.sha256(content).hexdigest()
        assert row.readable and row.csv_member_count == 1 and row.csv_member_name == "part0.csv"
    base = files.withColumn("root_dir", F.lit(f"file:{tmp_path}"))
    layout = audit.corpus_layout(base).first()
    assert layout.daily_zip_count == 3 and layout.grouping_mode == "nested_daily"
    assert layout.relative_parent_directories == ["2020/01"]
    assert layout.unsupported_grouped_archives == ["UnderlyingOptionsEODCalcs_2020-02.zip"]


def test_flat_layout_and_window_filter(spark, tmp_path):
    days = write_corpus(tmp_path, 3)
    files = vendor.discover(spark, str(tmp_path)).withColumn("root_dir", F.lit(f"file:{tmp_path}"))
    assert vendor.daily_files(files, days[1], days[1]).count() == 1
    layout = audit.corpus_layout(files).first()
    assert layout.grouping_mode == "flat_daily" and layout.relative_parent_directories == ["."]


@pytest.mark.parametrize(
    ("name", "message"),
    [
        ("UnderlyingOptionsEODCalcs_2020-01.zip", "monthly or yearly calcs"),
        ("UnderlyingOptionsEODQuotes_2020-01-02.zip", "quote-only archives were found in the window"),
        ("UnderlyingOptionsEODQuotes_2020.zip", "quote-only archives were found; daily calcs"),
        ("UnderlyingOptionsEODOther.zip", "no quote archives"),
    ],
)
def test_absence_of_daily_archives_is_explained(spark, tmp_path, name, message):
    write_archive(tmp_path / name, [])
    with pytest.raises(FileNotFoundError, match=message):
        vendor.require_daily_files(vendor.discover(spark, str(tmp_path)), *WINDOW)


def test_unreadable_archives_are_listed(spark, tmp_path):
    days = business_days(3)
    write_archive(tmp_path / archive_name(days[0]), day_quotes(days[0], 0))
    write_archive(tmp_path / archive_name(days[1]), day_quotes(days[1], 1), members=2)
    (tmp_path / archive_name(days[2])).write_bytes(b"not a zip")
    listed = vendor.inventory(vendor.discover(spark, str(tmp_path)))
    bad = {r.trade_date: r.csv_member_count for r in vendor.unreadable_files(listed).collect()}
    assert bad == {days[1]: 2, days[2]: 0}
    with pytest.raises(Exception, match="exactly one CSV"):
        vendor.scan_archives(vendor.daily_files(vendor.discover(spark, str(tmp_path)), days[1], days[1])).collect()


def test_scan_is_typed_and_streams_small_blocks(spark, tmp_path):
    days = write_corpus(tmp_path, 2)
    files = vendor.discover(spark, str(tmp_path))
    rows = vendor.scan_archives(files, block_bytes=2048)
    assert rows.count() == 2 * 110
    row = rows.where("option_type = 'C'").orderBy("quote_date", "expiration", "strike").first()
    assert row.quote_date == days[0] and isinstance(row.strike, float) and row.trade_volume == 100 and row.gamma_1545 is None
    assert rows.exceptAll(vendor.scan_archives(files)).count() == 0


def test_columns_are_matched_by_name(spark, tmp_path):
    day = business_days(1)[0]
    rows = day_quotes(day, 0)
    shuffled = ("surprise", *reversed(DOCUMENTED_COLUMNS))
    write_archive(tmp_path / "a" / archive_name(day), rows)
    write_archive(tmp_path / "b" / archive_name(day), [{**r, "surprise": "1"} for r in rows], shuffled)
    a, b = [vendor.scan_archives(vendor.discover(spark, str(tmp_path / p))).drop("source_file") for p in "ab"]
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_missing_required_column_and_bad_value_fail(spark, tmp_path):
    day = business_days(1)[0]
    rows = day_quotes(day, 0)
    write_archive(tmp_path / "a" / archive_name(day), rows, [c for c in DOCUMENTED_COLUMNS if c != "vega_1545"])
    with pytest.raises(Exception, match="missing required columns.*vega_1545"):
        vendor.scan_archives(vendor.discover(spark, str(tmp_path / "a"))).collect()
    rows[3]["strike"] = "abc"
    write_archive(tmp_path / "b" / archive_name(day), rows)
    with pytest.raises(Exception, match="abc"):
        vendor.scan_archives(vendor.discover(spark, str(tmp_path / "b"))).collect()


def test_header_audit(spark, tmp_path):
    days = business_days(4)
    columns = list(DOCUMENTED_COLUMNS)
    write_archive(tmp_path / archive_name(days[0]), [], columns)
    write_archive(tmp_path / archive_name(days[1]), [], columns)
    write_archive(tmp_path / archive_name(days[2]), [], columns[::-1])
    write_archive(tmp_path / archive_name(days[3]), [], [c for c in columns if c != "vega_1545"] + ["extra"])
    headers = vendor.read_headers(vendor.discover(spark, str(tmp_path)))
    report = audit.reconcile_headers(headers)
    rows = {r.trade_date: r for r in report.collect()}
    assert rows[days[0]].pass_status and not rows[days[3]].pass_status
    assert rows[days[3]].missing_calcs_columns == ["vega_1545"] and rows[days[3]].extra_columns == ["extra"]
    odd = {r.trade_date: r.order_differs for r in audit.header_anomalies(report, ("trade_date",)).collect()}
    assert odd == {days[2]: True, days[3]: True}


def test_content_dates_and_types(spark, tmp_path):
    days = business_days(2)
    write_archive(tmp_path / archive_name(days[0]), day_quotes(days[0], 0))
    write_archive(tmp_path / archive_name(days[1]), day_quotes(days[0], 1))
    files = vendor.discover(spark, str(tmp_path))
    report = audit.content_date_report(audit.content_dates(vendor.scan_archives(files), ("source_file", "trade_date")))
    assert {r.trade_date: r.quote_date_match for r in report.collect()} == {days[0]: True, days[1]: False}
    text = vendor.scan_archives(files, as_text=True)
    kinds = audit.type_frequencies(text, ("source_file",), ("strike", "trade_volume", "expiration", "root", "gamma_1545"))
    assert {r.column_name: (r.type_name, r.files) for r in kinds.collect()} == {
        "strike": ("double", 2), "trade_volume": ("bigint", 2), "expiration": ("date", 2), "root": ("string", 2), "gamma_1545": ("null", 2),
    }


def test_ingest_reports_dates_without_the_root(spark, tmp_path):
    days = business_days(3)
    for i, day in enumerate(days):
        write_archive(tmp_path / archive_name(day), day_quotes(day, i, ("SPXW",) if i == 1 else ("SPX", "SPXW")))
    files = vendor.discover(spark, str(tmp_path))
    rows = vendor.ingest(files, "^SPX", "SPX")
    assert rows.select("option_root").distinct().first().option_root == "SPX" and rows.count() == 220
    assert [r.trade_date for r in vendor.dates_without_rows(files, rows).collect()] == [days[1]]
    assert [r.quote_date for r in audit.dates_missing_root(vendor.scan_archives(files), "SPX").collect()] == [days[1]]


def test_duplicates_collapse_or_conflict(spark, tmp_path):
    day = business_days(1)[0]
    rows = day_quotes(day, 0)
    write_archive(tmp_path / "a" / archive_name(day), rows + rows[:7])
    scanned = vendor.scan_archives(vendor.discover(spark, str(tmp_path / "a")))
    cleaned = clean.clean_contracts(scanned)
    assert cleaned.require_no_conflicts().rows.count() == 110
    assert clean.clean_diagnostics(cleaned).first().exact_duplicates_removed == 7
    write_archive(tmp_path / "b" / archive_name(day), rows + [{**rows[0], "bid_1545": "0.5000"}])
    with pytest.raises(ValueError, match="Conflicting duplicate"):
        clean.clean_contracts(vendor.scan_archives(vendor.discover(spark, str(tmp_path / "b")))).require_no_conflicts()


def test_coverage_statuses(spark):
    frame = spark.createDataFrame([(date(2020, 1, 6),), (date(2020, 1, 8),)], "quote_date date")
    def status(a, b):
        return audit.window_coverage(frame, date(2020, 1, a), date(2020, 1, b)).first()

    assert status(6, 8).coverage_status == "exact"
    row = status(2, 10)
    assert row.coverage_status == "short_both"
    assert (row.missing_prefix_start, row.missing_prefix_end) == (date(2020, 1, 2), date(2020, 1, 5))
    assert (row.missing_suffix_start, row.missing_suffix_end) == (date(2020, 1, 9), date(2020, 1, 10))
    assert status(2, 8).coverage_status == "short_prefix" and status(6, 9).coverage_status == "short_suffix"
    assert status(7, 8).coverage_status == "mismatch"
    with pytest.raises(ValueError, match="short_prefix"):
        audit.require_exact_coverage(audit.window_coverage(frame, date(2020, 1, 2), date(2020, 1, 8)))


def test_early_close_calendar(spark, tmp_path):
    days = early_close.early_close_dates()
    assert len(days) == 65 and early_close.coverage(days) == (date(2004, 1, 1), date(2026, 12, 31))
    with pytest.raises(ValueError):
        early_close.validate_calendar([])
    with pytest.raises(ValueError):
        early_close.validate_calendar([days[0], days[0]])
    early_close.calendar_frame(spark).write.option("header", True).csv(str(tmp_path / "c"))
    assert early_close.read_calendar(spark, str(tmp_path / "c")) == days
    frame = spark.createDataFrame([(date(2020, 11, 1), date(2020, 12, 31))], "a date, b date")
    got = frame.select(early_close.early_closes_between(F.col("a"), F.col("b")).alias("d")).first().d
    assert got == [date(2020, 11, 27), date(2020, 12, 24)]
    with pytest.raises(Exception, match="outside the early-close calendar"):
        spark.createDataFrame([(date(2003, 1, 2),)], "d date").select(early_close.is_early_close("d")).collect()


def test_underlying_key(spark):
    frame = spark.createDataFrame([("^SPX",), ("BRK.B",), ("^^",)], "s string")
    assert [r.k for r in frame.select(audit.underlying_key(F.col("s")).alias("k")).collect()] == ["spx", "brkb", "unknown"]


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [(date(2020, 1, 2), 1.0), (date(2020, 1, 3), 2.0), (date(2020, 1, 3), 3.0)]
    frame = spark.createDataFrame(rows, "quote_date date, v double")
    with pytest.raises(ValueError, match="empty"):
        partitions.write_date_partitions(frame.limit(0), path)
    partitions.write_date_partitions(frame, path)
    data = partitions.read_partitions(spark, path)
    index = {r.quote_date: (r.row_count, r.checksum) for r in partitions.partition_index(data).collect()}
    assert {d: n for d, (n, _) in index.items()} == {date(2020, 1, 2): 1, date(2020, 1, 3): 2}
    assert partitions.partition_index(data, by_file=True).count() >= 2
    assert partitions.load_date(data, "2020-01-03").count() == 2
    assert partitions.load_dates(data, ["2020-01-02", date(2020, 1, 3)]).count() == 3
    with pytest.raises(FileNotFoundError, match="2020-01-06"):
        partitions.load_date(data, date(2020, 1, 6))
    with pytest.raises(ValueError):
        partitions.load_dates(data, [])
    # Only the partitions of the written dates are replaced.
    partitions.write_date_partitions(spark.createDataFrame([(date(2020, 1, 3), 9.0)], "quote_date date, v double"), path)
    again = partitions.read_partitions(spark, path)
    assert sorted(r.v for r in again.collect()) == [1.0, 9.0]
    new = {r.quote_date: r.checksum for r in partitions.partition_index(again).collect()}
    assert new[date(2020, 1, 2)] == index[date(2020, 1, 2)][1] and new[date(2020, 1, 3)] != index[date(2020, 1, 3)][1]
    plan = again.where(F.col("quote_date") == date(2020, 1, 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quote_date" in plan


def test_yearly_folders(spark, tmp_path):
    rows = [(date(2019, 12, 31), 1.0), (date(2020, 1, 2), 2.0)]
    partitions.write_date_partitions(spark.createDataFrame(rows, "quote_date date, v double"), str(tmp_path / "y"), ("year",))
    assert sorted(p.name for p in (tmp_path / "y").glob("year=*")) == ["year=2019", "year=2020"]
    assert partitions.scan_parquet(spark, str(tmp_path / "y")).count() == 2


def test_result_sink_keeps_schema_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, b double")
    partitions.write_result(empty, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).schema == empty.schema
    with pytest.raises(ValueError):
        partitions.write_result(empty, str(tmp_path / "x"), "csv")


def test_streaming_ingest_is_incremental_and_idempotent(spark, tmp_path):
    raw, out, offsets = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "offsets")
    days = business_days(3)
    for i, day in enumerate(days[:2]):
        write_archive(raw / archive_name(day), day_quotes(day, i, ("SPX", "SPXW")))

    def run(checkpoint=offsets):
        start_ingest(spark, str(raw), out, checkpoint, "^SPX", "SPX").awaitTermination()
        return {r.quote_date: r["count"] for r in spark.read.parquet(out).groupBy("quote_date").count().collect()}

    assert run() == {days[0]: 110, days[1]: 110}
    write_archive(raw / archive_name(days[2]), day_quotes(days[2], 2))
    assert run() == {d: 110 for d in days}
    assert run() == {d: 110 for d in days}
    # A replay from scratch rewrites the same partitions.
    assert run(str(tmp_path / "offsets2")) == {d: 110 for d in days}
    batch = clean.clean_contracts(vendor.ingest(vendor.discover(spark, str(raw)), "^SPX", "SPX").drop("option_root")).rows
    streamed = spark.read.parquet(out).select("quote_date", "expiration", "strike", "option_type", "mid_1545", "tau")
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
    assert zipfile.is_zipfile(raw / archive_name(days[0]))


def streamed(spark, frames, out, offsets, key):
    """Bring frames as one micro-batch each."""
    source = offsets + "-in"
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    start_clean_sink(stream, out, offsets, early_closes=[], key=key).awaitTermination()


def test_a_date_in_several_batches_keeps_all_rows(spark, tmp_path):
    day = business_days(1)[0]
    write_archive(tmp_path / "raw" / archive_name(day), day_quotes(day, 0, ("SPX", "SPXW")))
    quotes = vendor.scan_archives(vendor.discover(spark, str(tmp_path / "raw"))).drop("source_file", "trade_date").persist()
    calls, puts = quotes.where("option_type = 'C'"), quotes.where("option_type = 'P'")
    out = str(tmp_path / "out")
    streamed(spark, [calls, puts, calls], out, str(tmp_path / "o1"), CONTRACT_KEY)
    held = spark.read.parquet(out)
    assert held.count() == quotes.count() == held.select(*CONTRACT_KEY).distinct().count()
    assert {r["option_root"] for r in held.select("option_root").distinct().collect()} == {"SPX", "SPXW"}
    # A replay of everything changes nothing; a contradicting row of a later batch is an error.
    streamed(spark, [quotes], out, str(tmp_path / "o2"), CONTRACT_KEY)
    assert spark.read.parquet(out).count() == quotes.count()
    other = quotes.limit(1).withColumn("bid_1545", F.col("bid_1545") * 0.99)
    with pytest.raises(Exception, match="Conflicting duplicate"):
        streamed(spark, [other], out, str(tmp_path / "o3"), CONTRACT_KEY)
    assert spark.read.parquet(out).count() == quotes.count()


def test_roots_and_underlyings_share_an_output(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    day = business_days(1)[0]
    write_archive(raw / archive_name(day), day_quotes(day, 0, ("SPX", "SPXW")))
    for root in ("SPX", "SPXW"):
        start_ingest(spark, str(raw), out, str(tmp_path / root), "^SPX", root).awaitTermination()
    assert {r["option_root"]: r["count"] for r in spark.read.parquet(out).groupBy("option_root").count().collect()} == {"SPX": 110, "SPXW": 110}
    held = spark.read.parquet(out)
    partitions.merge_date_partitions(held.withColumn("underlying_symbol", F.lit("^XYZ")), out, lambda rows: rows)
    assert {r["underlying_symbol"]: r["count"] for r in spark.read.parquet(out).groupBy("underlying_symbol").count().collect()} == {"^SPX": 220, "^XYZ": 220}


def test_repeated_dates_are_noticed(spark):
    rows = spark.createDataFrame([(date(2020, 1, 2), 1), (date(2020, 1, 2), 2), (date(2020, 1, 3), 3)], "quote_date date, row_count int")
    assert [r["quote_date"] for r in partitions.repeated_partitions(rows).collect()] == [date(2020, 1, 2)]
    with pytest.raises(ValueError, match="twice"):
        partitions.load_dates(rows, ["2020-01-02", date(2020, 1, 2)])
