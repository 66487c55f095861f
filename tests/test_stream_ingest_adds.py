"""What a later batch moves of a dataset that holds rows already."""

from pathlib import Path

from corpus import archive_name, business_days, day_quotes, write_archive
from pyspark.sql import functions as F
from test_sources import streamed

from volpanel.operators import clean
from volpanel.operators.keys import CONTRACT_KEY
from volpanel.sources import vendor


def test_a_later_batch_leaves_held_files_alone(spark, tmp_path):
    day = business_days(1)[0]
    write_archive(tmp_path / "raw" / archive_name(day), day_quotes(day, 0))
    quotes = vendor.scan_archives(vendor.discover(spark, str(tmp_path / "raw"))).drop("source_file", "trade_date").persist()
    calls, puts = quotes.where("option_type = 'C'"), quotes.where("option_type = 'P'")
    out = str(tmp_path / "out")
    streamed(spark, [calls.union(calls)], out, str(tmp_path / "o1"), CONTRACT_KEY)
    held = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    # New rows come with copies of held ones.
    streamed(spark, [puts.union(calls.limit(7)).union(puts)], out, str(tmp_path / "o2"), CONTRACT_KEY)
    assert held and all(p.exists() and p.stat().st_mtime_ns == t for p, t in held.items())
    rows = spark.read.parquet(out)
    assert rows.count() == quotes.count() == rows.select(*CONTRACT_KEY).distinct().count()
    plain = clean.clean_contracts(quotes, []).rows.drop("copies")
    assert set(rows.columns) == {*plain.columns, "year"}
    assert rows.select(*plain.columns).exceptAll(plain).isEmpty()
    assert rows.where(F.col("tau").isNull() | F.col("mid_1545").isNull()).isEmpty()
