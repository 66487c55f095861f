"""Registered queries through storage and streams: partition round trip, partition index, streamed nodes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from volpanel.plans.adapters import QUALITY_SQL, QUOTES_SQL, UNDERLYING, quote_columns, quotes
from volpanel.plans.registry import register
from volpanel.plans.shape import joined, rounded
from volpanel.session import list_names, scratch_path, set_times_by_name
from volpanel.sources import archive_source, partitions, snapshots, vendor
from volpanel.streaming import ingest
from volpanel.streaming import nodes as stream

MONTH_SQL = "CAST(date_trunc('month', quote_date) AS DATE)"


def monthly_dataset(spark, sf_dir):
    """All quotes written by month and read back."""
    path = scratch_path(spark, "quotes")
    month = F.trunc("quote_date", "month")
    partitions.write_date_partitions(quotes(spark, sf_dir).withColumn("quote_date", month), path)
    return partitions.read_partitions(spark, path)


@register(
    "partition_round_trip",
    "SNK1 SNK3 SRC6 SRC7",
    "WITH" + QUOTES_SQL + f"""SELECT {MONTH_SQL} AS quote_date, CAST(year(quote_date) AS INT) AS year, root, CAST(count(*) AS BIGINT) AS rows,
       round(sum(bid_1545), 6) AS bid_total FROM quotes GROUP BY 1, 2, 3""",
)
def partition_round_trip(spark, sf_dir):
    totals = monthly_dataset(spark, sf_dir).groupBy("quote_date", "year", "root").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("bid_1545").alias("bid_total")
    )
    return rounded(totals, 6, "bid_total")


@register(
    "partition_dates",
    "SRC7",
    "WITH" + QUOTES_SQL + f"""SELECT {MONTH_SQL} AS quote_date, CAST(count(*) AS BIGINT) AS rows FROM quotes
WHERE {MONTH_SQL} IN (DATE '1997-03-01', DATE '1999-11-01') GROUP BY 1""",
)
def partition_dates(spark, sf_dir):
    rows = partitions.load_dates(monthly_dataset(spark, sf_dir), ["1997-03-01", "1999-11-01"])
    return rows.groupBy("quote_date").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "partition_index",
    "SNK2",
    "WITH" + QUOTES_SQL + f"""SELECT {MONTH_SQL} AS quote_date, CAST(year(quote_date) AS INT) AS year, CAST(count(*) AS BIGINT) AS row_count FROM quotes GROUP BY 1, 2""",
)
def partition_index(spark, sf_dir):
    return partitions.partition_index(monthly_dataset(spark, sf_dir)).select("quote_date", "year", "row_count")


@register(
    "committed_dates",
    "SNK1 SNK2 SRC7",
    "WITH" + QUOTES_SQL + f""", monthly AS (SELECT * REPLACE ({MONTH_SQL} AS quote_date) FROM quotes)
SELECT quote_date, root, CAST(count(*) AS BIGINT) AS rows, round(sum(bid_1545), 6) AS bid_total FROM monthly
WHERE year(quote_date) <> 1996 OR root <> 'R' GROUP BY 1, 2""",
)
def committed_dates(spark, sf_dir):
    """Months committed in two steps and one year of them replaced; a third writer stops before its commit and leaves no trace."""
    path = scratch_path(spark, "snapshots")
    rows = quotes(spark, sf_dir).withColumn("quote_date", F.trunc("quote_date", "month"))
    early = F.year("quote_date") < 1996
    snapshots.commit(rows.where(early), path)
    snapshots.commit(rows.where(~early), path)
    snapshots.commit(rows.where((F.year("quote_date") == 1996) & (F.col("root") != "R")), path)
    snapshots.stage_rows(rows.where("root = 'A'"), path)
    totals = snapshots.load(spark, path, verify=True).groupBy("quote_date", "root").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("bid_1545").alias("bid_total")
    )
    return rounded(totals, 6, "bid_total")


@register(
    "result_files",
    "SNK4",
    "WITH" + QUOTES_SQL + "SELECT root, option_type, CAST(count(*) AS BIGINT) AS rows FROM quotes GROUP BY 1, 2",
)
def result_files(spark, sf_dir):
    path = scratch_path(spark, "result")
    counts = quotes(spark, sf_dir).groupBy("root", "option_type").agg(F.count(F.lit(1)).alias("rows"))
    partitions.write_result(counts, path, "json")
    return spark.read.schema(counts.schema).json(path)


COLLAPSE_SQL = QUOTES_SQL + """,
unique_quotes AS (SELECT DISTINCT l_orderkey, l_linenumber, quote_date, root, expiration, strike, implied_volatility_1545, vega_1545, trade_volume,
                  open_interest, bid_1545 FROM quotes)
"""


#: Fewest files of the quote stream, most rows of a file unless one day has more, and files that a micro-batch takes.
#: A micro-batch has so many rows at most, so what the stream holds as state does not grow with the table.
ARRIVALS, ARRIVAL_ROWS, PER_BATCH = 32, 1_000_000, 8
#: What the quotes of a stream are made of. Rows that are equal in these are equal in all columns.
QUOTE_KEY = ("quote_ts", "l_orderkey", "l_linenumber", "root", "strike", "implied_volatility_1545", "open_interest", "bid_1545")


def quote_stream(spark, sf_dir):
    """The quotes as a stream of files in order of their dates, every row sent twice; columns are those of ``QUOTE_KEY``.

    One range-partitioned write; files then get times in that order, as a file stream takes the oldest first. Rows
    without a date come first.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_partkey", "l_extendedprice"
    )
    arrivals = scratch_path(spark, "arrivals")
    files = max(ARRIVALS, -(-lines.count() // ARRIVAL_ROWS))
    lines.repartitionByRange(files, "l_shipdate").write.parquet(arrivals)
    set_times_by_name(spark, arrivals)
    raw = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", PER_BATCH).parquet(arrivals)
    rows = raw.select(
        F.timestamp_seconds(F.unix_date(F.to_date("l_shipdate")) * F.lit(86400)).alias("quote_ts"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("root"),
        F.col("l_quantity").alias("strike"),
        F.col("l_discount").alias("implied_volatility_1545"),
        F.col("l_partkey").alias("open_interest"),
        (F.col("l_extendedprice") / 1000.0).alias("bid_1545"),
    )
    # Files are read once for both.
    return rows.withColumn("sent", F.explode(F.array(F.lit(1), F.lit(2)))).drop("sent")


def streamed_nodes(spark, sf_dir):
    unique = stream.unique_quotes(quote_stream(spark, sf_dir), "quote_ts", QUOTE_KEY, "7 days")
    # The other columns follow from the key, so they need no part in the state.
    date = F.date_from_unix_date(F.floor(F.unix_seconds("quote_ts") / 86400).cast("int"))
    quoted = unique.select(
        "quote_ts",
        "root",
        F.date_add(date, F.col("l_linenumber") * 125 - 120).alias("expiration"),
        "strike",
        "implied_volatility_1545",
        (F.col("strike") / 10.0).alias("vega_1545"),
        F.col("strike").cast("bigint").alias("trade_volume"),
    )
    out = scratch_path(spark, "nodes")
    late = stream.LateRows(spark)
    try:
        query = stream.start_parts_sink(quoted, "quote_ts", out, scratch_path(spark, "offsets"))
        query.awaitTermination()
        late.require_none(query)
    finally:
        late.close()
    return stream.merged_nodes(spark.read.parquet(out))


@register(
    "stream_nodes",
    "STR2",
    "WITH" + COLLAPSE_SQL + """SELECT quote_date, root, expiration, strike, round(sum(vega_1545), 6) AS node_vega,
       CAST(sum(trade_volume) AS BIGINT) AS trade_volume, CAST(count(*) AS BIGINT) AS collapsed_contract_count,
       round(sum(implied_volatility_1545*vega_1545)/sum(vega_1545), 8) AS node_iv FROM unique_quotes GROUP BY 1, 2, 3, 4""",
)
def stream_nodes(spark, sf_dir):
    return rounded(rounded(streamed_nodes(spark, sf_dir), 6, "node_vega"), 8, "node_iv")


@register(
    "stream_date_quality",
    "STR2",
    "WITH" + COLLAPSE_SQL + """SELECT quote_date, CAST(count(DISTINCT (root, expiration, strike)) AS BIGINT) AS surface_node_count,
       CAST(count(DISTINCT expiration) AS BIGINT) AS valid_expiry_count, CAST(count(DISTINCT root) AS BIGINT) AS root_count
FROM unique_quotes GROUP BY 1""",
)
def stream_date_quality(spark, sf_dir):
    return stream.node_quality(streamed_nodes(spark, sf_dir))


CLOSES = (dt.date(1995, 7, 3), dt.date(1998, 12, 24), dt.date(2001, 12, 24))


@register(
    "stream_ingest",
    "STR1 SNK1",
    "WITH" + QUOTES_SQL + f""",
monthly AS (SELECT * REPLACE ({MONTH_SQL} AS quote_date) FROM quotes),
kept AS (SELECT DISTINCT l_orderkey, l_linenumber, quote_date, root, expiration, strike, option_type, bid_1545, ask_1545, implied_volatility_1545,
                vega_1545, active_underlying_price_1545, trade_volume, open_interest, underlying_bid_1545, underlying_ask_1545
         FROM monthly WHERE {QUALITY_SQL})
SELECT quote_date, root, CAST(count(*) AS BIGINT) AS rows, CAST(sum(trade_volume) AS BIGINT) AS trade_volume,
       round(sum(((expiration - quote_date)*86400 + 34200 - 56700)/31536000.0e0), 6) AS tau_total FROM kept GROUP BY 1, 2""",
)
def stream_ingest(spark, sf_dir):
    """The quotes arrive in four micro-batches of files, with every row sent twice, and land clean, by month.

    Every month arrives in every batch, so each batch must add to what the earlier ones left.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    split = scratch_path(spark, "arrivals")
    # Sixteen files or more, so that a quarter of them, rounded up, leaves four batches.
    lines.write.option("maxRecordsPerFile", -(-lines.count() // 16)).parquet(split)
    files = sum(name.endswith(".parquet") for name in list_names(spark, split))
    raw = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(split)
    rows = quote_columns(raw).withColumn("quote_date", F.trunc("quote_date", "month"))
    out = scratch_path(spark, "ingested")
    ingest.start_clean_sink(
        rows.union(rows), out, scratch_path(spark, "offsets"), early_closes=list(CLOSES), key=tuple(rows.columns)
    ).awaitTermination()
    return rounded(
        partitions.read_partitions(spark, out).groupBy("quote_date", "root").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("trade_volume").alias("trade_volume"), F.sum("tau").alias("tau_total")
        ),
        6,
        "tau_total",
    )


# --- archives ---------------------------------------------------------------------------------

ARCHIVE_COLUMNS = (
    "underlying_symbol", "quote_date", "root", "expiration", "strike", "option_type", "bid_1545", "ask_1545",
    "active_underlying_price_1545", "implied_volatility_1545", "delta_1545", "vega_1545", "trade_volume", "open_interest",
)


#: Most rows of an archive; a month with more has several.
ARCHIVE_ROWS = 200_000
#: Rows without a date lie in archives of this one.
NO_DATE = dt.date(1000, 1, 1)


def archive_folder(spark, sf_dir):
    """All quotes in real archives below a shared folder, named by month; several archives may share a month.

    Rows go to tasks by ranges of month and a hash of their keys, so tasks grow in number with the rows, a month of any
    size is spread, and a task has few months. A place (task and number) and the order of rows tell the content, so a
    task that runs again writes the same files, and equal archives of two tasks stay two.
    """
    folder = scratch_path(spark, "archives")

    def write(batches):
        import hashlib
        import io
        import itertools
        import zipfile

        import pyarrow as pa
        from pyarrow import csv, fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        task, numbers = TaskContext.get().partitionId(), itertools.count()
        noted = {"month": pa.date32(), "place": pa.string(), "rows": pa.int64(), "bytes": pa.int64(), "digest": pa.string()}
        months = {}

        def parts():
            """Slices of one month each, without the month column."""
            for batch in batches:
                month = batch.column("month").to_pylist()
                starts = [0, *[i for i in range(1, len(month)) if month[i] != month[i - 1]], len(month)]
                for first, end in zip(starts, starts[1:]):
                    if end > first:
                        yield month[first], batch.slice(first, end - first).select(ARCHIVE_COLUMNS)

        def put(month, pieces):
            blob = io.BytesIO()
            # ZipInfo has a constant date, so equal rows give equal bytes.
            with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                member = zipfile.ZipInfo("quotes.csv")
                member.compress_type = zipfile.ZIP_DEFLATED
                with archive.open(member, "w") as sink, csv.CSVWriter(sink, pieces[0].schema) as out:
                    for piece in pieces:
                        out.write(piece)
            content = blob.getvalue()
            place = f"{task}/{next(numbers)}"
            system.create_dir(f"{base}/{place}")
            with system.open_output_stream(f"{base}/{place}/UnderlyingOptionsEODCalcs_{month}.zip") as sink:
                sink.write(content)
            values = [month, place, sum(p.num_rows for p in pieces), len(content), hashlib.sha256(content).hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, noted.values())], names=list(noted))

        held, rows = [], 0
        current = None
        for month, piece in parts():
            if held and (month != current or rows + piece.num_rows > ARCHIVE_ROWS):
                yield put(current, held)
                held, rows = [], 0
            current = month
            held.append(piece)
            rows += piece.num_rows
        if held:
            yield put(current, held)

    rows = quotes(spark, sf_dir).withColumn("delta_1545", F.when(F.col("option_type") == "C", 0.5).otherwise(-0.5))
    month = F.coalesce(F.trunc("quote_date", "month"), F.lit(NO_DATE)).alias("month")
    monthly = rows.select(month, F.xxhash64("l_orderkey", "l_linenumber").alias("deal"), *ARCHIVE_COLUMNS)
    dealt = monthly.repartitionByRange("month", "deal").sortWithinPartitions("month", "deal", *ARCHIVE_COLUMNS)
    written = dealt.drop("deal").mapInArrow(write, "month date, place string, rows bigint, bytes bigint, digest string")
    noted = scratch_path(spark, "archives-noted")
    written.write.parquet(noted)
    return folder, spark.read.parquet(noted)


def place_of(path):
    """Task and number of an archive, out of its path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2))


ARCHIVE_WINDOW = (dt.date(1996, 1, 1), dt.date(1997, 12, 1))


@register(
    "archive_scan",
    "SRC4 SRC5",
    "WITH" + QUOTES_SQL + """SELECT quote_date, root, option_type, CAST(count(*) AS BIGINT) AS rows, CAST(sum(trade_volume) AS BIGINT) AS trade_volume,
       round(sum(bid_1545), 6) AS bid_total, round(sum(vega_1545), 6) AS vega_total, min(expiration) AS first_expiration
FROM quotes GROUP BY 1, 2, 3""",
)
def archive_scan(spark, sf_dir):
    folder, _ = archive_folder(spark, sf_dir)
    columns = ("quote_date", "root", "option_type", "trade_volume", "bid_1545", "vega_1545", "expiration")
    rows = archive_source.read_archives(spark, folder, columns)
    totals = rows.groupBy("quote_date", "root", "option_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("trade_volume").alias("trade_volume"),
        F.sum("bid_1545").alias("bid_total"),
        F.sum("vega_1545").alias("vega_total"),
        F.min("expiration").alias("first_expiration"),
    )
    return rounded(totals, 6, "bid_total", "vega_total")


@register(
    "archive_ingest",
    "SRC5",
    "WITH" + QUOTES_SQL + f"""SELECT {MONTH_SQL} AS trade_date, option_type, root AS option_root, CAST(count(*) AS BIGINT) AS rows,
       round(sum(strike), 6) AS strike_total FROM quotes
WHERE root = 'R' AND {MONTH_SQL} BETWEEN DATE '{ARCHIVE_WINDOW[0]}' AND DATE '{ARCHIVE_WINDOW[1]}' GROUP BY 1, 2, 3""",
)
def archive_ingest(spark, sf_dir):
    """The archives of a window, one underlying and root; dates and codes are decided inside the source."""
    folder, _ = archive_folder(spark, sf_dir)
    rows = vendor.ingest_window(
        spark, folder, *ARCHIVE_WINDOW, UNDERLYING, "R", scratch_path(spark, "ingested-window"), ("option_type", "strike")
    )
    totals = rows.groupBy("trade_date", "option_type", "option_root").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("strike").alias("strike_total")
    )
    return rounded(totals, 6, "strike_total")


@register(
    "archive_inventory",
    "SRC3",
    "WITH" + QUOTES_SQL + f"""SELECT {MONTH_SQL} AS trade_date, CAST(count(*) AS BIGINT) AS rows, 'quotes.csv' AS member_names, true AS one_member_each,
       true AS all_readable, true AS hashes_match, true AS sizes_match FROM quotes GROUP BY 1""",
)
def archive_inventory(spark, sf_dir):
    """Per date: members, hashes and sizes of the archives against those noted when they were written, and the rows in them."""
    folder, noted = archive_folder(spark, sf_dir)
    files = vendor.discover(spark, folder)
    listed = vendor.inventory(files).withColumn("place", place_of("file_path"))
    rows = archive_source.read_archives(spark, folder, ("source_file",)).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.select(place_of("source_file").alias("place"), "rows")
    named = noted.select("place", "digest", "bytes", F.col("month").alias("trade_date"))
    met = named.join(listed, ["place", "trade_date"], "full").join(rows, "place", "full")
    met = met.withColumn("trade_date", F.nullif("trade_date", F.lit(NO_DATE)))
    return met.groupBy("trade_date").agg(
        F.sum("rows").alias("rows"),
        joined(F.array_sort(F.collect_set("csv_member_name"))).alias("member_names"),
        F.coalesce(F.bool_and(F.col("csv_member_count") == 1), F.lit(False)).alias("one_member_each"),
        F.coalesce(F.bool_and("readable"), F.lit(False)).alias("all_readable"),
        F.coalesce(F.bool_and(F.col("sha256") == F.col("digest")), F.lit(False)).alias("hashes_match"),
        F.coalesce(F.bool_and(F.col("file_size") == F.col("bytes")), F.lit(False)).alias("sizes_match"),
    )
