"""Registered queries over row-level quotes and file headers: filters, duplicates and the audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from volpanel.operators import audit, clean
from volpanel.plans.adapters import (
    DOCUMENTED_HEADER,
    HEADERS_SQL,
    QUALITY_SQL,
    QUOTES_SQL,
    REQUIRED_HEADER,
    headers,
    quotes,
    table,
)
from volpanel.plans.registry import register
from volpanel.plans.shape import joined, rounded
from volpanel.sources.early_close import EARLY_CLOSES, early_closes_between, is_early_close

CLOSES_SQL = ", ".join(f"DATE '{d}'" for d in EARLY_CLOSES.split())
KEY = ("l_orderkey", "l_linenumber")


@register(
    "study_filter",
    "PRJ1 SRC6",
    "WITH" + QUOTES_SQL + """
SELECT l_orderkey, quote_date, strike FROM quotes WHERE underlying_symbol = '^IDX' AND root = 'R'""",
)
def study_filter(spark, sf_dir):
    return clean.study_filter(quotes(spark, sf_dir), "^IDX", "R").select("l_orderkey", "quote_date", "strike")


@register(
    "quality_filter",
    "PRJ2 PRJ3 PRJ4",
    "WITH" + QUOTES_SQL + f"""
SELECT l_orderkey, l_linenumber, CAST(expiration - quote_date AS INT) AS dte_days,
       round(0.5e0*(bid_1545 + ask_1545), 8) AS mid_1545, round(ask_1545 - bid_1545, 8) AS spread_1545,
       round((ask_1545 - bid_1545)/greatest(0.5e0*(bid_1545 + ask_1545), 1.0e-6), 8) AS rel_spread_1545
FROM quotes WHERE {QUALITY_SQL}""",
)
def quality_filter(spark, sf_dir):
    kept = clean.with_quote_columns(clean.quality_filter(quotes(spark, sf_dir)))
    columns = ("mid_1545", "spread_1545", "rel_spread_1545")
    return rounded(kept.select(*KEY, "dte_days", *columns), 8, *columns)


@register(
    "quality_reject_counts",
    "PRJ2",
    "WITH" + QUOTES_SQL + """
SELECT root, CASE WHEN NOT option_type IN ('C','P') THEN 'option_type' WHEN NOT strike > 0 THEN 'strike'
       WHEN NOT quote_date < expiration THEN 'expired' WHEN NOT expiration - quote_date >= 10 THEN 'min_dte'
       WHEN NOT expiration - quote_date <= 730 THEN 'max_dte' WHEN NOT bid_1545 > 0 THEN 'bid'
       WHEN NOT ask_1545 > 0 THEN 'ask' WHEN NOT ask_1545 >= bid_1545 THEN 'crossed'
       WHEN NOT implied_volatility_1545 > 0 THEN 'implied_volatility' WHEN NOT vega_1545 > 0 THEN 'vega'
       WHEN NOT active_underlying_price_1545 > 0 THEN 'underlying_price' ELSE 'passed' END AS first_failed,
       CAST(count(*) AS BIGINT) AS rows
FROM quotes GROUP BY 1, 2""",
)
def quality_reject_counts(spark, sf_dir):
    return clean.reject_counts(quotes(spark, sf_dir))


SHIFTED_SQL = QUOTES_SQL + """,
shifted AS (
  SELECT l_orderkey, l_linenumber, CAST(quote_date + INTERVAL 10 YEAR AS DATE) AS quote_date,
         CAST(quote_date + INTERVAL 10 YEAR AS DATE) + CAST(expiration - quote_date AS INT) AS expiration
  FROM quotes)
"""


def shifted_quotes(spark, sf_dir):
    """Quotes moved forward ten years, into the years the early-close calendar covers."""
    moved = F.add_months("quote_date", 120)
    return quotes(spark, sf_dir).select(
        *KEY,
        moved.alias("quote_date"),
        F.date_add(moved, F.datediff("expiration", "quote_date")).alias("expiration"),
    )


@register(
    "settlement_year_fraction",
    "PRJ5 PRJ6 SRC8",
    "WITH" + SHIFTED_SQL + f"""
SELECT l_orderkey, l_linenumber, quote_date IN ({CLOSES_SQL}) AS is_early_close,
       round(((expiration - quote_date)*86400 + 34200
              - CASE WHEN quote_date IN ({CLOSES_SQL}) THEN 45900 ELSE 56700 END)/31536000.0e0, 10) AS tau
FROM shifted""",
)
def settlement_year_fraction(spark, sf_dir):
    rows = shifted_quotes(spark, sf_dir).withColumn("is_early_close", is_early_close("quote_date"))
    rows = rows.withColumn("tau", clean.year_fraction(F.col("is_early_close")))
    return rounded(rows.select(*KEY, "is_early_close", "tau"), 10, "tau")


@register(
    "early_closes_in_range",
    "JON16 SRC8",
    "WITH" + SHIFTED_SQL + f"""
SELECT s.l_orderkey, string_agg(CAST(c.d AS VARCHAR), ',' ORDER BY c.d) AS early_closes
FROM (SELECT l_orderkey, min(quote_date) AS lo, max(expiration) AS hi FROM shifted GROUP BY 1) s
JOIN (SELECT unnest([{CLOSES_SQL}]) AS d) c ON c.d BETWEEN s.lo AND s.hi GROUP BY 1""",
)
def early_closes_in_range(spark, sf_dir):
    windows = shifted_quotes(spark, sf_dir).groupBy("l_orderkey").agg(
        F.min("quote_date").alias("lo"), F.max("expiration").alias("hi")
    )
    listed = windows.withColumn("entries", early_closes_between(F.col("lo"), F.col("hi")))
    text = joined(F.transform("entries", lambda d: d.cast("string")))
    return listed.where(F.size("entries") > 0).select("l_orderkey", text.alias("early_closes"))


COPIED_SQL = QUOTES_SQL + """,
copied AS (SELECT * FROM quotes UNION ALL SELECT * FROM quotes),
deduped AS (SELECT *, 1 AS one FROM (SELECT DISTINCT * FROM copied))
"""


def copied_quotes(spark, sf_dir):
    """Every quote twice: exact copies next to the natural conflicts of the key."""
    rows = quotes(spark, sf_dir)
    return rows.unionByName(rows)


@register(
    "duplicate_policy",
    "PRJ8",
    "WITH" + COPIED_SQL + """
SELECT l_orderkey, l_linenumber, strike, quote_date, root, option_type, round(bid_1545, 8) AS bid_1545 FROM deduped""",
)
def duplicate_policy(spark, sf_dir):
    kept = clean.deduplicate(copied_quotes(spark, sf_dir), KEY).rows
    return rounded(kept.select(*KEY, "strike", "quote_date", "root", "option_type", "bid_1545"), 8, "bid_1545")


@register(
    "duplicate_conflicts",
    "PRJ8",
    "WITH" + COPIED_SQL + """
SELECT d.l_orderkey, d.l_linenumber, d.variants, c.rows FROM
  (SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS variants FROM deduped GROUP BY 1, 2 HAVING count(*) > 1) d
  JOIN (SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS rows FROM copied GROUP BY 1, 2) c
  USING (l_orderkey, l_linenumber)""",
)
def duplicate_conflicts(spark, sf_dir):
    return clean.deduplicate(copied_quotes(spark, sf_dir), KEY).conflicts


@register(
    "clean_diagnostics",
    "PRJ10",
    "WITH" + COPIED_SQL + f"""
SELECT root, CAST(count(*) AS BIGINT) AS rows_after_cleaning, CAST(count(DISTINCT quote_date) AS BIGINT) AS dates_after_cleaning,
       CAST(sum(n - 1) AS BIGINT) AS exact_duplicates_removed
FROM (SELECT columns(*), count(*) AS n FROM copied WHERE {QUALITY_SQL} GROUP BY ALL) GROUP BY 1""",
)
def clean_diagnostics(spark, sf_dir):
    kept = clean.quality_filter(copied_quotes(spark, sf_dir))
    return clean.clean_diagnostics(clean.deduplicate(kept, KEY), ("root",))


@register(
    "mixed_date_files",
    "PRJ9",
    "WITH" + QUOTES_SQL + """
SELECT l_orderkey AS source_file, min(quote_date) AS first_date, max(quote_date) AS last_date
FROM quotes GROUP BY 1 HAVING count(DISTINCT quote_date) > 1""",
)
def mixed_date_files(spark, sf_dir):
    return clean.mixed_date_files(quotes(spark, sf_dir).withColumnRenamed("l_orderkey", "source_file"))


# --- audit ------------------------------------------------------------------------------------

def reconciled_headers(spark, sf_dir):
    return audit.reconcile_headers(headers(spark, sf_dir), "header", REQUIRED_HEADER, DOCUMENTED_HEADER, ("view",))


RECONCILED_SQL = HEADERS_SQL + """,
reconciled AS (
  SELECT file_id, trade_date, header,
         list_sort([c for c in ['click','purchase','view'] if NOT list_contains(header, c)]) AS missing,
         list_sort([c for c in header if c NOT IN ('click','purchase','view','signup')]) AS extra
  FROM headers)
"""


@register(
    "schema_reconciliation",
    "PRJ11 SET3 JON7",
    "WITH" + RECONCILED_SQL + """
SELECT file_id, trade_date, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra,
       len(missing) = 0 AS pass_status FROM reconciled""",
)
def schema_reconciliation(spark, sf_dir):
    return reconciled_headers(spark, sf_dir).select(
        "file_id",
        "trade_date",
        joined("missing_required_columns").alias("missing"),
        joined("extra_columns").alias("extra"),
        "pass_status",
    )


@register(
    "header_anomalies",
    "PRJ12",
    "WITH" + RECONCILED_SQL + """
, first_file AS (SELECT array_to_string(header, ',') AS h FROM reconciled ORDER BY trade_date, file_id LIMIT 1)
SELECT file_id, trade_date, array_to_string(header, ',') <> (SELECT h FROM first_file) AS order_differs FROM reconciled
WHERE array_to_string(header, ',') <> (SELECT h FROM first_file) OR len(missing) > 0 OR len(extra) > 0""",
)
def header_anomalies(spark, sf_dir):
    odd = audit.header_anomalies(reconciled_headers(spark, sf_dir), ("trade_date", "file_id"))
    return odd.select("file_id", "trade_date", "order_differs")


@register(
    "column_sets",
    "SET2",
    "WITH" + RECONCILED_SQL + """
SELECT kind, column_name, CAST(count(*) AS BIGINT) AS files FROM (
  SELECT 'observed' AS kind, unnest(header) AS column_name FROM reconciled
  UNION ALL SELECT 'missing', unnest(missing) FROM reconciled
  UNION ALL SELECT 'extra', unnest(extra) FROM reconciled) GROUP BY 1, 2""",
)
def column_sets(spark, sf_dir):
    return audit.column_sets(reconciled_headers(spark, sf_dir))


@register(
    "shared_dates",
    "SET4 SET3",
    "WITH" + QUOTES_SQL + """
SELECT 'both' AS kind, CAST(count(*) AS BIGINT) AS dates FROM (
  SELECT quote_date FROM quotes WHERE root = 'R' INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders)
UNION ALL SELECT 'quotes_only', CAST(count(*) AS BIGINT) FROM (
  SELECT quote_date FROM quotes WHERE root = 'R' EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders)""",
)
def shared_dates(spark, sf_dir):
    quoted = quotes(spark, sf_dir).where("root = 'R'").select("quote_date").distinct()
    ordered = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("quote_date")).distinct()
    def counted(kind, df):
        return df.agg(F.count(F.lit(1)).alias("dates")).select(F.lit(kind).alias("kind"), "dates")

    return counted("both", quoted.intersect(ordered)).unionByName(counted("quotes_only", quoted.subtract(ordered)))


FILES_SQL = """
files AS (
  SELECT o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN '/raw' ELSE '/raw/' || CAST(year(o_orderdate) AS VARCHAR) END
         || '/UnderlyingOptionsEOD' || CASE WHEN o_orderstatus = 'O' THEN 'Quotes_' ELSE 'Calcs_' END
         || CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END
         || '.zip' AS path, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, o_orderkey
  FROM orders)
"""


def order_files(spark, sf_dir):
    """Orders written as vendor file paths: daily calcs, daily quotes and grouped archives."""
    day, status = F.to_date("o_orderdate"), F.col("o_orderstatus")
    folder = F.when(F.col("o_orderpriority").startswith("1"), "/raw").otherwise(
        F.concat(F.lit("/raw/"), F.year(day).cast("string"))
    )
    family = F.when(status == "O", "Quotes_").otherwise("Calcs_")
    stamp = F.when(status == "P", F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    path = F.concat(folder, F.lit("/UnderlyingOptionsEOD"), family, stamp, F.lit(".zip"))
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", path.alias("path"), day.alias("day"), F.lit("/raw").alias("root_dir")
    )
    return audit.with_file_columns(rows)


@register(
    "file_kinds",
    "SRC1 SRC2",
    "WITH" + FILES_SQL + """
SELECT o_custkey, CASE status WHEN 'O' THEN 'daily_quotes' WHEN 'F' THEN 'daily_calcs' ELSE 'grouped_calcs' END AS file_kind,
       CAST(count(*) AS BIGINT) AS files FROM files GROUP BY 1, 2""",
)
def file_kinds(spark, sf_dir):
    return audit.kind_counts(order_files(spark, sf_dir), ("o_custkey",))


@register(
    "corpus_layout",
    "PRJ15",
    "WITH" + FILES_SQL + """
SELECT o_custkey, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS daily_zip_count,
       CASE WHEN count(*) FILTER (status = 'F' AND path NOT LIKE '/raw/Und%') > 0 THEN 'nested_daily' ELSE 'flat_daily' END AS grouping_mode,
       coalesce(string_agg(DISTINCT CASE WHEN path LIKE '/raw/Und%' THEN '.' ELSE substr(path, 6, 4) END, ',') FILTER (status = 'F'), '') AS folders,
       CAST(count(DISTINCT path) FILTER (status = 'P') AS INT) AS grouped_archives
FROM files GROUP BY 1""".replace("'.' ELSE substr(path, 6, 4) END, ',')", "'.' ELSE substr(path, 6, 4) END, ',' ORDER BY CASE WHEN path LIKE '/raw/Und%' THEN '.' ELSE substr(path, 6, 4) END)"),
)
def corpus_layout(spark, sf_dir):
    layout = audit.corpus_layout(order_files(spark, sf_dir), ("o_custkey",))
    return layout.select(
        "o_custkey",
        "daily_zip_count",
        "grouping_mode",
        joined("relative_parent_directories").alias("folders"),
        F.size("unsupported_grouped_archives").alias("grouped_archives"),
    )


@register(
    "content_dates",
    "PRJ13 SRC1",
    "WITH" + FILES_SQL + """
SELECT f.o_orderkey, f.day AS trade_date, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date,
       CAST(count(*) FILTER (l_shipdate IS NULL) AS BIGINT) AS null_dates,
       min(CAST(l_shipdate AS DATE)) = f.day AND max(CAST(l_shipdate AS DATE)) = f.day AS quote_date_match
FROM files f JOIN lineitem ON l_orderkey = o_orderkey WHERE status <> 'P' GROUP BY 1, 2""",
)
def content_dates(spark, sf_dir):
    files = order_files(spark, sf_dir).where(F.col("trade_date").isNotNull()).select("o_orderkey", "trade_date")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("quote_date")
    )
    # Rows are combined per file before they meet the file table, so a huge file is one row there.
    return audit.content_date_report(files.join(audit.content_dates(rows, ("o_orderkey",)), "o_orderkey"))


@register(
    "window_coverage",
    "PRJ14",
    "WITH" + QUOTES_SQL + """,
bounds AS (SELECT l_orderkey, min(quote_date) AS observed_start, max(quote_date) AS observed_end FROM quotes GROUP BY 1)
SELECT l_orderkey, observed_start, observed_end,
       observed_start = DATE '1996-01-02' AND observed_end = DATE '2000-12-29' AS matches_requested_window,
       CASE WHEN observed_start = DATE '1996-01-02' AND observed_end = DATE '2000-12-29' THEN 'exact'
            WHEN observed_start > DATE '1996-01-02' AND observed_end < DATE '2000-12-29' THEN 'short_both'
            WHEN observed_start > DATE '1996-01-02' THEN 'short_prefix'
            WHEN observed_end < DATE '2000-12-29' THEN 'short_suffix' ELSE 'mismatch' END AS coverage_status,
       CASE WHEN observed_start > DATE '1996-01-02' THEN DATE '1996-01-02' END AS missing_prefix_start,
       CASE WHEN observed_start > DATE '1996-01-02' THEN observed_start - 1 END AS missing_prefix_end,
       CASE WHEN observed_end < DATE '2000-12-29' THEN observed_end + 1 END AS missing_suffix_start,
       CASE WHEN observed_end < DATE '2000-12-29' THEN DATE '2000-12-29' END AS missing_suffix_end
FROM bounds""",
)
def window_coverage(spark, sf_dir):
    return audit.window_coverage(quotes(spark, sf_dir), dt.date(1996, 1, 2), dt.date(2000, 12, 29), ("l_orderkey",))


NULL_COLUMNS = ("underlying_bid_1545", "underlying_ask_1545", "bid_1545")


@register(
    "null_rates",
    "AGG13",
    "WITH" + QUOTES_SQL + """,
per_file AS (
  SELECT quote_date, 1.0e0 - count(underlying_bid_1545)/CAST(count(*) AS DOUBLE) AS underlying_bid_1545,
         1.0e0 - count(underlying_ask_1545)/CAST(count(*) AS DOUBLE) AS underlying_ask_1545,
         1.0e0 - count(bid_1545)/CAST(count(*) AS DOUBLE) AS bid_1545
  FROM quotes GROUP BY 1),
long AS (UNPIVOT per_file ON underlying_bid_1545, underlying_ask_1545, bid_1545 INTO NAME column_name VALUE rate)
SELECT column_name, CAST(count(*) AS BIGINT) AS observed_file_count, round(min(rate), 8) AS min_null_rate,
       round(avg(rate), 8) AS mean_null_rate, round(max(rate), 8) AS max_null_rate FROM long GROUP BY 1""",
)
def null_rates(spark, sf_dir):
    rates = audit.null_rates(quotes(spark, sf_dir), ("quote_date",), NULL_COLUMNS)
    return rounded(rates, 8, "min_null_rate", "mean_null_rate", "max_null_rate")


@register(
    "type_frequencies",
    "AGG14",
    """
WITH text AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'view' THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
         WHEN event_type = 'click' THEN props ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS value, event_type
  FROM events),
typed AS (
  SELECT event_type, count(*) FILTER (TRY_CAST(user_id AS BIGINT) IS NULL) AS u,
         count(*) FILTER (TRY_CAST(value AS BIGINT) IS NULL) AS b, count(*) FILTER (TRY_CAST(value AS DATE) IS NULL) AS d
  FROM text GROUP BY 1)
SELECT column_name, type_name, CAST(count(*) AS BIGINT) AS files FROM (
  SELECT 'user_id' AS column_name, CASE WHEN u = 0 THEN 'bigint' ELSE 'string' END AS type_name FROM typed
  UNION ALL SELECT 'value', CASE WHEN b = 0 THEN 'bigint' WHEN d = 0 THEN 'date' ELSE 'string' END FROM typed)
GROUP BY 1, 2""",
)
def type_frequencies(spark, sf_dir):
    kind = F.col("event_type")
    text = table(spark, sf_dir, "events").select(
        "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        F.when(kind == "view", F.round("value").cast("bigint").cast("string"))
        .when(kind == "click", F.col("props"))
        .otherwise(F.to_date("ts").cast("string"))
        .alias("value"),
    )
    return audit.type_frequencies(text, ("event_type",), ("user_id", "value"))


@register(
    "underlying_caveats",
    "AGG15",
    "WITH" + QUOTES_SQL + """,
t AS (SELECT underlying_symbol, count(*) AS n,
             count(*) FILTER (underlying_bid_1545 IS NULL OR underlying_bid_1545 <= 0 OR underlying_ask_1545 IS NULL
                              OR underlying_ask_1545 <= 0) AS bad,
             count(*) FILTER (active_underlying_price_1545 > 0) AS pos, count(DISTINCT root) AS roots
      FROM quotes GROUP BY 1)
SELECT underlying_symbol, CAST(n AS BIGINT) AS selected_underlying_rows, CAST(bad AS BIGINT) AS zero_or_missing_underlying_bid_ask_rows,
       CAST(pos AS BIGINT) AS positive_active_underlying_price_rows, CAST(roots AS BIGINT) AS distinct_root_count,
       round(bad/CAST(n AS DOUBLE), 8) AS zero_or_missing_fraction, round(pos/CAST(n AS DOUBLE), 8) AS positive_fraction,
       pos = n AS active_underlying_price_usable FROM t""",
)
def underlying_caveats(spark, sf_dir):
    return rounded(audit.underlying_caveats(quotes(spark, sf_dir)), 8, "zero_or_missing_fraction", "positive_fraction")


@register(
    "root_row_counts",
    "AGG16",
    "WITH" + QUOTES_SQL + """
SELECT quote_date, root, CAST(count(*) AS BIGINT) AS rows FROM quotes
GROUP BY GROUPING SETS ((1, 2), (2), (1), ())""",
)
def root_row_counts(spark, sf_dir):
    return audit.root_row_counts(quotes(spark, sf_dir))


@register(
    "root_coverage_by_date",
    "AGG16",
    "WITH" + QUOTES_SQL + """
SELECT quote_date, CAST(count(DISTINCT root) AS BIGINT) AS root_count,
       CAST(count(*) FILTER (root = 'R') AS BIGINT) AS selected_root_rows, count(*) FILTER (root = 'R') > 0 AS selected_root_present
FROM quotes GROUP BY 1""",
)
def root_coverage_by_date(spark, sf_dir):
    return audit.root_coverage_by_date(quotes(spark, sf_dir), "R")


@register(
    "dates_missing_root",
    "SRC5 JON7",
    "WITH" + QUOTES_SQL + """
SELECT DISTINCT quote_date FROM quotes WHERE quote_date NOT IN (SELECT quote_date FROM quotes WHERE root = 'R')""",
)
def dates_missing_root(spark, sf_dir):
    return audit.dates_missing_root(quotes(spark, sf_dir), "R")
