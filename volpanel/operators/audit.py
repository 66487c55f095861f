"""Corpus audit: headers, null rates, types, coverage and layout, all as queries over files and rows."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.sources.schema import (
    CALCS_COLUMNS,
    DOCUMENTED_COLUMNS,
    REQUIRED_COLUMNS,
    header_report,
)

# Names of the daily and grouped vendor archives.
DAILY_CALCS = r"^UnderlyingOptionsEODCalcs_(\d{4}-\d{2}-\d{2})\.zip$"
DAILY_QUOTES = r"^UnderlyingOptionsEODQuotes_(\d{4}-\d{2}-\d{2})\.zip$"
GROUPED_CALCS = r"^UnderlyingOptionsEODCalcs_(\d{4}|\d{4}-\d{2})\.zip$"
GROUPED_QUOTES = r"^UnderlyingOptionsEODQuotes_(\d{4}|\d{4}-\d{2})\.zip$"


# --- names and layout -------------------------------------------------------------------------

def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_kind(name: Column) -> Column:
    """Which of the four archive families a file name belongs to; null for foreign files."""
    return (
        F.when(name.rlike(DAILY_CALCS), "daily_calcs")
        .when(name.rlike(DAILY_QUOTES), "daily_quotes")
        .when(name.rlike(GROUPED_CALCS), "grouped_calcs")
        .when(name.rlike(GROUPED_QUOTES), "grouped_quotes")
    )


def trade_date(name: Column) -> Column:
    """Date in a daily file name, null for grouped archives."""
    text = F.coalesce(
        F.nullif(F.regexp_extract(name, DAILY_CALCS, 1), F.lit("")),
        F.nullif(F.regexp_extract(name, DAILY_QUOTES, 1), F.lit("")),
    )
    return F.to_date(text)


def underlying_key(symbol: Column) -> Column:
    """Lowercase letters and digits of a symbol, ``unknown`` when none remain."""
    stripped = F.regexp_replace(F.lower(symbol), "[^\\p{L}\\p{N}]", "")
    return F.when(stripped == "", "unknown").otherwise(stripped)


def with_file_columns(files: DataFrame, path: str = "path") -> DataFrame:
    named = files.withColumn("file_name", file_name(F.col(path)))
    return named.withColumns({"file_kind": file_kind(F.col("file_name")), "trade_date": trade_date(F.col("file_name"))})


def kind_counts(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return files.where(F.col("file_kind").isNotNull()).groupBy(*by, "file_kind").agg(F.count(F.lit(1)).alias("files"))


def corpus_layout(files: DataFrame, by: tuple[str, ...] = (), base: str = "root_dir", path: str = "path") -> DataFrame:
    """Flat or nested layout, the distinct parent folders of daily files and grouped archives found."""
    relative = F.expr(f"substring({path}, length({base}) + 2)")
    parent = F.regexp_replace(F.regexp_replace(relative, "/?[^/]+$", ""), "^$", ".")
    daily = F.col("file_kind") == "daily_calcs"
    per_folder = (
        files.withColumns({"parent": F.when(daily, parent), "grouped": F.when(F.col("file_kind") == "grouped_calcs", relative)})
        .groupBy(*by, "parent", "grouped")
        .agg(F.count_if(daily).alias("n"))
    )
    return per_folder.groupBy(*by).agg(
        F.sum("n").alias("daily_zip_count"),
        F.when(F.count_if(F.col("parent") != ".") > 0, "nested_daily").otherwise("flat_daily").alias("grouping_mode"),
        F.array_sort(F.collect_set("parent")).alias("relative_parent_directories"),
        F.array_sort(F.collect_set("grouped")).alias("unsupported_grouped_archives"),
    )


# --- window coverage --------------------------------------------------------------------------

def window_coverage(
    dates: DataFrame, start: dt.date, end: dt.date, by: tuple[str, ...] = (), date_col: str = "quote_date"
) -> DataFrame:
    """Observed against requested window: exact, short at one or both ends, or mismatching."""
    low, high = F.lit(start), F.lit(end)
    seen = dates.groupBy(*by).agg(F.min(date_col).alias("observed_start"), F.max(date_col).alias("observed_end"))
    first, last = F.col("observed_start"), F.col("observed_end")
    prefix, suffix = F.coalesce(first > low, F.lit(False)), F.coalesce(last < high, F.lit(False))
    exact = F.coalesce((first == low) & (last == high), F.lit(False))
    status = (
        F.when(exact, "exact")
        .when(prefix & suffix, "short_both")
        .when(prefix, "short_prefix")
        .when(suffix, "short_suffix")
        .otherwise("mismatch")
    )
    return seen.withColumns(
        {
            "matches_requested_window": exact,
            "coverage_status": status,
            "missing_prefix_start": F.when(prefix, low),
            "missing_prefix_end": F.when(prefix, F.date_sub(first, 1)),
            "missing_suffix_start": F.when(suffix, F.date_add(last, 1)),
            "missing_suffix_end": F.when(suffix, high),
        }
    )


def require_exact_coverage(coverage: DataFrame) -> None:
    bad = coverage.where(~F.col("matches_requested_window")).take(1)
    if bad:
        row = bad[0]
        raise ValueError(
            "The requested window does not match the observed files: "
            f"{row.observed_start}..{row.observed_end}, status {row.coverage_status}"
        )


# --- headers ----------------------------------------------------------------------------------

def reconcile_headers(
    files: DataFrame,
    header: str = "header",
    required: tuple[str, ...] = REQUIRED_COLUMNS,
    documented: tuple[str, ...] = DOCUMENTED_COLUMNS,
    calcs: tuple[str, ...] = CALCS_COLUMNS,
) -> DataFrame:
    return files.withColumns(header_report(F.col(header), required, documented, calcs))


def header_anomalies(reconciled: DataFrame, order: tuple[str, ...], header: str = "header") -> DataFrame:
    """Files whose column order differs from the first file, or with missing or extra columns.

    The first header is a scalar subquery over a min_by, so no global sort or window is needed.
    """
    first = reconciled.agg(F.min_by(F.array_join(header, "\u0001"), F.struct(*order)).alias("h"))
    differs = F.array_join(header, "\u0001") != first.scalar()
    odd = differs | ~F.col("pass_status") | (F.size("extra_columns") > 0)
    return reconciled.withColumn("order_differs", differs).where(odd)


def column_sets(reconciled: DataFrame, header: str = "header") -> DataFrame:
    """Union over files of the observed, missing and extra columns with their file counts."""
    def part(kind: str, column: str) -> DataFrame:
        return reconciled.select(F.lit(kind).alias("kind"), F.explode(column).alias("column_name"))

    stacked = (
        part("observed", header)
        .unionByName(part("missing", "missing_required_columns"))
        .unionByName(part("extra", "extra_columns"))
    )
    return stacked.groupBy("kind", "column_name").agg(F.count(F.lit(1)).alias("files"))


def content_dates(contents: DataFrame, file_cols: tuple[str, ...]) -> DataFrame:
    """First date, last date and null dates of every file's rows, combined before the shuffle."""
    return contents.groupBy(*file_cols).agg(
        F.min("quote_date").alias("first_date"),
        F.max("quote_date").alias("last_date"),
        F.count_if(F.col("quote_date").isNull()).alias("null_dates"),
    )


def content_date_report(dated: DataFrame, named: str = "trade_date") -> DataFrame:
    """Does every row of a file carry exactly the date in the file's name? No nulls allowed.

    ``dated`` is the output of ``content_dates`` with the name's date next to it.
    """
    same = (F.col("null_dates") == 0) & (F.col("first_date") == F.col(named)) & (F.col("last_date") == F.col(named))
    return dated.withColumn("quote_date_match", F.coalesce(same, F.lit(False)))


# --- column statistics ------------------------------------------------------------------------

def null_rates(df: DataFrame, file_cols: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Null rate per column: one wide counting pass per file, then min, mean and max over files."""
    counted = df.groupBy(*file_cols).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]
    )
    long = counted.unpivot([*file_cols, "_rows"], list(columns), "column_name", "present")
    rate = 1.0 - F.col("present") / F.greatest(F.col("_rows"), F.lit(1))
    return (
        long.withColumn("rate", rate)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("observed_file_count"),
            F.min("rate").alias("min_null_rate"),
            F.avg("rate").alias("mean_null_rate"),
            F.max("rate").alias("max_null_rate"),
        )
    )


def type_frequencies(df: DataFrame, file_cols: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Narrowest type that fits every text value of a column in a file, counted over files."""
    def misses(column: str, kind: str) -> Column:
        value = F.col(column)
        return F.count_if(value.isNotNull() & value.try_cast(kind).isNull())

    kinds = ("bigint", "double", "date")
    aggregates = [misses(c, k).alias(f"{c}|{k}") for c in columns for k in kinds]
    counted = df.groupBy(*file_cols).agg(*[F.count(c).alias(f"{c}|n") for c in columns], *aggregates)
    typed = counted.select(
        *file_cols,
        *[
            F.when(F.col(f"`{c}|n`") == 0, "null")
            .when(F.col(f"`{c}|bigint`") == 0, "bigint")
            .when(F.col(f"`{c}|double`") == 0, "double")
            .when(F.col(f"`{c}|date`") == 0, "date")
            .otherwise("string")
            .alias(c)
            for c in columns
        ],
    )
    long = typed.unpivot(list(file_cols), list(columns), "column_name", "type_name")
    return long.groupBy("column_name", "type_name").agg(F.count(F.lit(1)).alias("files"))


# --- selected underlying ----------------------------------------------------------------------

def underlying_caveats(df: DataFrame, by: tuple[str, ...] = ("underlying_symbol",)) -> DataFrame:
    """Rows with unusable underlying quotes, share of positive prices and distinct roots.

    Counts are first combined per root, so the distinct count is over roots, not rows.
    """
    bad = reduce(
        lambda a, b: a | b,
        [F.col(c).isNull() | (F.col(c) <= 0) for c in ("underlying_bid_1545", "underlying_ask_1545")],
    )
    positive = F.col("active_underlying_price_1545") > 0
    per_root = df.groupBy(*by, "root").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), F.count_if(positive).alias("positive")
    )
    total = per_root.groupBy(*by).agg(
        F.sum("rows").alias("selected_underlying_rows"),
        F.sum("bad").alias("zero_or_missing_underlying_bid_ask_rows"),
        F.sum("positive").alias("positive_active_underlying_price_rows"),
        F.count(F.lit(1)).alias("distinct_root_count"),
    )
    rows = F.col("selected_underlying_rows")
    return total.withColumns(
        {
            "zero_or_missing_fraction": F.coalesce(
                F.try_divide("zero_or_missing_underlying_bid_ask_rows", rows), F.lit(0.0)
            ),
            "positive_fraction": F.coalesce(
                F.try_divide("positive_active_underlying_price_rows", rows), F.lit(0.0)
            ),
            "active_underlying_price_usable": F.col("positive_active_underlying_price_rows") == rows,
        }
    )


def root_row_counts(df: DataFrame) -> DataFrame:
    """Rows by (date, root), by root, by date and in total; null marks a rolled-up column."""
    counted = df.groupBy("quote_date", "root").agg(F.count(F.lit(1)).alias("n"))
    sets = [[F.col("quote_date"), F.col("root")], [F.col("root")], [F.col("quote_date")], []]
    return counted.groupingSets(sets, F.col("quote_date"), F.col("root")).agg(F.sum("n").alias("rows"))


def root_coverage_by_date(df: DataFrame, root: str) -> DataFrame:
    """Per date: distinct roots, rows of the selected root and whether it is present at all."""
    counted = df.groupBy("quote_date", "root").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("quote_date").agg(
        F.count(F.lit(1)).alias("root_count"),
        F.coalesce(F.sum(F.when(F.col("root") == root, F.col("n"))), F.lit(0)).alias("selected_root_rows"),
        F.max(F.col("root") == root).alias("selected_root_present"),
    )


def dates_missing_root(df: DataFrame, root: str) -> DataFrame:
    """Dates on which the selected root has no row."""
    return root_coverage_by_date(df, root).where(~F.col("selected_root_present")).select("quote_date")
