"""Early-close dimension: a fixed 65-row calendar used as literals, so no join is ever needed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# US option market early closes (12:45 local time), 2004 to 2026.
EARLY_CLOSE_TIME = "12:45"
EARLY_CLOSES = """
2004-07-02 2004-11-26 2004-12-23 2005-07-01 2005-11-25 2005-12-23 2006-07-03 2006-11-24 2006-12-22
2007-07-03 2007-11-23 2007-12-24 2008-07-03 2008-11-28 2008-12-24 2009-07-02 2009-11-27 2009-12-24
2010-07-02 2010-11-26 2010-12-23 2011-07-01 2011-11-25 2011-12-23 2012-07-03 2012-11-23 2012-12-24
2013-07-03 2013-11-29 2013-12-24 2014-07-03 2014-11-28 2014-12-24 2015-11-27 2015-12-24 2016-07-01
2016-11-25 2016-12-23 2017-07-03 2017-11-24 2017-12-22 2018-07-03 2018-11-23 2018-12-24 2019-07-03
2019-11-29 2019-12-24 2020-11-27 2020-12-24 2021-07-02 2021-11-26 2022-07-01 2022-11-25 2022-12-23
2023-07-03 2023-11-24 2023-12-22 2024-07-03 2024-11-29 2024-12-24 2025-07-03 2025-11-28 2025-12-24
2026-11-27 2026-12-24
"""


def early_close_dates() -> list[dt.date]:
    return [dt.date.fromisoformat(d) for d in EARLY_CLOSES.split()]


def validate_calendar(dates: list[dt.date]) -> list[dt.date]:
    """Sorted dates; an empty or repeating calendar is an error."""
    if not dates:
        raise ValueError("The early-close calendar is empty.")
    if len(set(dates)) != len(dates):
        raise ValueError("The early-close calendar repeats a date.")
    return sorted(dates)


def coverage(dates: list[dt.date]) -> tuple[dt.date, dt.date]:
    """First day of the first year to last day of the last year."""
    ordered = validate_calendar(dates)
    return dt.date(ordered[0].year, 1, 1), dt.date(ordered[-1].year, 12, 31)


def calendar_frame(spark: SparkSession, dates: list[dt.date] | None = None) -> DataFrame:
    rows = [(d, EARLY_CLOSE_TIME) for d in validate_calendar(dates or early_close_dates())]
    return spark.createDataFrame(rows, "quote_date date, market_close_time_eastern string")


def read_calendar(spark: SparkSession, path: str) -> list[dt.date]:
    """Calendar file with a ``quote_date`` column; a dimension of a few rows per year."""
    frame = spark.read.option("header", True).csv(path).select(F.to_date("quote_date").alias("d"))
    return validate_calendar([r.d for r in frame.collect()])


def is_early_close(date_col: str | Column, dates: list[dt.date] | None = None) -> Column:
    """Membership test against the calendar literals; raises outside the covered years."""
    column = F.col(date_col) if isinstance(date_col, str) else date_col
    ordered = validate_calendar(dates or early_close_dates())
    start, end = coverage(ordered)
    return F.when(column.between(F.lit(start), F.lit(end)), column.isin(ordered)).otherwise(
        F.raise_error(
            F.concat(F.lit("date outside the early-close calendar: "), column.cast("string"))
        ).cast("boolean")
    )


def early_closes_between(start: Column, end: Column, dates: list[dt.date] | None = None) -> Column:
    """Calendar entries inside [start, end] as an array; raises when the window leaves the calendar."""
    ordered = validate_calendar(dates or early_close_dates())
    low, high = coverage(ordered)
    entries = F.filter(F.array(*[F.lit(d) for d in ordered]), lambda d: d.between(start, end))
    return F.when((start >= F.lit(low)) & (end <= F.lit(high)), entries).otherwise(
        F.raise_error(
            F.concat_ws(" ", F.lit("window outside the early-close calendar:"), start.cast("string"), end.cast("string"))
        ).cast("array<date>")
    )
