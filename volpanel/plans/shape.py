"""Output shaping of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles so that summation order cannot show."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def joined(column: str | Column) -> Column:
    """Array as sorted, comma-separated text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.array_sort(column), ",")
