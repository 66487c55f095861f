"""Sums of doubles that are the same for every order of addition.

All values of a group are scaled by one power of two, taken from the largest of them, to whole numbers of ``BITS`` bits, and
these are added as two halves in whole-number arithmetic. Rounding happens once per value, at 2 ** -58 of the largest, and once at
the end, so neither partitioning nor retries show in the result, and it is closer than a plain sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BITS = 58
#: Bits of the lower half; sums of halves stay whole numbers for 2 ** 33 rows.
LOW = 29


def power_of(largest: Column) -> Column:
    """Power of two that makes whole numbers of ``BITS`` bits of values up to ``largest``."""
    shift = F.lit(BITS - 1) - F.floor(F.log2(F.nullif(largest, F.lit(0.0))))
    return F.pow(F.lit(2.0), F.coalesce(F.greatest(F.least(shift, F.lit(1000)), F.lit(-1000)), F.lit(0)))


def halves(value: Column, power: Column) -> tuple[Column, Column]:
    whole = F.rint(value * power).cast("bigint")
    return F.shiftright(whole, LOW), whole.bitwiseAND(F.lit((1 << LOW) - 1))


def total_of(high: Column, low: Column, power: Column) -> Column:
    return (high.cast("double") * F.lit(float(1 << LOW)) + low) / power


def _finite(value: Column) -> Column:
    """Null instead of NaN and infinity, which have no place in a sum of whole numbers."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def window_sums(rows: DataFrame, values: dict[str, Column], group: WindowSpec) -> DataFrame:
    """``rows`` with the sum of each value over its group; null where no value is finite. No exchange beyond the window's own."""
    names = list(values)
    rows = rows.withColumns({f"_v_{n}": _finite(values[n]) for n in names})
    rows = rows.withColumns({f"_p_{n}": power_of(F.max(F.abs(F.col(f"_v_{n}"))).over(group)) for n in names})
    parts = {}
    for n in names:
        high, low = halves(F.col(f"_v_{n}"), F.col(f"_p_{n}"))
        parts |= {f"_h_{n}": F.sum(high).over(group), f"_l_{n}": F.sum(low).over(group)}
    rows = rows.withColumns(parts)
    rows = rows.withColumns({n: total_of(F.col(f"_h_{n}"), F.col(f"_l_{n}"), F.col(f"_p_{n}")) for n in names})
    return rows.drop(*[f"_{k}_{n}" for k in "vphl" for n in names])


def group_sums(rows: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per group with its sums, for groups too large for a window: largest values first, then sums, both combined before the exchange."""
    names = list(values)
    given = rows.select(*key, *[_finite(v).alias(f"_v_{n}") for n, v in values.items()])
    tops = given.groupBy(*key).agg(*[power_of(F.max(F.abs(F.col(f"_v_{n}")))).alias(f"_p_{n}") for n in names])
    parts = []
    for n in names:
        high, low = halves(F.col(f"_v_{n}"), F.col(f"_p_{n}"))
        parts += [F.sum(high).alias(f"_h_{n}"), F.sum(low).alias(f"_l_{n}"), F.any_value(f"_p_{n}").alias(f"_q_{n}")]
    same = [F.col(f"_k.{k}").eqNullSafe(F.col(f"_t.{k}")) for k in key]
    met = given.alias("_k").join(tops.alias("_t"), same).select(
        *[F.col(f"_k.{k}").alias(k) for k in key], *[f"_v_{n}" for n in names], *[f"_p_{n}" for n in names]
    )
    summed = met.groupBy(*key).agg(*parts)
    return summed.select(*key, *[total_of(F.col(f"_h_{n}"), F.col(f"_l_{n}"), F.col(f"_q_{n}")).alias(n) for n in names])
