"""Scalar functions that Spark SQL does not ship, written as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published double-precision rational approximation of the normal
# distribution function (Hart 1968, algorithm 5666, as tabulated by West 2005).
NORMAL_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
NORMAL_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
NORMAL_SPLIT = 7.07106781186547
NORMAL_LIMIT = 37.0
SQRT_TWO_PI = 2.506628274631


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def logit(value: Column, low: float = 1e-9, high: float = 1.0 - 1e-9) -> Column:
    bounded = clip(value, low, high)
    return F.ln(bounded / (F.lit(1.0) - bounded))


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, accurate to about 1e-15 on the whole line."""
    size = F.abs(x)
    density = F.exp(-size * size / 2.0)
    centre = density * horner(size, NORMAL_NUMERATOR) / horner(size, NORMAL_DENOMINATOR)
    fraction = size + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = size + F.lit(step) / fraction
    tail = (
        F.when(size > NORMAL_LIMIT, F.lit(0.0))
        .when(size < NORMAL_SPLIT, centre)
        .otherwise(density / fraction / SQRT_TWO_PI)
    )
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def is_finite(value: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def hash_uniform(*parts: Column) -> Column:
    """Reproducible uniform in [0, 1) from the first eight hex digits of an MD5 of the parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def huber(error: Column, delta: float) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))
