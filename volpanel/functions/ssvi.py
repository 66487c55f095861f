"""Surface SVI algebra as Column expressions.

A surface state is a row with eleven ATM total variances ``theta_d010 … theta_d730``, ``rho``,
``eta`` and ``lambda``; its unconstrained twin is ``state_z_000 … state_z_013``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions.mathx import clip, logit, sigmoid

# Maturity knots in days and the numeric guards of the parameterization.
KNOT_DAYS = (10, 30, 60, 91, 122, 152, 182, 273, 365, 547, 730)
DAYS_PER_YEAR = 365.0
EPSILON = 1e-12
RHO_LIMIT = 0.999999
LAMBDA_LOW = 1e-6
LAMBDA_HIGH = 0.5 - 1e-6
ETA_SAFETY = 0.999
ETA_FLOOR = 1e-6

KNOT_TAUS = tuple(days / DAYS_PER_YEAR for days in KNOT_DAYS)
THETA_COLUMNS = tuple(f"theta_d{days:03d}" for days in KNOT_DAYS)
PARAMETER_COLUMNS = (*THETA_COLUMNS, "rho", "eta", "lambda")
LATENT_COLUMNS = tuple(f"state_z_{i:03d}" for i in range(len(PARAMETER_COLUMNS)))


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def eta_cap(theta_max: str | Column, rho: str | Column, lam: str | Column) -> Column:
    """Largest eta that keeps both butterfly conditions, with a safety margin."""
    top = F.greatest(_col(theta_max), F.lit(EPSILON))
    tilt = 1.0 + F.abs(_col(rho))
    lam = _col(lam)
    slope_bound = 4.0 / F.greatest(tilt * F.pow(top, 1.0 - lam), F.lit(EPSILON))
    curve_bound = F.sqrt(4.0 / F.greatest(tilt * F.pow(top, 1.0 - 2.0 * lam), F.lit(EPSILON)))
    return F.greatest(F.least(slope_bound, curve_bound) * ETA_SAFETY, F.lit(ETA_FLOOR))


def running_max(columns: list[Column]) -> list[Column]:
    """Running maximum along an ordered list of columns."""
    return [c if i == 0 else F.greatest(*columns[: i + 1]) for i, c in enumerate(columns)]


def with_constrained(df: DataFrame, latent: tuple[str, ...] = LATENT_COLUMNS) -> DataFrame:
    """Latent state to surface parameters."""
    n = len(THETA_COLUMNS)
    raised = df.withColumns({f"_e{i}": F.exp(F.col(latent[i])) for i in range(n)})
    thetas = dict(zip(THETA_COLUMNS, running_max([F.col(f"_e{i}") for i in range(n)])))
    staged = raised.withColumns(
        {
            **thetas,
            "rho": clip(F.tanh(F.col(latent[n])), -RHO_LIMIT, RHO_LIMIT),
            "lambda": clip(0.5 * sigmoid(F.col(latent[n + 2])), LAMBDA_LOW, LAMBDA_HIGH),
        }
    )
    capped = F.least(F.exp(F.col(latent[n + 1])), eta_cap(THETA_COLUMNS[-1], "rho", "lambda"))
    return staged.withColumn("eta", capped).drop(*[f"_e{i}" for i in range(n)])


def with_latent(df: DataFrame, latent: tuple[str, ...] = LATENT_COLUMNS) -> DataFrame:
    """Surface parameters to latent state."""
    n = len(THETA_COLUMNS)
    columns = {latent[i]: F.ln(F.greatest(F.col(c), F.lit(EPSILON))) for i, c in enumerate(THETA_COLUMNS)}
    columns[latent[n]] = F.atanh(clip(F.col("rho"), -RHO_LIMIT, RHO_LIMIT))
    columns[latent[n + 1]] = F.ln(F.greatest(F.col("eta"), F.lit(EPSILON)))
    columns[latent[n + 2]] = logit(clip(2.0 * F.col("lambda"), 1e-6, 1.0 - 1e-6))
    return df.withColumns(columns)


def parameters_valid() -> Column:
    """Positive and non-decreasing thetas, |rho| < 1, eta > 0, lambda in [0, 1/2]."""
    thetas = [F.col(c) for c in THETA_COLUMNS]
    checks = [c > 0 for c in thetas]
    checks += [b - a >= -EPSILON for a, b in zip(thetas, thetas[1:])]
    checks += [F.abs(F.col("rho")) < 1.0, F.col("eta") > 0, F.col("lambda").between(0.0, 0.5)]
    return reduce(lambda a, b: a & b, checks)


def theta_curve(tau: str | Column, thetas: list[Column] | None = None) -> Column:
    """ATM total variance at a maturity: linear between knots, flat outside."""
    tau = _col(tau)
    knots = thetas or [F.col(c) for c in THETA_COLUMNS]
    curve = F.when(tau <= KNOT_TAUS[0], knots[0])
    for i in range(1, len(KNOT_TAUS)):
        left, right = KNOT_TAUS[i - 1], KNOT_TAUS[i]
        share = (tau - F.lit(left)) / F.lit(right - left)
        curve = curve.when(tau <= right, knots[i - 1] + (knots[i] - knots[i - 1]) * share)
    return curve.otherwise(knots[-1])


def with_total_variance(
    df: DataFrame,
    out: str = "total_variance",
    m: str | Column = "m",
    tau: str | Column = "tau",
    keep_parts: bool = False,
) -> DataFrame:
    """Total variance of the row's surface at (m, tau); parts are staged as columns once."""
    rho = F.col("rho")
    staged = (
        df.withColumn("_theta", F.greatest(theta_curve(tau), F.lit(EPSILON)))
        .withColumn("_phi", F.greatest(F.col("eta"), F.lit(EPSILON)) * F.pow(F.col("_theta"), -F.col("lambda")))
        .withColumn("_km", F.col("_phi") * _col(m))
        .withColumn("_radical", F.sqrt((F.col("_km") + rho) * (F.col("_km") + rho) + 1.0 - rho * rho))
        .withColumn(out, 0.5 * F.col("_theta") * (1.0 + rho * F.col("_km") + F.col("_radical")))
    )
    return staged if keep_parts else staged.drop("_theta", "_phi", "_km", "_radical")


def with_implied_vol(
    df: DataFrame, out: str = "predicted_iv", m: str | Column = "m", tau: str | Column = "tau"
) -> DataFrame:
    """Implied volatility of the row's surface at (m, tau)."""
    valued = with_total_variance(df, "_w", m, tau)
    return valued.withColumn(out, F.sqrt(F.col("_w") / F.greatest(_col(tau), F.lit(EPSILON)))).drop("_w")


def with_butterfly(
    df: DataFrame,
    out: str = "butterfly_g",
    variance_out: str = "total_variance",
    m: str | Column = "m",
    tau: str | Column = "tau",
) -> DataFrame:
    """Total variance together with the density factor whose sign decides butterfly arbitrage."""
    rho, theta, phi, radical = F.col("rho"), F.col("_theta"), F.col("_phi"), F.col("_radical")
    w = F.greatest(F.col(variance_out), F.lit(EPSILON))
    staged = (
        with_total_variance(df, variance_out, m, tau, keep_parts=True)
        .withColumn("_w1", 0.5 * theta * phi * (rho + (F.col("_km") + rho) / radical))
        .withColumn("_w2", 0.5 * theta * phi * phi * (1.0 - rho * rho) / (radical * radical * radical))
        .withColumn("_drift", 1.0 - _col(m) * F.col("_w1") / (2.0 * w))
    )
    g = (
        F.col("_drift") * F.col("_drift")
        - 0.25 * F.col("_w1") * F.col("_w1") * (1.0 / w + 0.25)
        + 0.5 * F.col("_w2")
    )
    return staged.withColumn(out, g).drop(
        "_theta", "_phi", "_km", "_radical", "_w1", "_w2", "_drift"
    )
