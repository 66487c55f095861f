"""Surface evaluation over many states: grids, certification, nearest nodes and starting surfaces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions import ssvi
from volpanel.functions.mathx import clip
from volpanel.operators.keys import STATE_KEY

TOLERANCE = 1e-8
GRID_POINTS = 41
GRID_LOW, GRID_HIGH = math.log(0.60), math.log(2.00)
MIN_THETA = 1e-6
SKEW_WIDTH = 0.25
SKEW_SCALE = -8.0
SKEW_LIMIT = 0.8
DEFAULT_RHO = -0.4
START_LAMBDA = 0.25
START_ETA = 0.75
START_ETA_SHARE = 0.8


# --- grids and certification ------------------------------------------------------------------

def certification_moneyness() -> list[float]:
    step = (GRID_HIGH - GRID_LOW) / (GRID_POINTS - 1)
    return [GRID_LOW + i * step for i in range(GRID_POINTS)]


def certification_taus() -> list[float]:
    """The maturity knots and the midpoints between them."""
    days = [float(d) for d in ssvi.KNOT_DAYS]
    middles = [0.5 * (a + b) for a, b in zip(days, days[1:])]
    return [d / ssvi.DAYS_PER_YEAR for d in sorted(days + middles)]


def literal_array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def on_grid(states: DataFrame, m_values: list[float], tau_values: list[float]) -> DataFrame:
    """Every state at every (m, tau) point: two generators over literal arrays, no join at all."""
    by_tau = states.select("*", F.posexplode(literal_array(tau_values)).alias("tau_no", "tau"))
    return by_tau.select("*", F.posexplode(literal_array(m_values)).alias("m_no", "m"))


def calendar_residuals(states: DataFrame, m_values: list[float] | None = None, tau_values: list[float] | None = None) -> DataFrame:
    """Total variance at each maturity minus the one at the grid's previous maturity, per moneyness.

    Both ends of a step are functions of the same state row, so the difference is evaluated in
    place; sorting or shuffling the grid is not needed.
    """
    m_values = m_values or certification_moneyness()
    tau_values = tau_values or certification_taus()
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("tau_no"), F.lit(a).alias("tau_before"), F.lit(b).alias("tau"))
            for i, (a, b) in enumerate(zip(tau_values, tau_values[1:]), start=1)
        ]
    )
    steps = states.select("*", F.inline(pairs)).select("*", F.posexplode(literal_array(m_values)).alias("m_no", "m"))
    after = ssvi.with_total_variance(steps, "total_variance")
    both = ssvi.with_total_variance(after, "_before", tau="tau_before")
    return both.withColumn("calendar_residual", F.col("total_variance") - F.col("_before")).drop("_before", "tau_before")


def certify(
    states: DataFrame,
    key: tuple[str, ...] = STATE_KEY,
    m_values: list[float] | None = None,
    tau_values: list[float] | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Static-arbitrage certificate per state over the moneyness and maturity grid.

    Each grid point carries its calendar residual to the previous maturity (none at the first) and
    its butterfly factor; one aggregation per state, combined before the exchange.
    """
    m_values = m_values or certification_moneyness()
    tau_values = tau_values or certification_taus()
    previous = [None, *tau_values[:-1]]
    taus = F.array(
        *[
            F.struct(F.lit(float(t)).alias("tau"), F.lit(p).cast("double").alias("_tau_before"))
            for t, p in zip(tau_values, previous)
        ]
    )
    slim = states.select(*key, *ssvi.PARAMETER_COLUMNS)
    grid = slim.select("*", F.inline(taus)).select("*", F.explode(literal_array(m_values)).alias("m"))
    valued = ssvi.with_butterfly(grid, "_g", "_w")
    valued = ssvi.with_total_variance(valued, "_w_before", tau="_tau_before")
    step = F.when(F.col("_tau_before").isNotNull(), F.col("_w") - F.col("_w_before"))
    worst = valued.select(*key, step.alias("_step"), "_g").groupBy(*key).agg(
        F.min("_step").alias("_min_step"),
        F.min("_g").alias("_min_g"),
        F.count_if(F.col("_step") < -tolerance).alias("calendar_violation_count"),
        F.count_if(F.col("_g") < -tolerance).alias("butterfly_violation_count"),
    )

    def negative(count: str, low: str) -> Column:
        return F.when(F.col(count) > 0, F.col(low)).otherwise(F.lit(0.0))

    return worst.select(
        *key,
        negative("calendar_violation_count", "_min_step").alias("max_negative_calendar_residual"),
        negative("butterfly_violation_count", "_min_g").alias("max_negative_butterfly_residual"),
        "calendar_violation_count",
        "butterfly_violation_count",
        ((F.col("calendar_violation_count") == 0) & (F.col("butterfly_violation_count") == 0)).alias("passes_static_arb"),
    )


def require_certified(certificates: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """The certificates, raising inside the plan as soon as one state fails."""
    failed = F.raise_error(
        F.concat_ws(" ", F.lit("static-arbitrage certification failed for"), *[F.col(c).cast("string") for c in key])
    ).cast("boolean")
    return certificates.withColumn("passes_static_arb", F.when(F.col("passes_static_arb"), F.lit(True)).otherwise(failed))


# --- nearest nodes ----------------------------------------------------------------------------

def nearest_strikes(rows: DataFrame, key: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """One row per expiry group: its strike nearest to the money with tau, m and ``values``; ties to the lower strike.

    Moneyness rises with the strike inside an expiry, so the nearest strike is the last one at or below the
    forward or the first one at or above it. Both sides are found with primitive buffers: one
    code-generated hash aggregation, combined before the exchange.
    """
    m = F.col("m")
    below, above = F.when(m <= 0, m), F.when(m >= 0, m)
    fields = ("strike", *values)
    sides = rows.groupBy(*key).agg(
        F.min("tau").alias("tau"),
        F.max(below).alias("_below"),
        F.min(above).alias("_above"),
        *[F.max_by(c, below).alias(f"_b_{c}") for c in fields],
        *[F.min_by(c, above).alias(f"_a_{c}") for c in fields],
    ).where(F.col("_below").isNotNull() | F.col("_above").isNotNull())
    lower = F.col("_above").isNull() | (F.abs("_below") <= F.col("_above"))
    picked = [F.when(lower, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in fields]
    return sides.select(*key, "tau", F.when(lower, F.col("_below")).otherwise(F.col("_above")).alias("m"), *picked)


def nearest_value(
    value: str | Column, target_tau: float, ties: tuple[str, ...], where: Column | None = None
) -> Column:
    """Aggregate over rows of ``nearest_strikes``: the value nearest in maturity, then in moneyness, then by key order."""
    distance = F.struct(F.abs(F.col("tau") - target_tau), F.abs(F.col("m")), *[F.col(c) for c in ties])
    ordering = distance if where is None else F.when(where, distance)
    return F.min_by(value, ordering)


def nearest_nodes(
    nodes: DataFrame,
    taus: tuple[float, ...] = ssvi.KNOT_TAUS,
    key: tuple[str, ...] = STATE_KEY,
    ties: tuple[str, ...] = ("expiration", "strike"),
    columns: tuple[str, ...] = ("expiration", "strike", "tau", "m", "node_iv"),
) -> DataFrame:
    """For each target maturity the nearest node, all targets in one aggregation of the expiries.

    Expiries are reduced to their nearest strike first; one ``min_by`` per target then keeps the row count
    unchanged: no product of nodes and targets.
    """
    near = nearest_strikes(nodes, (*key, "expiration"), _payload(columns, key))
    picked = near.groupBy(*key).agg(
        *[nearest_value(F.struct(*columns), t, ties).alias(f"n{i}") for i, t in enumerate(taus)]
    )
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("target_no"), F.lit(t).alias("target_tau"), F.col(f"n{i}").alias("node"))
            for i, t in enumerate(taus)
        ]
    )
    return picked.select(*key, F.inline(targets)).select(*key, "target_no", "target_tau", "node.*")


def _payload(columns: tuple[str, ...], key: tuple[str, ...]) -> tuple[str, ...]:
    """Columns that the nearest strike has to carry along."""
    return tuple(c for c in columns if c not in (*key, "expiration", "strike", "tau", "m"))


# --- starting surface -------------------------------------------------------------------------

def skew_start(nodes: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """Start value of rho from the volatility slope near the money."""
    slope, samples, rho = skew_aggregates()
    return nodes.groupBy(*key).agg(slope.alias("skew_slope"), samples.alias("skew_samples"), rho.alias("rho"))


def skew_aggregates() -> tuple[Column, Column, Column]:
    near = F.abs(F.col("m")) <= SKEW_WIDTH
    slope = F.regr_slope(F.when(near, F.col("node_iv")), F.when(near, F.col("m")))
    samples = F.count_if(near)
    rho = F.when(
        (samples >= 3) & slope.isNotNull(), clip(F.tanh(SKEW_SCALE * slope), -SKEW_LIMIT, SKEW_LIMIT)
    ).otherwise(F.lit(DEFAULT_RHO))
    return slope, samples, rho


def initial_surface(
    nodes: DataFrame, key: tuple[str, ...] = STATE_KEY, ties: tuple[str, ...] = ("expiration", "strike")
) -> DataFrame:
    """Starting surface of every date: nearest node per knot, skew and eta below its cap."""
    near = nearest_strikes(nodes, (*key, "expiration"), ("node_iv",))
    knots = near.groupBy(*key).agg(
        *[nearest_value("node_iv", t, ties).alias(f"_iv{i}") for i, t in enumerate(ssvi.KNOT_TAUS)]
    )
    picked = knots.join(skew_start(nodes, key).select(*key, "rho"), list(key))
    guesses = picked.withColumns(
        {
            f"_t{i}": F.greatest(F.lit(t) * F.col(f"_iv{i}") * F.col(f"_iv{i}"), F.lit(MIN_THETA))
            for i, t in enumerate(ssvi.KNOT_TAUS)
        }
    )
    thetas = ssvi.running_max([F.col(f"_t{i}") for i in range(len(ssvi.KNOT_TAUS))])
    staged = guesses.withColumns(
        {**dict(zip(ssvi.THETA_COLUMNS, thetas)), "lambda": F.lit(START_LAMBDA)}
    )
    eta = F.least(F.lit(START_ETA), START_ETA_SHARE * ssvi.eta_cap(ssvi.THETA_COLUMNS[-1], "rho", "lambda"))
    full = staged.withColumn("eta", eta).select(*key, *ssvi.PARAMETER_COLUMNS)
    return ssvi.with_latent(full)


def atm_total_variance(nodes: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """Total variance of the node nearest to the money in every expiry."""
    near = nearest_strikes(nodes, (*key, "expiration"), ("node_iv",))
    variance = F.col("tau") * F.col("node_iv") * F.col("node_iv")
    return near.select(*key, "expiration", "tau", variance.alias("w"))


def interpolated_thetas(atm: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """ATM total variance at the knots: linear in maturity between expiries, flat volatility outside."""
    point = F.struct("tau", "w")
    sides = atm.groupBy(*key).agg(
        *[F.max(F.when(F.col("tau") <= t, point)).alias(f"_l{i}") for i, t in enumerate(ssvi.KNOT_TAUS)],
        *[F.min(F.when(F.col("tau") >= t, point)).alias(f"_r{i}") for i, t in enumerate(ssvi.KNOT_TAUS)],
    )
    guesses = {}
    for i, t in enumerate(ssvi.KNOT_TAUS):
        lt, lw = F.col(f"_l{i}.tau"), F.col(f"_l{i}.w")
        rt, rw = F.col(f"_r{i}.tau"), F.col(f"_r{i}.w")
        inside = F.when(rt > lt, lw + (rw - lw) * ((F.lit(t) - lt) / F.nullif(rt - lt, F.lit(0.0)))).otherwise(lw)
        value = F.when(lt.isNull(), rw * F.lit(t) / rt).when(rt.isNull(), lw * F.lit(t) / lt).otherwise(inside)
        guesses[f"_t{i}"] = F.greatest(value, F.lit(MIN_THETA))
    raised = sides.withColumns(guesses)
    thetas = ssvi.running_max([F.col(f"_t{i}") for i in range(len(ssvi.KNOT_TAUS))])
    return raised.select(*key, *[c.alias(n) for c, n in zip(thetas, ssvi.THETA_COLUMNS)])


def running_max_long(df: DataFrame, value: str, order: str, key: tuple[str, ...] = STATE_KEY, out: str = "running_max") -> DataFrame:
    """Running maximum over ordered long rows (the wide form is ``functions.ssvi.running_max``)."""
    frame = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(value).over(frame))
