"""Scalar state features, trailing windows, history tensors and their normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.ssvi import LATENT_COLUMNS
from volpanel.operators.calendar import date_order
from volpanel.operators.keys import PANEL_KEY

SCALAR_COLUMNS = (
    "underlying_log_return_1d",
    "underlying_log_return_5d",
    "underlying_log_return_22d",
    "log_total_trade_volume",
    "log_total_open_interest",
    "median_rel_spread_1545",
    "surface_fit_rmse_iv",
    "surface_node_count",
    "valid_expiry_count",
)
HISTORY_COLUMNS = (*LATENT_COLUMNS, *SCALAR_COLUMNS)
STD_FLOOR = 1e-6


def log_return(price: str, horizon: int, by: tuple[str, ...] = PANEL_KEY) -> Column:
    """Log return over ``horizon`` state rows; null at the start, an error for non-positive prices."""
    previous = F.lag(price, horizon).over(date_order(by))
    bad = (F.col(price) <= 0) | (previous <= 0)
    return F.when(bad, F.raise_error(F.lit("log returns need positive prices")).cast("double")).otherwise(
        F.ln(F.col(price) / previous)
    )


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def with_scalar_features(states: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """The nine scalar features; returns and the forward fill run over state rows, not calendar days."""
    so_far = date_order(by).rowsBetween(Window.unboundedPreceding, 0)
    price = "active_underlying_price_1545"
    raw = states.withColumns(
        {
            "underlying_log_return_1d": log_return(price, 1, by),
            "underlying_log_return_5d": log_return(price, 5, by),
            "underlying_log_return_22d": log_return(price, 22, by),
            "log_total_trade_volume": F.ln(F.greatest(F.col("total_trade_volume").cast("double"), F.lit(1.0))),
            "log_total_open_interest": F.ln(F.greatest(F.col("total_open_interest").cast("double"), F.lit(1.0))),
            "surface_fit_rmse_iv": F.last("surface_fit_rmse_iv", ignorenulls=True).over(so_far),
        }
    )
    return raw.withColumns({c: zero_if_missing(F.col(c)) for c in SCALAR_COLUMNS})


def trailing_mean(
    rows: DataFrame, columns: tuple[str, ...], window: int, by: tuple[str, ...] = PANEL_KEY, suffix: str = "_mean"
) -> DataFrame:
    """Mean over the last ``window`` rows, null until the window is full."""
    if window <= 0:
        raise ValueError("window must be positive")
    frame = date_order(by).rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(frame) == window
    return rows.withColumns({c + suffix: F.when(full, F.avg(c).over(frame)) for c in columns})


def with_history(
    states: DataFrame,
    columns: tuple[str, ...],
    history_days: int,
    by: tuple[str, ...] = PANEL_KEY,
    out: str = "history",
    strict: bool = False,
) -> DataFrame:
    """Array of the last ``history_days`` feature vectors, oldest first; null (or an error) on underflow."""
    frame = date_order(by).rowsBetween(-(history_days - 1), 0)
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    missing = F.raise_error(F.lit("history window underflow")).cast("array<array<double>>") if strict else F.lit(None)
    window = F.collect_list(vector).over(frame)
    return states.withColumn(out, window).withColumn(
        out, F.when(F.size(out) == history_days, F.col(out)).otherwise(missing)
    )


def used_states(
    states: DataFrame,
    rows: DataFrame,
    history_days: int,
    by: tuple[str, ...] = PANEL_KEY,
    pointer: str = "history_end_index",
    index: str = "state_row_index",
) -> DataFrame:
    """State rows that fall into at least one history window ending at ``pointer``.

    Ends are joined on their own row, then one look-ahead window finds the next end; no interval
    join and no explosion of windows into rows.
    """
    ends = rows.select(*by, F.col(pointer).alias(index)).distinct().withColumn("_is_end", F.lit(True))
    ahead = Window.partitionBy(*by).orderBy(index).rowsBetween(0, history_days - 1)
    marked = states.join(ends, [*by, index], "left")
    return (
        marked.withColumn("_used", F.max(F.coalesce("_is_end", F.lit(False))).over(ahead))
        .where("_used")
        .drop("_used", "_is_end")
    )


def normalization_stats(used: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """Mean and population standard deviation per column, a deviation below the floor becomes 1."""
    stats = used.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
    )
    return stats.withColumns(
        {f"{c}_std": F.when(F.col(f"{c}_std") < STD_FLOOR, 1.0).otherwise(F.col(f"{c}_std")) for c in columns}
    )


def normalize(
    states: DataFrame, stats: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = PANEL_KEY
) -> DataFrame:
    """Replace the columns by their z-scores."""
    side = stats.select(*by, *[f"{c}_mean" for c in columns], *[f"{c}_std" for c in columns])
    joined = states.join(side, list(by))
    return joined.withColumns(
        {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
    ).drop(*[f"{c}_mean" for c in columns], *[f"{c}_std" for c in columns])

