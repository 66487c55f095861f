"""Scores of forecasts on realized nodes and contracts, fit diagnostics and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions import ssvi
from volpanel.functions.black import with_black_price
from volpanel.functions.mathx import huber
from volpanel.operators import surface
from volpanel.operators.keys import FORECAST_KEY, STATE_KEY

HUBER_DELTA = 1e-2
MAPE_FLOOR = 1e-4
WEIGHT_FLOOR = 1e-12
RETURN_FLOOR = 1e-12
TRADING_DAYS = 252.0

# Hedging buckets (name, option type, days) and straddle anchors in days.
HEDGE_BUCKETS = (("atm_call_30d", "C", 30), ("atm_put_30d", "P", 30), ("atm_call_91d", "C", 91))
STRADDLE_ANCHORS = (30, 91)


# --- error metrics ----------------------------------------------------------------------------

def error_metrics(actual: str = "node_iv", predicted: str = "predicted_iv", weight: str = "node_vega") -> dict[str, Column]:
    """RMSE, MAE, clipped MAPE and weight-averaged RMSE as aggregates."""
    error = F.col(predicted) - F.col(actual)
    weighted = F.sum(F.col(weight) * error * error) / F.greatest(F.sum(weight), F.lit(WEIGHT_FLOOR))
    return {
        "rmse_iv": F.sqrt(F.avg(error * error)),
        "mae_iv": F.avg(F.abs(error)),
        "mape_iv_clipped": F.avg(F.abs(error) / F.greatest(F.col(actual), F.lit(MAPE_FLOOR))),
        "vega_rmse_iv": F.sqrt(weighted),
    }


def aggregate(df: DataFrame, key: tuple[str, ...], metrics: dict[str, Column]) -> DataFrame:
    return df.groupBy(*key).agg(*[c.alias(n) for n, c in metrics.items()])


def weighted_huber(error: Column, weight: Column, delta: float = HUBER_DELTA) -> Column:
    """Weight-normalized Huber loss; a mask is a weight of zero."""
    return F.sum(weight * huber(error, delta)) / F.greatest(F.sum(weight), F.lit(WEIGHT_FLOOR))


def fit_diagnostics(fitted: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """Fit quality per date from nodes that already carry the fitted volatility."""
    error = F.col("predicted_iv") - F.col("node_iv")
    metrics = error_metrics()
    return aggregate(
        fitted,
        key,
        {
            "fit_rmse_iv": metrics["rmse_iv"],
            "fit_vega_rmse_iv": metrics["vega_rmse_iv"],
            "fit_mae_iv": metrics["mae_iv"],
            "final_loss": weighted_huber(error, F.col("node_vega")),
            "node_count": F.count(F.lit(1)),
        },
    )


# --- forecasts on realized nodes and contracts --------------------------------------------------

def forecast_states(forecasts: DataFrame) -> DataFrame:
    """Decode latent forecasts into surface parameters."""
    return ssvi.with_constrained(forecasts)


def node_forecasts(forecasts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Predicted volatility of every realized node of each forecast's target date."""
    realized = nodes.withColumnRenamed("quote_date", "target_date")
    joined = realized.join(
        forecasts.select(*FORECAST_KEY, *ssvi.PARAMETER_COLUMNS), ["option_root", "target_date"]
    )
    return ssvi.with_implied_vol(joined).drop(*ssvi.PARAMETER_COLUMNS)


def node_losses(predicted: DataFrame, key: tuple[str, ...] = FORECAST_KEY) -> DataFrame:
    return aggregate(predicted, key, error_metrics())


def forecast_certificates(forecasts: DataFrame, tolerance: float = surface.TOLERANCE) -> DataFrame:
    return surface.certify(forecasts, FORECAST_KEY, tolerance=tolerance)


def contract_forecasts(forecasts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Predicted volatility and price of every realized contract of the target date."""
    return with_black_price(node_forecasts(forecasts, contracts), "predicted_iv", "predicted_price")


def pricing_utility(priced: DataFrame, key: tuple[str, ...] = FORECAST_KEY) -> DataFrame:
    error = F.col("predicted_price") - F.col("mid_1545")
    inside = (F.col("predicted_price") >= F.col("bid_1545")) & (F.col("predicted_price") <= F.col("ask_1545"))
    return aggregate(
        priced,
        key,
        {
            "price_rmse": F.sqrt(F.avg(error * error)),
            "price_mae": F.avg(F.abs(error)),
            "inside_spread_rate": F.avg(inside.cast("double")),
        },
    )


# --- hedged moves -----------------------------------------------------------------------------

def hedge_buckets(contracts: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """The contract nearest to each bucket's maturity and to the money, per date; one pass over the contracts."""
    fields = ("root", "expiration", "strike", "option_type")
    near = surface.nearest_strikes(contracts, (*key, "root", "expiration", "option_type"), ())
    picked = near.groupBy(*key).agg(
        *[
            surface.nearest_value(
                F.struct(*fields), days / ssvi.DAYS_PER_YEAR, ("root", "expiration", "strike"), F.col("option_type") == side
            ).alias(name)
            for name, side, days in HEDGE_BUCKETS
        ]
    )
    entries = F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("c")) for n, _, _ in HEDGE_BUCKETS])
    return picked.select(*key, F.inline(entries)).where(F.col("c").isNotNull()).select(*key, "bucket", "c.*")


def carried_contracts(contracts: DataFrame, priced: DataFrame) -> DataFrame:
    """Contracts of the origin date next to the same contract, priced, on the target date."""
    identity = ["option_root", "root", "expiration", "strike", "option_type"]
    later = priced.select(
        "model_name",
        "forecast_origin",
        "target_date",
        *identity,
        F.col("mid_1545").alias("mid_1545_t1"),
        F.col("active_underlying_price_1545").alias("active_underlying_price_1545_t1"),
        "predicted_price",
    )
    now = contracts.select(
        F.col("quote_date").alias("forecast_origin"),
        *identity,
        "mid_1545",
        "delta_1545",
        F.col("active_underlying_price_1545"),
    )
    return later.join(now, ["forecast_origin", *identity])


def hedged_utility(carried: DataFrame, buckets: DataFrame, key: tuple[str, ...] = FORECAST_KEY) -> DataFrame:
    """Error of the predicted delta-hedged move, over all contracts and per bucket.

    The bucket flag is attached with one equi-join; "all" and the buckets are then one aggregation.
    """
    hedge = F.col("delta_1545") * (F.col("active_underlying_price_1545_t1") - F.col("active_underlying_price_1545"))
    realized = (F.col("mid_1545_t1") - F.col("mid_1545")) - hedge
    predicted = (F.col("predicted_price") - F.col("mid_1545")) - hedge
    identity = ["option_root", "root", "expiration", "strike", "option_type"]
    flags = (
        buckets.withColumnRenamed("quote_date", "forecast_origin")
        .groupBy("forecast_origin", *identity)
        .agg(F.collect_set("bucket").alias("_buckets"))
    )
    marked = carried.withColumn("_error", predicted - realized).join(flags, ["forecast_origin", *identity], "left")
    groups = F.concat(F.array(F.lit("all")), F.coalesce("_buckets", F.array().cast("array<string>")))
    long = marked.withColumn("bucket", F.explode(groups))
    return aggregate(
        long,
        (*key, "bucket"),
        {
            "hedged_pnl_rmse": F.sqrt(F.avg(F.col("_error") * F.col("_error"))),
            "hedged_pnl_mae": F.avg(F.abs("_error")),
        },
    )


# --- straddles --------------------------------------------------------------------------------

def straddle_pairs(contracts: DataFrame, key: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """Per date and anchor the call-put pair nearest to the anchor maturity and to the money."""
    legs = contracts.groupBy(*key, "root", "expiration", "strike").agg(
        F.sum("mid_1545").alias("gross_premium"),
        F.sum("spread_1545").alias("total_spread"),
        F.min("tau").alias("tau"),
        F.min("m").alias("m"),
        (F.max(F.col("option_type") == "C") & F.max(F.col("option_type") == "P")).alias("complete"),
    )
    fields = ("root", "expiration", "strike", "gross_premium", "total_spread")
    values = ("gross_premium", "total_spread")
    near = surface.nearest_strikes(legs.where("complete"), (*key, "root", "expiration"), values)
    picked = near.groupBy(*key).agg(
        *[
            surface.nearest_value(F.struct(*fields), d / ssvi.DAYS_PER_YEAR, ("root", "expiration", "strike")).alias(f"a{d}")
            for d in STRADDLE_ANCHORS
        ]
    )
    entries = F.array(*[F.struct(F.lit(d).alias("anchor_days"), F.col(f"a{d}").alias("p")) for d in STRADDLE_ANCHORS])
    return picked.select(*key, F.inline(entries)).select(*key, "anchor_days", "p.*")


def carried_straddles(pairs: DataFrame, contracts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Premium and spread of each pair on the next date; both legs must still be quoted.

    ``calendar`` gives ``option_root, quote_date, target_date``.
    """
    later = contracts.groupBy("option_root", F.col("quote_date").alias("target_date"), "root", "expiration", "strike").agg(
        F.sum("mid_1545").alias("next_premium"),
        F.sum("spread_1545").alias("next_spread"),
        F.count(F.lit(1)).alias("next_legs"),
    )
    dated = pairs.join(calendar, ["option_root", "quote_date"])
    return dated.join(later.where("next_legs >= 2"), ["option_root", "target_date", "root", "expiration", "strike"])


def straddle_returns(carried: DataFrame, current: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Signed straddle return per model, origin and anchor, before and after half-spread costs.

    The signal is the sign of the forecast change of ATM volatility; no change counts as short.
    """
    def atm(states: DataFrame, out: str, *keep: str) -> DataFrame:
        anchors = F.array(
            *[F.struct(F.lit(d).alias("anchor_days"), F.lit(d / ssvi.DAYS_PER_YEAR).alias("tau")) for d in STRADDLE_ANCHORS]
        )
        rows = states.select(*keep, *ssvi.PARAMETER_COLUMNS, F.inline(anchors)).withColumn("m", F.lit(0.0))
        return ssvi.with_implied_vol(rows, out).select(*keep, "anchor_days", out)

    now = atm(current, "current_atm_iv", "option_root", "quote_date").withColumnRenamed("quote_date", "forecast_origin")
    ahead = atm(forecasts, "predicted_atm_iv", *FORECAST_KEY)
    rows = (
        carried.withColumnRenamed("quote_date", "forecast_origin")
        .join(now, ["option_root", "forecast_origin", "anchor_days"])
        .join(ahead, ["option_root", "forecast_origin", "target_date", "anchor_days"])
    )
    signal = F.when(F.col("predicted_atm_iv") - F.col("current_atm_iv") > 0, 1.0).otherwise(-1.0)
    premium = F.greatest(F.col("gross_premium"), F.lit(RETURN_FLOOR))
    gross = signal * (F.col("next_premium") - F.col("gross_premium")) / premium
    cost = 0.5 * (F.col("total_spread") + F.col("next_spread")) / premium
    return rows.select(
        *FORECAST_KEY, "root", "anchor_days", gross.alias("gross_return"), (gross - cost).alias("net_return")
    )


def straddle_summary(returns: DataFrame, key: tuple[str, ...] = ("model_name", "anchor_days")) -> DataFrame:
    """Mean net return, hit rate and mean over standard deviation (floored, not annualized)."""
    net = F.col("net_return")
    return aggregate(
        returns,
        key,
        {
            "mean_net_return": F.avg(net),
            "hit_rate": F.avg((net > 0).cast("double")),
            "sharpe_ratio": F.avg(net) / F.greatest(F.stddev_samp(net), F.lit(RETURN_FLOOR)),
        },
    )


def annualized_straddle(returns: DataFrame, key: tuple[str, ...] = ("model_name", "anchor_days")) -> DataFrame:
    """Mean returns, hit rate and the annualized ratio, zero when the returns do not vary."""
    net = F.col("net_return")
    spread = F.stddev_samp(net)
    return aggregate(
        returns,
        key,
        {
            "mean_gross_return": F.avg("gross_return"),
            "mean_net_return": F.avg(net),
            "hit_rate": F.avg((net > 0).cast("double")),
            "sharpe_ratio": F.when(spread > 0, F.sqrt(F.lit(TRADING_DAYS)) * F.avg(net) / spread).otherwise(F.lit(0.0)),
        },
    )


# --- summaries --------------------------------------------------------------------------------

def summary_table(panel: DataFrame, columns: tuple[str, ...], key: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Means per model (and bucket), ordered by the first metric; a report-sized result."""
    means = panel.groupBy(*key).agg(*[F.avg(c).alias(c) for c in columns])
    return means.orderBy(columns[0], *key)


def rank_candidates(losses: DataFrame, certificates: DataFrame, candidate: str = "candidate_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean scores per candidate; ``is_best`` marks the lexicographic minimum.

    The order is vega RMSE, RMSE, calendar violations, butterfly violations, then the candidate id.
    """
    scores = losses.groupBy(*by, candidate).agg(
        F.avg("vega_rmse_iv").alias("mean_vega_rmse_iv"), F.avg("rmse_iv").alias("mean_rmse_iv")
    )
    checks = certificates.groupBy(*by, candidate).agg(
        F.avg("calendar_violation_count").alias("mean_calendar_violations"),
        F.avg("butterfly_violation_count").alias("mean_butterfly_violations"),
    )
    table = scores.join(checks, [*by, candidate])
    order = F.struct(
        "mean_vega_rmse_iv", "mean_rmse_iv", "mean_calendar_violations", "mean_butterfly_violations", candidate
    )
    if not by:
        best = table.agg(F.min_by(candidate, order).alias("best")).scalar()
        return table.withColumn("is_best", F.col(candidate) == best)
    best = table.groupBy(*by).agg(F.min_by(candidate, order).alias("_best"))
    return table.join(best, list(by)).withColumn("is_best", F.col(candidate) == F.col("_best")).drop("_best")
