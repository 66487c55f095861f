"""Surface nodes: contracts joined to forwards and collapsed per strike, and date quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators import parity
from volpanel.operators.keys import EXPIRY_KEY, NODE_KEY

MIN_NODES = 40
MIN_EXPIRIES = 4


def contracts_with_forward(
    contracts: DataFrame, terms: DataFrame, on: tuple[str, ...] = (*EXPIRY_KEY, "option_root")
) -> DataFrame:
    """Attach forward and discount factor and add the log forward moneyness.

    No broadcast hint: the terms table grows with the dates, so its size decides at run time.
    """
    slim = terms.select(*on, "discount_factor", "forward_price")
    return contracts.join(slim, list(on), "inner").withColumn("m", F.ln(F.col("strike") / F.col("forward_price")))


def dates_without_forward(
    contracts: DataFrame, terms: DataFrame, by: tuple[str, ...] = ("quote_date", "root")
) -> DataFrame:
    """Dates whose contracts have no forward terms at all (anti-join report)."""
    return contracts.select(*by).distinct().join(terms.select(*by).distinct(), list(by), "left_anti")


def require_empty(report: DataFrame, message: str) -> None:
    """Raise when a report has rows, quoting the first few."""
    shown = [tuple(r) for r in report.take(5)]
    if shown:
        raise ValueError(f"{message}: {shown}")


NODE_COLUMNS = (
    "option_root", "tau", "m", "node_iv", "node_vega", "active_underlying_price_1545", "trade_volume", "open_interest",
    "median_rel_spread_1545", "forward_price", "discount_factor", "collapsed_contract_count",
)


def node_aggregates() -> list[Column]:
    """Vega-weighted summary of the legs of a strike, on primitive buffers.

    The duplicate policy leaves at most one call and one put per strike, and the median of two is their
    mean; ``checked_legs`` refuses a strike with more.
    """
    iv, vega = F.col("implied_volatility_1545"), F.col("vega_1545")
    return [
        F.min("tau").alias("tau"),
        F.try_divide(F.sum(iv * vega), F.sum(vega)).alias("node_iv"),
        F.sum(vega).alias("node_vega"),
        F.avg("active_underlying_price_1545").alias("active_underlying_price_1545"),
        F.sum("trade_volume").alias("trade_volume"),
        F.sum("open_interest").alias("open_interest"),
        F.avg("rel_spread_1545").alias("median_rel_spread_1545"),
        F.count(F.lit(1)).alias("collapsed_contract_count"),
    ]


def checked_legs(strikes: DataFrame) -> DataFrame:
    """The strikes, raising inside the plan where one has more than two legs."""
    count = F.col("collapsed_contract_count")
    message = F.concat(F.lit("more than two legs at strike "), F.col("strike").cast("string"), F.lit(" on "), F.col("quote_date").cast("string"))
    return strikes.withColumn(
        "collapsed_contract_count", F.when(count > 2, F.raise_error(message).cast("bigint")).otherwise(count)
    )


def strike_table(contracts: DataFrame, key: tuple[str, ...] = NODE_KEY) -> DataFrame:
    """Both legs and the node summary of every strike from one pass over the contracts.

    Everything after it works on strikes: the only exchange of contract rows is this one, on the
    full node key, so a hot date or expiry is spread over its strikes.
    """
    return checked_legs(contracts.groupBy(*key, "option_root").agg(*node_aggregates(), *parity.leg_columns()))


def nodes_of(strikes: DataFrame, key: tuple[str, ...] = NODE_KEY) -> DataFrame:
    """Nodes from strike rows that carry a forward; strikes of invalid expiries drop out."""
    valued = strikes.where(F.col("forward_price").isNotNull()).withColumn("m", F.ln(F.col("strike") / F.col("forward_price")))
    return valued.select(*key, *NODE_COLUMNS)


def surface_nodes(contracts: DataFrame, min_pairs: int = parity.MIN_PAIRS, multiple: float = parity.MAD_MULTIPLE) -> DataFrame:
    """Contracts to nodes: strike table, forward per expiry, moneyness. Two exchanges, no join."""
    return nodes_of(parity.with_forward(strike_table(contracts), min_pairs=min_pairs, multiple=multiple))


def collapse_nodes(contracts: DataFrame, terms: DataFrame, key: tuple[str, ...] = NODE_KEY) -> DataFrame:
    """Nodes from contracts and given forward terms: collapsed per strike first, then joined."""
    summary = checked_legs(contracts.groupBy(*key, "option_root").agg(*node_aggregates()))
    slim = terms.select(*EXPIRY_KEY, "discount_factor", "forward_price")
    return nodes_of(summary.join(slim, list(EXPIRY_KEY)), key)


def date_quality(
    nodes: DataFrame,
    min_nodes: int = MIN_NODES,
    min_expiries: int = MIN_EXPIRIES,
    by: tuple[str, ...] = ("quote_date",),
) -> DataFrame:
    """Node, expiry and root counts per date and whether the date can be modelled.

    Nodes are first counted per (date, root, expiry); the distinct counts then see only those rows.
    """
    keys = list(dict.fromkeys([*by, "root", "expiration"]))
    per_expiry = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counted = per_expiry.groupBy(*by).agg(
        F.sum("n").alias("surface_node_count"),
        F.count_distinct("expiration").alias("valid_expiry_count"),
        F.count_distinct("root").alias("root_count"),
    )
    valid = (
        (F.col("surface_node_count") >= min_nodes)
        & (F.col("valid_expiry_count") >= min_expiries)
        & (F.col("root_count") == 1)
    )
    return counted.withColumn("modeling_valid", valid)


def mixed_root_dates(quality: DataFrame) -> DataFrame:
    return quality.where(F.col("root_count") > 1)


def valid_nodes(nodes: DataFrame, quality: DataFrame, by: tuple[str, ...] = ("quote_date",)) -> DataFrame:
    """Nodes of the dates that can be modelled."""
    return nodes.join(quality.where("modeling_valid").select(*by), list(by), "left_semi")


def state_summary(nodes: DataFrame, by: tuple[str, ...] = ("option_root", "quote_date")) -> DataFrame:
    """Per-date summary columns of the state panel.

    The exact median runs over (value, count) pairs, and the distinct expiries come from a
    pre-aggregation, so a heavy date arrives already combined. Prices are added as decimals of ten places, so their
    average does not depend on the order of the nodes.
    """
    per_expiry = nodes.groupBy(*by, "expiration", "median_rel_spread_1545").agg(
        F.sum(F.col("active_underlying_price_1545").try_cast("decimal(28,10)")).alias("price_sum"),
        F.count("active_underlying_price_1545").alias("price_n"),
        F.sum("trade_volume").alias("volume"),
        F.sum("open_interest").alias("interest"),
        F.count(F.lit(1)).alias("n"),
    )
    return per_expiry.groupBy(*by).agg(
        F.try_divide(F.sum("price_sum").cast("double"), F.sum("price_n")).alias("active_underlying_price_1545"),
        F.sum("volume").alias("total_trade_volume"),
        F.sum("interest").alias("total_open_interest"),
        F.percentile("median_rel_spread_1545", F.lit(0.5), F.col("n")).alias("median_rel_spread_1545"),
        F.sum("n").alias("surface_node_count"),
        F.count_distinct("expiration").alias("valid_expiry_count"),
    )
