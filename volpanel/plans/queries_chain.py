"""Registered queries over the option chain: parity, forwards and surface nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.operators import nodes, parity
from volpanel.operators.keys import EXPIRY_KEY
from volpanel.plans.adapters import CHAIN_SQL, chain
from volpanel.plans.oracle_text import FORWARD_SQL, NODES_SQL
from volpanel.plans.registry import ORACLES, register
from volpanel.plans.shape import joined, rounded


def chain_diagnostics(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return parity.forward_diagnostics(chain(spark, sf_dir), **options)


def chain_contracts(spark: SparkSession, sf_dir: str, period: str = "quarter") -> DataFrame:
    contracts = chain(spark, sf_dir, period)
    return nodes.contracts_with_forward(contracts, parity.forward_terms(parity.forward_diagnostics(contracts)))


def chain_nodes(spark: SparkSession, sf_dir: str, period: str = "quarter") -> DataFrame:
    return nodes.surface_nodes(chain(spark, sf_dir, period))


@register(
    "forward_terms",
    "AGG6 AGG4 AGG5 JON1",
    "WITH" + FORWARD_SQL + """
SELECT quote_date, root, option_root, expiration, round(discount_factor, 6) AS discount_factor,
       round(forward_price, 4) AS forward_price, matched_pairs_before_prune, matched_pairs_after_prune FROM terms""",
)
def forward_terms(spark, sf_dir):
    terms = parity.forward_terms(chain_diagnostics(spark, sf_dir))
    return rounded(rounded(terms, 6, "discount_factor"), 4, "forward_price")


@register("forward_terms_split", "AGG4 AGG5 AGG6 AGG7", ORACLES["forward_terms"])
def forward_terms_split(spark, sf_dir):
    """The same forwards by the route that splits heavy expiries over tasks."""
    terms = parity.forward_terms(parity.split_forward_diagnostics(chain(spark, sf_dir)))
    return rounded(rounded(terms, 6, "discount_factor"), 4, "forward_price")


@register(
    "forward_diagnostics",
    "AGG7",
    "WITH" + FORWARD_SQL + """
SELECT quote_date, root, expiration, n_before AS matched_pairs_before_prune, n_after AS matched_pairs_after_prune,
       invalid_reason FROM reasoned""",
)
def forward_diagnostics(spark, sf_dir):
    return chain_diagnostics(spark, sf_dir).drop("discount_factor", "forward_price")


@register(
    "strike_pairs",
    "JON1",
    "WITH" + FORWARD_SQL + """
SELECT quote_date, root, expiration, strike, round(call_mid, 6) AS call_mid, round(put_mid, 6) AS put_mid,
       round(call_vega, 6) AS call_vega, round(put_vega, 6) AS put_vega FROM matched""",
)
def strike_pairs(spark, sf_dir):
    pairs = parity.matched_only(parity.strike_pairs(chain(spark, sf_dir)))
    return rounded(pairs, 6, "call_mid", "put_mid", "call_vega", "put_vega")


@register(
    "weighted_line_fit",
    "AGG4",
    "WITH" + FORWARD_SQL + """
SELECT quote_date, root, expiration, CAST(n AS BIGINT) AS n,
       round((sxx*sy - sx*sxy)/nullif(s*sxx - sx*sx, 0), 4) AS intercept,
       round((s*sxy - sx*sy)/nullif(s*sxx - sx*sx, 0), 6) AS slope FROM first_fit""",
)
def weighted_line_fit(spark, sf_dir):
    pairs = parity.matched_only(parity.strike_pairs(chain(spark, sf_dir)))
    pairs = pairs.withColumns(
        {"y": F.col("call_mid") - F.col("put_mid"), "w": F.least("call_vega", "put_vega")}
    )
    fit = parity.weighted_line_fit(pairs, EXPIRY_KEY, "strike", "y", "w")
    return rounded(rounded(fit, 4, "intercept"), 6, "slope")


@register(
    "mad_prune",
    "AGG5",
    "WITH" + FORWARD_SQL + """
SELECT quote_date, root, expiration, strike, is_kept FROM flagged WHERE n >= 3""",
)
def mad_prune(spark, sf_dir):
    pruned = parity.pruned_pairs(parity.strike_pairs(chain(spark, sf_dir)))
    wanted = F.col("is_matched") & (F.col("matched_pairs_before_prune") >= 3)
    return pruned.where(wanted).select(*EXPIRY_KEY, "strike", "is_kept")


@register(
    "forward_rollup_by_date",
    "AGG8",
    "WITH" + FORWARD_SQL + """
SELECT quote_date, root, CAST(count(*) AS BIGINT) AS forward_total_expiries,
       CAST(count(*) FILTER (invalid_reason IS NULL) AS BIGINT) AS forward_valid_expiries,
       CAST(count(invalid_reason) AS BIGINT) AS forward_invalid_expiries,
       coalesce(string_agg(DISTINCT invalid_reason, ',' ORDER BY invalid_reason), '') AS reasons
FROM reasoned GROUP BY 1, 2""",
)
def forward_rollup_by_date(spark, sf_dir):
    rollup = parity.forward_rollup(chain_diagnostics(spark, sf_dir), ("quote_date", "root"))
    return rollup.withColumn("reasons", joined("forward_invalid_reason_codes")).drop("forward_invalid_reason_codes")


@register(
    "invalid_reason_summary",
    "AGG9",
    "WITH" + FORWARD_SQL.replace("n_before < 3", "n_before < 10").replace(">= 3 THEN coalesce", ">= 10 THEN coalesce")
    .replace("n_after < 3", "n_after < 10") + """
SELECT CAST(year(quote_date) AS INT) AS year, invalid_reason, CAST(count(*) AS BIGINT) AS expiries
FROM reasoned WHERE invalid_reason IS NOT NULL
GROUP BY GROUPING SETS ((1, 2), (2), (1), ())""",
)
def invalid_reason_summary(spark, sf_dir):
    return parity.invalid_reason_summary(chain_diagnostics(spark, sf_dir, min_pairs=10))


CONTRACT_COLUMNS = """quote_date, root, option_root, expiration, strike, option_type, round(discount_factor, 6) AS discount_factor,
       round(forward_price, 4) AS forward_price, round(m, 6) AS m"""


@register("contracts_with_forward", "JON2 JON3 PRJ7", "WITH" + NODES_SQL + f"SELECT {CONTRACT_COLUMNS} FROM contracts")
def contracts_with_forward(spark, sf_dir):
    rows = chain_contracts(spark, sf_dir).select(
        *EXPIRY_KEY, "option_root", "strike", "option_type", "discount_factor", "forward_price", "m"
    )
    return rounded(rounded(rows, 6, "discount_factor", "m"), 4, "forward_price")


@register(
    "dates_without_forward",
    "JON3",
    "WITH" + FORWARD_SQL.replace("n_before < 3", "n_before < 10").replace(">= 3 THEN coalesce", ">= 10 THEN coalesce")
    .replace("n_after < 3", "n_after < 10") + """
SELECT DISTINCT quote_date, root FROM chain c
WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.quote_date = c.quote_date AND t.root = c.root)""",
)
def dates_without_forward(spark, sf_dir):
    contracts = chain(spark, sf_dir)
    terms = parity.forward_terms(parity.forward_diagnostics(contracts, min_pairs=10))
    return nodes.dates_without_forward(contracts, terms)


NODE_ROWS_SQL = """
SELECT quote_date, root, expiration, strike, round(m, 6) AS m, round(node_iv, 6) AS node_iv, collapsed_contract_count FROM nodes"""


@register("collapsed_nodes", "AGG1 JON2", "WITH" + NODES_SQL + NODE_ROWS_SQL)
def collapsed_nodes(spark, sf_dir):
    """Nodes by joining given forward terms instead of carrying them along."""
    contracts = chain(spark, sf_dir)
    rows = nodes.collapse_nodes(contracts, parity.forward_terms(parity.forward_diagnostics(contracts)))
    return rounded(rows.select(*EXPIRY_KEY, "strike", "m", "node_iv", "collapsed_contract_count"), 6, "m", "node_iv")


@register(
    "surface_nodes",
    "AGG1 PRJ7",
    "WITH" + NODES_SQL + """
SELECT quote_date, root, expiration, strike, option_root, round(tau, 8) AS tau, round(m, 6) AS m,
       round(node_iv, 6) AS node_iv, round(node_vega, 6) AS node_vega,
       round(active_underlying_price_1545, 6) AS active_underlying_price_1545, trade_volume, open_interest,
       round(median_rel_spread_1545, 8) AS median_rel_spread_1545, round(forward_price, 4) AS forward_price,
       round(discount_factor, 6) AS discount_factor, collapsed_contract_count FROM nodes""",
)
def surface_nodes(spark, sf_dir):
    rows = chain_nodes(spark, sf_dir)
    rows = rounded(rows, 6, "m", "node_iv", "node_vega", "active_underlying_price_1545", "discount_factor")
    return rounded(rounded(rows, 8, "tau", "median_rel_spread_1545"), 4, "forward_price")


QUALITY_COLUMNS = """CAST(count(*) AS BIGINT) AS surface_node_count,
       CAST(count(DISTINCT expiration) AS BIGINT) AS valid_expiry_count, CAST(count(DISTINCT root) AS BIGINT) AS root_count"""


@register(
    "date_quality",
    "AGG2",
    "WITH" + NODES_SQL + f""", q AS (SELECT quote_date, root, {QUALITY_COLUMNS} FROM nodes GROUP BY 1, 2)
SELECT *, surface_node_count >= 65 AND valid_expiry_count >= 7 AND root_count = 1 AS modeling_valid FROM q""",
)
def date_quality(spark, sf_dir):
    return nodes.date_quality(chain_nodes(spark, sf_dir), 65, 7, ("quote_date", "root"))


@register(
    "mixed_root_dates",
    "AGG3",
    "WITH" + NODES_SQL + f""", q AS (SELECT quote_date, {QUALITY_COLUMNS} FROM nodes GROUP BY 1)
SELECT quote_date, surface_node_count, valid_expiry_count, root_count, false AS modeling_valid FROM q WHERE root_count > 1""",
)
def mixed_root_dates(spark, sf_dir):
    return nodes.mixed_root_dates(nodes.date_quality(chain_nodes(spark, sf_dir)))


@register(
    "valid_nodes",
    "JON6",
    "WITH" + NODES_SQL + f""", q AS (SELECT quote_date, root, {QUALITY_COLUMNS} FROM nodes GROUP BY 1, 2)
SELECT quote_date, root, expiration, strike, round(node_iv, 6) AS node_iv FROM nodes
WHERE (quote_date, root) IN (SELECT (quote_date, root) FROM q WHERE surface_node_count >= 65 AND valid_expiry_count >= 7)""",
)
def valid_nodes(spark, sf_dir):
    panel = chain_nodes(spark, sf_dir)
    by = ("quote_date", "root")
    kept = nodes.valid_nodes(panel, nodes.date_quality(panel, 65, 7, by), by)
    return rounded(kept.select(*EXPIRY_KEY, "strike", "node_iv"), 6, "node_iv")


@register(
    "state_summary",
    "AGG17",
    "WITH" + NODES_SQL + """
SELECT option_root, quote_date, round(avg(active_underlying_price_1545), 6) AS active_underlying_price_1545,
       CAST(sum(trade_volume) AS BIGINT) AS total_trade_volume, CAST(sum(open_interest) AS BIGINT) AS total_open_interest,
       round(median(median_rel_spread_1545), 8) AS median_rel_spread_1545,
       CAST(count(*) AS BIGINT) AS surface_node_count, CAST(count(DISTINCT expiration) AS BIGINT) AS valid_expiry_count
FROM nodes GROUP BY 1, 2""",
)
def state_summary(spark, sf_dir):
    summary = nodes.state_summary(chain_nodes(spark, sf_dir))
    return rounded(rounded(summary, 6, "active_underlying_price_1545"), 8, "median_rel_spread_1545")


@register(
    "concat_panels",
    "SET1 SET5",
    "WITH" + CHAIN_SQL + """
, stacked AS (SELECT quote_date, root FROM chain WHERE option_type = 'C'
              UNION ALL SELECT quote_date, root FROM chain WHERE option_type = 'P')
SELECT quote_date, root, CAST(count(*) AS BIGINT) AS rows FROM stacked GROUP BY 1, 2""",
)
def concat_panels(spark, sf_dir):
    contracts = chain(spark, sf_dir)
    calls = contracts.where("option_type = 'C'").withColumnRenamed("mid_1545", "call_mid")
    puts = contracts.where("option_type = 'P'").withColumnRenamed("mid_1545", "put_mid")
    stacked = calls.unionByName(puts, allowMissingColumns=True)
    return stacked.groupBy("quote_date", "root").agg(F.count(F.lit(1)).alias("rows"))
