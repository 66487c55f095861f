"""Registered queries on fits and forecasts: calibration, node and contract scores, hedges and straddles.

The forecast scored here is persistence of the starting surface to the next quoted date of the same
root, so that every number has an exact SQL twin; the fitted models are in ``queries_forecast``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from volpanel.functions import ssvi
from volpanel.functions.mathx import huber, normal_cdf
from volpanel.operators import calibrate, nodes, parity, score, surface
from volpanel.plans import oracle_text as sql
from volpanel.plans.adapters import chain, monthly_sql, table
from volpanel.plans.queries_chain import chain_contracts, chain_nodes
from volpanel.plans.queries_surface import CERTIFICATE_SQL, INITIAL_SQL, M_SQL, RESIDUALS, TAU_SQL
from volpanel.plans.registry import register
from volpanel.plans.shape import rounded
from volpanel.session import cut_lineage

KEY = surface.STATE_KEY
PARAMS = ", ".join(f'"{c}"' for c in ssvi.PARAMETER_COLUMNS)
FORECAST = "model_name, option_root, forecast_origin, target_date"
METRICS = ("rmse_iv", "mae_iv", "mape_iv_clipped", "vega_rmse_iv")

MODELS_SQL = INITIAL_SQL + f""",
steps AS (SELECT option_root, quote_date, lead(quote_date) OVER (PARTITION BY option_root ORDER BY quote_date) AS target_date
          FROM (SELECT DISTINCT option_root, quote_date FROM nodes)),
damped AS (SELECT option_root, quote_date, {', '.join(f'{c}*1.02e0 AS {c}' for c in ssvi.THETA_COLUMNS)}, rho, eta, "lambda" FROM initial),
forecasts AS (
  SELECT 'state_last' AS model_name, option_root, quote_date AS forecast_origin, target_date, {PARAMS}
  FROM initial JOIN steps USING (option_root, quote_date) WHERE target_date IS NOT NULL
  UNION ALL
  SELECT 'state_up' AS model_name, option_root, quote_date AS forecast_origin, target_date, {PARAMS}
  FROM damped JOIN steps USING (option_root, quote_date) WHERE target_date IS NOT NULL)
"""


class Panel:
    """Contracts, nodes and forecasts of one chain, staged once for all their consumers.

    The stages are reliable checkpoints, so the table scan behind them runs a single time.
    """

    def __init__(self, spark, sf_dir, period="quarter"):
        raw = cut_lineage(chain(spark, sf_dir, period))
        strikes = cut_lineage(parity.with_forward(nodes.strike_table(raw)))
        terms = parity.forward_terms(parity.diagnostics_of(strikes))
        self.contracts = nodes.contracts_with_forward(raw, terms)
        self.nodes = nodes.nodes_of(strikes)
        self.states = cut_lineage(surface.initial_surface(self.nodes).select(*KEY, *ssvi.PARAMETER_COLUMNS))

    def next_dates(self):
        """Next quoted date per root: one row per root and date, windowed per root."""
        order = Window.partitionBy("option_root").orderBy("quote_date")
        dated = self.states.select(*KEY, F.lead("quote_date").over(order).alias("target_date"))
        return dated.where("target_date IS NOT NULL")

    def forecasts(self):
        """Two persistence forecasts: the starting surface, and the same with all variances two percent up."""
        order = Window.partitionBy("option_root").orderBy("quote_date")
        dated = self.states.withColumn("target_date", F.lead("quote_date").over(order)).where("target_date IS NOT NULL")
        models = F.array(
            F.struct(F.lit("state_last").alias("model_name"), F.lit(1.0).alias("factor")),
            F.struct(F.lit("state_up").alias("model_name"), F.lit(1.02).alias("factor")),
        )
        both = dated.withColumnRenamed("quote_date", "forecast_origin").select("*", F.inline(models))
        scaled = both.withColumns({c: F.col(c) * F.col("factor") for c in ssvi.THETA_COLUMNS})
        return scaled.select(*score.FORECAST_KEY, *ssvi.PARAMETER_COLUMNS)

    def predicted_nodes(self):
        return score.node_forecasts(self.forecasts(), self.nodes)

    def priced_contracts(self):
        return score.contract_forecasts(self.forecasts(), self.contracts)

    def hedged(self):
        carried = score.carried_contracts(self.contracts, self.priced_contracts())
        return score.hedged_utility(carried, score.hedge_buckets(self.contracts))

    def straddles(self):
        pairs = score.straddle_pairs(self.contracts)
        carried = score.carried_straddles(pairs, self.contracts, self.next_dates())
        return score.straddle_returns(carried, self.states, self.forecasts())


NODE_FORECAST_SQL = MODELS_SQL + f""",
matched_nodes AS (
  SELECT n.root, n.expiration, n.strike, n.m, n.tau, n.node_iv, n.node_vega, f.*
  FROM nodes n JOIN forecasts f ON f.option_root = n.option_root AND f.target_date = n.quote_date),
node_valued AS ({sql.total_variance('matched_nodes', FORECAST + ', root, expiration, strike, m, tau, node_iv, node_vega, rho')}),
predicted AS (SELECT *, sqrt(total_variance/greatest(tau, 1.0e-12)) AS predicted_iv FROM node_valued),
loss_panel AS (
  SELECT {FORECAST}, sqrt(avg((predicted_iv-node_iv)*(predicted_iv-node_iv))) AS rmse_iv, avg(abs(predicted_iv-node_iv)) AS mae_iv,
         avg(abs(predicted_iv-node_iv)/greatest(node_iv, 1.0e-4)) AS mape_iv_clipped,
         sqrt(sum(node_vega*(predicted_iv-node_iv)*(predicted_iv-node_iv))/greatest(sum(node_vega), 1.0e-12)) AS vega_rmse_iv
  FROM predicted GROUP BY 1, 2, 3, 4)
"""


@register(
    "node_forecasts",
    "SRF8 JON13 SRF2",
    "WITH" + NODE_FORECAST_SQL + f"SELECT {FORECAST}, root, expiration, strike, round(node_iv, 6) AS node_iv, round(predicted_iv, 6) AS predicted_iv FROM predicted",
)
def node_forecasts(spark, sf_dir):
    rows = Panel(spark, sf_dir).predicted_nodes()
    return rounded(
        rows.select(*score.FORECAST_KEY, "root", "expiration", "strike", "node_iv", "predicted_iv"), 6, "node_iv", "predicted_iv"
    )


@register(
    "loss_panel",
    "AGG18 SRF8",
    "WITH" + NODE_FORECAST_SQL + f"SELECT {FORECAST}, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRICS) + " FROM loss_panel",
)
def loss_panel(spark, sf_dir):
    return rounded(score.node_losses(Panel(spark, sf_dir).predicted_nodes()), 6, *METRICS)


@register(
    "loss_summary",
    "AGG25 SRT1",
    "WITH" + NODE_FORECAST_SQL + "SELECT model_name, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRICS) + " FROM loss_panel GROUP BY 1",
)
def loss_summary(spark, sf_dir):
    columns = ("vega_rmse_iv", "rmse_iv", "mae_iv", "mape_iv_clipped")
    return rounded(score.summary_table(score.node_losses(Panel(spark, sf_dir).predicted_nodes()), columns), 6, *columns)


FORECAST_GRID_SQL = MODELS_SQL + f""",
taus AS (SELECT unnest({TAU_SQL}) AS tau, generate_subscripts({TAU_SQL}, 1) AS tau_no),
ms AS (SELECT unnest({M_SQL}) AS m, generate_subscripts({M_SQL}, 1) AS m_no),
grid AS (SELECT f.*, tau, tau_no, m, m_no FROM forecasts f, taus, ms),
grid_valued AS ({sql.total_variance('grid', FORECAST + ', tau, tau_no, m, m_no, rho')}),
curved AS (
  SELECT *, 0.5e0*theta_at*phi*(rho + (km+rho)/radical) AS w1,
         0.5e0*theta_at*phi*phi*(1.0e0-rho*rho)/(radical*radical*radical) AS w2, greatest(total_variance, 1.0e-12) AS w FROM grid_valued),
dense AS (
  SELECT *, (1.0e0-m*w1/(2.0e0*w))*(1.0e0-m*w1/(2.0e0*w)) - 0.25e0*w1*w1*(1.0e0/w+0.25e0) + 0.5e0*w2 AS g,
         total_variance - lag(total_variance) OVER (PARTITION BY {FORECAST}, m_no ORDER BY tau_no) AS step FROM curved)
"""


@register(
    "forecast_certificates",
    "SRF4 SRF8",
    "WITH" + FORECAST_GRID_SQL + CERTIFICATE_SQL.replace("SELECT quote_date, option_root,", f"SELECT {FORECAST},").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3, 4"),
)
def forecast_certificates(spark, sf_dir):
    return rounded(score.forecast_certificates(Panel(spark, sf_dir).forecasts()), 11, *RESIDUALS)


D1 = "(ln(forward_price/strike)/width + 0.5e0*width)"
PRICED_SQL = MODELS_SQL + f""",
matched_contracts AS (
  SELECT c.root, c.expiration, c.strike, c.option_type, c.m, c.tau, c.mid_1545, c.bid_1545, c.ask_1545, c.forward_price, c.discount_factor,
         c.active_underlying_price_1545, f.*
  FROM contracts c JOIN forecasts f ON f.option_root = c.option_root AND f.target_date = c.quote_date),
contract_valued AS ({sql.total_variance('matched_contracts', FORECAST + ', root, expiration, strike, option_type, m, tau, mid_1545, bid_1545, ask_1545, forward_price, discount_factor, active_underlying_price_1545, rho')}),
widths AS (
  SELECT *, sqrt(total_variance/greatest(tau, 1.0e-12)) AS predicted_iv,
         greatest(sqrt(total_variance/greatest(tau, 1.0e-12)), 1.0e-6)*sqrt(greatest(tau, 1.0e-8)) AS width,
         CASE WHEN option_type = 'C' THEN 1.0e0 ELSE -1.0e0 END AS side FROM contract_valued),
arguments AS (SELECT *, side*{D1} AS x1, side*({D1} - width) AS x2 FROM widths),
priced_contracts AS (
  SELECT *, discount_factor*side*(forward_price*{sql.normal_cdf('x1')} - strike*{sql.normal_cdf('x2')}) AS predicted_price FROM arguments),
pricing AS (
  SELECT {FORECAST}, sqrt(avg((predicted_price-mid_1545)*(predicted_price-mid_1545))) AS price_rmse,
         avg(abs(predicted_price-mid_1545)) AS price_mae,
         avg(CASE WHEN predicted_price >= bid_1545 AND predicted_price <= ask_1545 THEN 1.0e0 ELSE 0.0e0 END) AS inside_spread_rate
  FROM priced_contracts GROUP BY 1, 2, 3, 4)
"""


@register(
    "contract_forecasts",
    "SRF9 SRF10 JON13",
    "WITH" + PRICED_SQL + f"""SELECT {FORECAST}, root, expiration, strike, option_type, round(predicted_iv, 6) AS predicted_iv,
       round(predicted_price, 4) AS predicted_price FROM priced_contracts""",
)
def contract_forecasts(spark, sf_dir):
    rows = Panel(spark, sf_dir).priced_contracts().select(
        *score.FORECAST_KEY, "root", "expiration", "strike", "option_type", "predicted_iv", "predicted_price"
    )
    return rounded(rounded(rows, 6, "predicted_iv"), 4, "predicted_price")


@register(
    "pricing_utility",
    "AGG19 SRF10",
    "WITH" + PRICED_SQL + f"SELECT {FORECAST}, round(price_rmse, 4) AS price_rmse, round(price_mae, 4) AS price_mae, round(inside_spread_rate, 6) AS inside_spread_rate FROM pricing",
)
def pricing_utility(spark, sf_dir):
    rows = score.pricing_utility(Panel(spark, sf_dir).priced_contracts())
    return rounded(rounded(rows, 4, "price_rmse", "price_mae"), 6, "inside_spread_rate")


@register(
    "normal_distribution",
    "SRF9",
    f"""WITH z AS (SELECT l_orderkey, l_linenumber, (l_discount - 0.05e0)*100.0e0 + l_quantity/25.0e0 - 1.0e0 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round({sql.normal_cdf('x')}, 10) AS p FROM z""",
)
def normal_distribution(spark, sf_dir):
    x = (F.col("l_discount") - 0.05) * 100.0 + F.col("l_quantity") / 25.0 - 1.0
    rows = table(spark, sf_dir, "lineitem").withColumn("x", x)
    return rounded(rows.select("l_orderkey", "l_linenumber", normal_cdf(F.col("x")).alias("p")), 10, "p")


# --- hedged moves and straddles -----------------------------------------------------------------

BUCKET_SQL = ", buckets AS (" + " UNION ALL ".join(
    f"""SELECT option_root, quote_date, '{name}' AS bucket, root, expiration, strike, option_type FROM (
    SELECT *, row_number() OVER (PARTITION BY option_root, quote_date ORDER BY abs(tau - {sql.num(days / 365.0)}), abs(m), root, expiration, strike) AS r
    FROM contracts WHERE option_type = '{side}') WHERE r = 1"""
    for name, side, days in score.HEDGE_BUCKETS
) + ")"


@register(
    "hedge_buckets",
    "JON12 SRT2 AGG20",
    "WITH" + monthly_sql(sql.NODES_SQL) + BUCKET_SQL + " SELECT * FROM buckets",
)
def hedge_buckets(spark, sf_dir):
    return score.hedge_buckets(chain_contracts(spark, sf_dir, "month"))


CARRIED_SQL = PRICED_SQL + BUCKET_SQL + f""",
carried AS (
  SELECT p.model_name, p.option_root, p.forecast_origin, p.target_date, p.root, p.expiration, p.strike, p.option_type,
         c.mid_1545, p.mid_1545 AS mid_1545_t1, p.predicted_price,
         c.delta_1545*(p.active_underlying_price_1545 - c.active_underlying_price_1545) AS hedge
  FROM priced_contracts p JOIN contracts c ON c.quote_date = p.forecast_origin AND c.option_root = p.option_root AND c.root = p.root
   AND c.expiration = p.expiration AND c.strike = p.strike AND c.option_type = p.option_type),
hedge_errors AS (SELECT *, ((predicted_price - mid_1545) - hedge) - ((mid_1545_t1 - mid_1545) - hedge) AS e FROM carried),
bucketed AS (
  SELECT {FORECAST}, 'all' AS bucket, e FROM hedge_errors
  UNION ALL SELECT {', '.join('h.' + c.strip() for c in FORECAST.split(','))}, b.bucket, h.e FROM hedge_errors h JOIN buckets b ON b.quote_date = h.forecast_origin
   AND b.option_root = h.option_root AND b.root = h.root AND b.expiration = h.expiration AND b.strike = h.strike AND b.option_type = h.option_type)
"""


@register(
    "carried_contracts",
    "JON4",
    "WITH" + monthly_sql(CARRIED_SQL) + f"SELECT {FORECAST}, expiration, strike, option_type, round(mid_1545, 6) AS mid_1545, round(mid_1545_t1, 6) AS mid_1545_t1 FROM carried",
)
def carried_contracts(spark, sf_dir):
    panel = Panel(spark, sf_dir, "month")
    rows = score.carried_contracts(panel.contracts, panel.priced_contracts())
    return rounded(
        rows.select(*score.FORECAST_KEY, "expiration", "strike", "option_type", "mid_1545", "mid_1545_t1"), 6, "mid_1545", "mid_1545_t1"
    )


@register(
    "hedged_utility",
    "AGG20 JON4",
    "WITH" + monthly_sql(CARRIED_SQL) + f"SELECT {FORECAST}, bucket, round(sqrt(avg(e*e)), 4) AS hedged_pnl_rmse, round(avg(abs(e)), 4) AS hedged_pnl_mae FROM bucketed GROUP BY 1, 2, 3, 4, 5",
)
def hedged_utility(spark, sf_dir):
    return rounded(Panel(spark, sf_dir, "month").hedged(), 4, "hedged_pnl_rmse", "hedged_pnl_mae")


STRADDLE_SQL = MODELS_SQL + """,
pair_legs AS (
  SELECT option_root, quote_date, root, expiration, strike, sum(mid_1545) AS gross_premium, sum(spread_1545) AS total_spread, min(tau) AS tau, avg(abs(m)) AS m
  FROM contracts GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT option_type) = 2),
straddles AS (""" + " UNION ALL ".join(
    f"""SELECT option_root, quote_date, {d} AS anchor_days, root, expiration, strike, gross_premium, total_spread FROM (
    SELECT *, row_number() OVER (PARTITION BY option_root, quote_date ORDER BY abs(tau - {sql.num(d / 365.0)}), abs(m), root, expiration, strike) AS r FROM pair_legs) WHERE r = 1"""
    for d in score.STRADDLE_ANCHORS
) + """),
later AS (
  SELECT option_root, quote_date AS target_date, root, expiration, strike, sum(mid_1545) AS next_premium, sum(spread_1545) AS next_spread
  FROM contracts GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2),
carried_pairs AS (
  SELECT s.*, t.target_date, l.next_premium, l.next_spread FROM straddles s JOIN steps t USING (option_root, quote_date)
  JOIN later l ON l.option_root = s.option_root AND l.target_date = t.target_date AND l.root = s.root AND l.expiration = s.expiration AND l.strike = s.strike),
anchors AS (SELECT unnest([30, 91]) AS anchor_days),
now_in AS (SELECT i.*, anchor_days, anchor_days/365.0e0 AS tau FROM initial i, anchors),
now_iv AS (SELECT option_root, quote_date, anchor_days, sqrt(total_variance/tau) AS iv FROM (""" + sql.total_variance("now_in", "option_root, quote_date, anchor_days, tau", "0.0e0") + f""")),
ahead_in AS (SELECT f.*, anchor_days, anchor_days/365.0e0 AS tau FROM forecasts f, anchors),
ahead_iv AS (SELECT {FORECAST}, anchor_days, sqrt(total_variance/tau) AS iv FROM ({sql.total_variance('ahead_in', FORECAST + ', anchor_days, tau', '0.0e0')})),
returns AS (
  SELECT a.model_name, a.option_root, a.forecast_origin, a.target_date, c.root, a.anchor_days,
         (CASE WHEN a.iv - n.iv > 0 THEN 1.0e0 ELSE -1.0e0 END)*(next_premium - gross_premium)/greatest(gross_premium, 1.0e-12) AS gross_return,
         0.5e0*(total_spread + next_spread)/greatest(gross_premium, 1.0e-12) AS cost
  FROM ahead_iv a JOIN now_iv n ON n.option_root = a.option_root AND n.quote_date = a.forecast_origin AND n.anchor_days = a.anchor_days
  JOIN carried_pairs c ON c.option_root = a.option_root AND c.quote_date = a.forecast_origin AND c.target_date = a.target_date AND c.anchor_days = a.anchor_days)
"""


@register(
    "straddle_pairs",
    "AGG21 JON12",
    "WITH" + monthly_sql(STRADDLE_SQL) + "SELECT option_root, quote_date, CAST(anchor_days AS INT) AS anchor_days, root, expiration, strike, round(gross_premium, 6) AS gross_premium, round(total_spread, 6) AS total_spread FROM straddles",
)
def straddle_pairs(spark, sf_dir):
    return rounded(score.straddle_pairs(chain_contracts(spark, sf_dir, "month")), 6, "gross_premium", "total_spread")


@register(
    "carried_straddles",
    "JON5",
    "WITH" + monthly_sql(STRADDLE_SQL) + "SELECT option_root, quote_date, target_date, CAST(anchor_days AS INT) AS anchor_days, expiration, strike, round(next_premium, 6) AS next_premium FROM carried_pairs",
)
def carried_straddles(spark, sf_dir):
    panel = Panel(spark, sf_dir, "month")
    rows = score.carried_straddles(score.straddle_pairs(panel.contracts), panel.contracts, panel.next_dates())
    return rounded(rows.select(*KEY, "target_date", "anchor_days", "expiration", "strike", "next_premium"), 6, "next_premium")


@register(
    "straddle_returns",
    "AGG22",
    "WITH" + monthly_sql(STRADDLE_SQL) + f"SELECT {FORECAST}, root, CAST(anchor_days AS INT) AS anchor_days, round(gross_return, 6) AS gross_return, round(gross_return - cost, 6) AS net_return FROM returns",
)
def straddle_returns(spark, sf_dir):
    return rounded(Panel(spark, sf_dir, "month").straddles(), 6, "gross_return", "net_return")


STRADDLE_MEANS = "round(avg(gross_return - cost), 6) AS mean_net_return, round(avg(CASE WHEN gross_return - cost > 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_rate"


@register(
    "straddle_summary",
    "AGG23",
    "WITH" + monthly_sql(STRADDLE_SQL) + f"SELECT model_name, CAST(anchor_days AS INT) AS anchor_days, {STRADDLE_MEANS}, round(avg(gross_return - cost)/greatest(stddev_samp(gross_return - cost), 1.0e-12), 5) AS sharpe_ratio FROM returns GROUP BY 1, 2",
)
def straddle_summary(spark, sf_dir):
    rows = score.straddle_summary(Panel(spark, sf_dir, "month").straddles())
    return rounded(rounded(rows, 6, "mean_net_return", "hit_rate"), 5, "sharpe_ratio")


@register(
    "annualized_straddle",
    "AGG24",
    "WITH" + monthly_sql(STRADDLE_SQL) + f"SELECT model_name, CAST(anchor_days AS INT) AS anchor_days, round(avg(gross_return), 6) AS mean_gross_return, {STRADDLE_MEANS}, round(CASE WHEN stddev_samp(gross_return - cost) > 0 THEN sqrt(252.0e0)*avg(gross_return - cost)/stddev_samp(gross_return - cost) ELSE 0.0e0 END, 4) AS sharpe_ratio FROM returns GROUP BY 1, 2",
)
def annualized_straddle(spark, sf_dir):
    rows = score.annualized_straddle(Panel(spark, sf_dir, "month").straddles())
    return rounded(rounded(rows, 6, "mean_gross_return", "mean_net_return", "hit_rate"), 4, "sharpe_ratio")


@register(
    "hedged_summary",
    "AGG25",
    "WITH" + monthly_sql(CARRIED_SQL) + f"""SELECT model_name, bucket, round(avg(rmse), 4) AS hedged_pnl_rmse, round(avg(mae), 4) AS hedged_pnl_mae FROM (
  SELECT {FORECAST}, bucket, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae FROM bucketed GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2""",
)
def hedged_summary(spark, sf_dir):
    columns = ("hedged_pnl_rmse", "hedged_pnl_mae")
    return rounded(score.summary_table(Panel(spark, sf_dir, "month").hedged(), columns, ("model_name", "bucket")), 4, *columns)


# --- calibration ------------------------------------------------------------------------------

def lattice_values(axis: list[float]) -> str:
    return ", ".join(f"({i}, {sql.num(v)})" for i, v in enumerate(axis))


def lattice_sql(lattice: calibrate.Lattice) -> str:
    thetas = ssvi.THETA_COLUMNS
    sides = ", ".join(
        f"""max(struct_pack(tau := tau, w := w)) FILTER (tau <= {sql.num(t)}) AS l{i}, min(struct_pack(tau := tau, w := w)) FILTER (tau >= {sql.num(t)}) AS r{i}"""
        for i, t in enumerate(ssvi.KNOT_TAUS)
    )
    guesses = ", ".join(
        f"""greatest(CASE WHEN l{i} IS NULL THEN r{i}.w*{sql.num(t)}/r{i}.tau WHEN r{i} IS NULL THEN l{i}.w*{sql.num(t)}/l{i}.tau
            WHEN r{i}.tau > l{i}.tau THEN l{i}.w + (r{i}.w - l{i}.w)*(({sql.num(t)} - l{i}.tau)/nullif(r{i}.tau - l{i}.tau, 0.0e0)) ELSE l{i}.w END, 1.0e-6) AS g{i}"""
        for i, t in enumerate(ssvi.KNOT_TAUS)
    )
    raised = ", ".join(
        (f"greatest({', '.join(f'g{j}' for j in range(i + 1))})" if i else "g0") + f" AS {c}" for i, c in enumerate(thetas)
    )
    text = sql.NODES_SQL + f""",
atm AS (SELECT option_root, quote_date, expiration, tau, tau*node_iv*node_iv AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY option_root, quote_date, expiration ORDER BY abs(m), strike) AS r FROM nodes) WHERE r = 1),
sides AS (SELECT option_root, quote_date, {sides} FROM atm GROUP BY 1, 2),
guessed AS (SELECT option_root, quote_date, {guesses} FROM sides),
knots AS MATERIALIZED (SELECT option_root, quote_date, {raised} FROM guessed),
at_nodes AS MATERIALIZED (SELECT option_root, quote_date, m, tau, node_iv, node_vega, greatest({sql.theta_curve()}, 1.0e-12) AS theta_at
  FROM nodes JOIN knots USING (option_root, quote_date)),
best0 AS (SELECT option_root, quote_date, theta_d730, {sql.num(lattice.rho[0])} AS rho, {sql.num(lattice.log_eta[0])} AS log_eta,
                 {sql.num(lattice.lam[0])} AS lam, {sql.num(lattice.scale[0])} AS scale, 0.0e0 AS loss FROM knots)"""
    for r in range(len(lattice.steps)):
        axes, counts = lattice.axes(r), lattice.steps[r]
        text += f""",
tried{r} AS (
  SELECT option_root, quote_date, candidate_id, theta_d730, rho, lam, scale, least(exp(log_eta), {sql.eta_cap('theta_d730*scale', 'rho', 'lam')}) AS eta
  FROM (SELECT b.option_root, b.quote_date, b.theta_d730, ((a.i*{counts[1]} + e.i)*{counts[2]} + l.i)*{counts[3]} + s.i AS candidate_id,
               least(greatest(b.rho + a.v, -0.98e0), 0.98e0) AS rho, b.log_eta + e.v AS log_eta,
               least(greatest(b.lam + l.v, 1.0e-6), 0.499999e0) AS lam, b.scale + s.v AS scale
        FROM best{r} b, (VALUES {lattice_values(axes[0])}) a(i, v), (VALUES {lattice_values(axes[1])}) e(i, v),
             (VALUES {lattice_values(axes[2])}) l(i, v), (VALUES {lattice_values(axes[3])}) s(i, v))),
scored{r} AS (
  SELECT option_root, quote_date, candidate_id, sum(node_vega*CASE WHEN abs(err) <= 0.01e0 THEN 0.5e0*err*err ELSE 0.01e0*(abs(err) - 0.005e0) END)/sum(node_vega) AS loss
  FROM (SELECT option_root, quote_date, candidate_id, node_vega,
               sqrt(0.5e0*t*(1.0e0 + rho*k + sqrt((k+rho)*(k+rho) + 1.0e0 - rho*rho))/tau) - node_iv AS err
        FROM (SELECT *, eta*pow(t, -lam)*m AS k FROM (
          SELECT n.*, c.candidate_id, c.rho, c.eta, c.lam, n.theta_at*c.scale AS t FROM at_nodes n JOIN tried{r} c USING (option_root, quote_date))))
  GROUP BY 1, 2, 3),
best{r + 1} AS MATERIALIZED (
  SELECT c.option_root, c.quote_date, c.theta_d730, c.rho, ln(c.eta) AS log_eta, c.lam, c.scale, s.loss
  FROM (SELECT *, row_number() OVER (PARTITION BY option_root, quote_date ORDER BY round(loss, {calibrate.LOSS_DIGITS}), candidate_id) AS r FROM scored{r}) s
  JOIN tried{r} c USING (option_root, quote_date, candidate_id) WHERE s.r = 1)"""
    return text + f""",
fitted AS (SELECT option_root, quote_date, {', '.join(f'k.{c}*b.scale AS {c}' for c in thetas)}, b.rho, exp(b.log_eta) AS eta, b.lam AS "lambda", b.loss
  FROM best{len(lattice.steps)} b JOIN knots k USING (option_root, quote_date))
"""


LATTICE = calibrate.Lattice()


@register(
    "lattice_calibration",
    "SRF6 AGG26",
    "WITH" + lattice_sql(LATTICE) + "SELECT option_root, quote_date, round(loss, 9) AS loss, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in ssvi.PARAMETER_COLUMNS) + " FROM fitted",
)
def lattice_calibration(spark, sf_dir):
    rows = calibrate.lattice_fit(chain_nodes(spark, sf_dir))
    return rounded(rounded(rows, 6, *ssvi.PARAMETER_COLUMNS), 9, "loss")


@register(
    "refined_calibration",
    "SRF6",
    "WITH" + lattice_sql(LATTICE) + "SELECT option_root, quote_date, round(loss, 9) AS lattice_loss, true AS not_worse, true AS loss_agrees, true AS converged FROM fitted",
)
def refined_calibration(spark, sf_dir):
    """Refined against lattice loss; the returned parameters' loss is computed again by the surface expressions."""
    panel = cut_lineage(chain_nodes(spark, sf_dir))
    lattice = cut_lineage(calibrate.lattice_fit(panel))
    refined = cut_lineage(calibrate.refine_fit(panel, lattice))
    error = F.col("predicted_iv") - F.col("node_iv")
    again = ssvi.with_implied_vol(panel.join(refined.select(*KEY, *ssvi.PARAMETER_COLUMNS), list(KEY))).groupBy(*KEY).agg(
        (F.sum(F.col("node_vega") * huber(error, score.HUBER_DELTA)) / F.sum("node_vega")).alias("again")
    )
    found = refined.select(*KEY, "loss", "converged").join(again, list(KEY)).join(lattice.select(*KEY, F.col("loss").alias("lattice_loss")), list(KEY))
    return rounded(
        found.select(
            *KEY,
            "lattice_loss",
            (F.col("loss") <= F.col("lattice_loss") + 1e-15).alias("not_worse"),
            (F.abs(F.col("loss") - F.col("again")) <= 1e-12).alias("loss_agrees"),
            "converged",
        ),
        9,
        "lattice_loss",
    )


FIT_SQL = INITIAL_SQL + f""",
fit_in AS (SELECT n.m, n.tau, n.node_iv, n.node_vega, i.* FROM nodes n JOIN initial i USING (option_root, quote_date)),
fit_valued AS ({sql.total_variance('fit_in', 'option_root, quote_date, tau, node_iv, node_vega')}),
fit_errors AS (SELECT *, sqrt(total_variance/greatest(tau, 1.0e-12)) - node_iv AS e FROM fit_valued)
"""


@register(
    "fit_diagnostics",
    "AGG30 AGG26",
    "WITH" + FIT_SQL + """SELECT option_root, quote_date, round(sqrt(avg(e*e)), 6) AS fit_rmse_iv,
       round(sqrt(sum(node_vega*e*e)/sum(node_vega)), 6) AS fit_vega_rmse_iv, round(avg(abs(e)), 6) AS fit_mae_iv,
       round(sum(node_vega*CASE WHEN abs(e) <= 0.01e0 THEN 0.5e0*e*e ELSE 0.01e0*(abs(e) - 0.005e0) END)/sum(node_vega), 8) AS final_loss,
       CAST(count(*) AS BIGINT) AS node_count FROM fit_errors GROUP BY 1, 2""",
)
def fit_diagnostics(spark, sf_dir):
    panel = chain_nodes(spark, sf_dir)
    fitted = calibrate.fitted_nodes(panel, surface.initial_surface(panel))
    return rounded(rounded(score.fit_diagnostics(fitted), 6, "fit_rmse_iv", "fit_vega_rmse_iv", "fit_mae_iv"), 8, "final_loss")
