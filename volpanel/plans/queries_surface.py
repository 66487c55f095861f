"""Registered queries over surface states: parameter maps, evaluation, certification and start values."""

from __future__ import annotations

from pyspark.sql import functions as F

from volpanel.functions import ssvi
from volpanel.operators import surface
from volpanel.plans import oracle_text as sql
from volpanel.plans.adapters import latent_sql, latent_states
from volpanel.plans.queries_chain import chain_nodes
from volpanel.plans.registry import register
from volpanel.plans.shape import rounded

KEEP = "quote_date, option_root"
KEY = surface.STATE_KEY
LAM = '"lambda"'
PARAMS_SQL = ", ".join(f'round("{c}", 11) AS "{c}"' for c in ssvi.PARAMETER_COLUMNS)
M_SQL = "[" + ", ".join(sql.num(v) for v in surface.certification_moneyness()) + "]"
TAU_SQL = "[" + ", ".join(sql.num(v) for v in surface.certification_taus()) + "]"


def states_sql(eta_raw: float = -1.0, crossed: bool = False) -> str:
    return latent_sql(eta_raw, crossed) + f", states AS ({sql.constrained('latent', KEEP)})"


def grid_sql(eta_raw: float = -1.0, crossed: bool = False) -> str:
    return states_sql(eta_raw, crossed) + f""",
taus AS (SELECT unnest({TAU_SQL}) AS tau, generate_subscripts({TAU_SQL}, 1) AS tau_no),
ms AS (SELECT unnest({M_SQL}) AS m, generate_subscripts({M_SQL}, 1) AS m_no),
grid AS (SELECT s.*, tau, tau_no, m, m_no FROM states s, taus, ms),
valued AS ({sql.total_variance('grid', f'{KEEP}, tau, tau_no, m, m_no, rho')}),
curved AS (
  SELECT *, 0.5e0*theta_at*phi*(rho + (km+rho)/radical) AS w1,
         0.5e0*theta_at*phi*phi*(1.0e0-rho*rho)/(radical*radical*radical) AS w2,
         greatest(total_variance, 1.0e-12) AS w FROM valued),
dense AS (
  SELECT *, (1.0e0-m*w1/(2.0e0*w))*(1.0e0-m*w1/(2.0e0*w)) - 0.25e0*w1*w1*(1.0e0/w+0.25e0) + 0.5e0*w2 AS g,
         total_variance - lag(total_variance) OVER (PARTITION BY quote_date, option_root, m_no ORDER BY tau_no) AS step
  FROM curved)
"""


def states(spark, sf_dir, eta_raw=-1.0, crossed=False):
    return ssvi.with_constrained(latent_states(spark, sf_dir, eta_raw, crossed))


@register(
    "latent_to_constrained",
    "PRJ17 WIN13 SRF7",
    "WITH" + states_sql(2.0, True) + f"SELECT {KEEP}, {PARAMS_SQL} FROM states",
)
def latent_to_constrained(spark, sf_dir):
    rows = states(spark, sf_dir, 2.0, True).select(*KEY, *ssvi.PARAMETER_COLUMNS)
    return rounded(rows, 11, *ssvi.PARAMETER_COLUMNS)


@register(
    "constrained_to_latent",
    "PRJ18",
    "WITH" + states_sql() + f"SELECT {KEEP}, "
    + ", ".join(f"round(ln(greatest({c}, 1.0e-12)), 10) AS {z}" for c, z in zip(ssvi.THETA_COLUMNS, ssvi.LATENT_COLUMNS))
    + """, round(atanh(least(greatest(rho, -0.999999e0), 0.999999e0)), 10) AS state_z_011,
  round(ln(greatest(eta, 1.0e-12)), 10) AS state_z_012, round(ln(2.0e0*"lambda"/(1.0e0-2.0e0*"lambda")), 10) AS state_z_013
FROM states""",
)
def constrained_to_latent(spark, sf_dir):
    decoded = states(spark, sf_dir).select(*KEY, *ssvi.PARAMETER_COLUMNS)
    return rounded(ssvi.with_latent(decoded).select(*KEY, *ssvi.LATENT_COLUMNS), 10, *ssvi.LATENT_COLUMNS)


@register(
    "eta_cap",
    "PRJ19",
    "WITH" + states_sql() + f"SELECT {KEEP}, round({sql.eta_cap('theta_d730', 'rho', LAM)}, 10) AS eta_cap FROM states",
)
def eta_cap(spark, sf_dir):
    cap = ssvi.eta_cap("theta_d730", "rho", "lambda")
    return rounded(states(spark, sf_dir).select(*KEY, cap.alias("eta_cap")), 10, "eta_cap")


@register(
    "parameter_validity",
    "PRJ20",
    "WITH" + states_sql(-1.0, True) + """
SELECT quote_date, option_root, theta_d030 <= t9 AND "lambda" <= 0.5e0 AND eta > 0 AND abs(rho) < 1.0e0 AS is_valid
FROM (SELECT *, CASE WHEN option_root = 'R' THEN theta_d730 ELSE theta_d010 END AS t9 FROM states)""",
)
def parameter_validity(spark, sf_dir):
    """Swap two knots for every root but one; only the untouched root stays valid."""
    rows = states(spark, sf_dir, -1.0, True)
    swapped = F.when(F.col("option_root") == "R", F.col("theta_d060")).otherwise(F.col("theta_d010"))
    return rows.withColumn("theta_d060", swapped).select(*KEY, ssvi.parameters_valid().alias("is_valid"))


@register(
    "running_max_knots",
    "WIN13",
    "WITH" + latent_sql(-1.0, True) + ", long AS ("
    + " UNION ALL ".join(f"SELECT {KEEP}, {d} AS knot_days, exp(state_z_{i:03d}) AS raised FROM latent" for i, d in enumerate(ssvi.KNOT_DAYS))
    + """)
SELECT quote_date, option_root, CAST(knot_days AS INT) AS knot_days,
       round(max(raised) OVER (PARTITION BY quote_date, option_root ORDER BY knot_days), 11) AS running_max FROM long""",
)
def running_max_knots(spark, sf_dir):
    raised = F.array(*[F.struct(F.lit(d).alias("knot_days"), F.exp(c).alias("raised")) for d, c in zip(ssvi.KNOT_DAYS, ssvi.LATENT_COLUMNS)])
    long = latent_states(spark, sf_dir, -1.0, True).select(*KEY, F.inline(raised))
    out = surface.running_max_long(long, "raised", "knot_days").drop("raised")
    return rounded(out, 11, "running_max")


@register(
    "theta_curve",
    "SRF1",
    "WITH" + states_sql() + f""", taus AS (SELECT unnest({TAU_SQL} || [0.01e0, 3.0e0]) AS tau)
SELECT {KEEP}, round(tau, 11) AS tau, round({sql.theta_curve()}, 11) AS theta FROM states, taus""",
)
def theta_curve(spark, sf_dir):
    taus = surface.literal_array([*surface.certification_taus(), 0.01, 3.0])
    rows = states(spark, sf_dir).withColumn("tau", F.explode(taus))
    return rounded(rows.select(*KEY, "tau", ssvi.theta_curve("tau").alias("theta")), 11, "tau", "theta")


@register(
    "surface_grid",
    "SRF2 SRF3 JON14",
    "WITH" + grid_sql() + """SELECT quote_date, option_root, CAST(tau_no - 1 AS INT) AS tau_no, CAST(m_no - 1 AS INT) AS m_no,
       round(total_variance, 11) AS total_variance, round(sqrt(total_variance/greatest(tau, 1.0e-12)), 11) AS implied_vol,
       round(g, 11) AS butterfly_g FROM dense""",
)
def surface_grid(spark, sf_dir):
    grid = surface.on_grid(states(spark, sf_dir), surface.certification_moneyness(), surface.certification_taus())
    valued = ssvi.with_butterfly(ssvi.with_implied_vol(grid, "implied_vol"))
    columns = ("total_variance", "implied_vol", "butterfly_g")
    return rounded(valued.select(*KEY, "tau_no", "m_no", *columns), 11, *columns)


@register(
    "calendar_residuals",
    "WIN14",
    "WITH" + grid_sql() + """SELECT quote_date, option_root, CAST(tau_no - 1 AS INT) AS tau_no, CAST(m_no - 1 AS INT) AS m_no,
       round(step, 11) AS calendar_residual FROM dense WHERE step IS NOT NULL""",
)
def calendar_residuals(spark, sf_dir):
    rows = surface.calendar_residuals(states(spark, sf_dir)).select(*KEY, "tau_no", "m_no", "calendar_residual")
    return rounded(rows, 11, "calendar_residual")


CERTIFICATE_SQL = """
SELECT quote_date, option_root,
       round(CASE WHEN count(*) FILTER (step < -1.0e-8) > 0 THEN min(step) ELSE 0.0e0 END, 11) AS max_negative_calendar_residual,
       round(CASE WHEN count(*) FILTER (g < -1.0e-8) > 0 THEN min(g) ELSE 0.0e0 END, 11) AS max_negative_butterfly_residual,
       CAST(count(*) FILTER (step < -1.0e-8) AS BIGINT) AS calendar_violation_count,
       CAST(count(*) FILTER (g < -1.0e-8) AS BIGINT) AS butterfly_violation_count,
       count(*) FILTER (step < -1.0e-8) = 0 AND count(*) FILTER (g < -1.0e-8) = 0 AS passes_static_arb
FROM dense GROUP BY 1, 2"""
RESIDUALS = ("max_negative_calendar_residual", "max_negative_butterfly_residual")


@register("certification", "SRF4 JON14 WIN14", "WITH" + grid_sql() + CERTIFICATE_SQL)
def certification(spark, sf_dir):
    return rounded(surface.certify(states(spark, sf_dir)), 11, *RESIDUALS)


BROKEN_ETA = 8.0


@register(
    "certification_violations",
    "SRF4",
    "WITH" + grid_sql().replace("FROM states s, taus, ms", f"FROM (SELECT * REPLACE ({BROKEN_ETA}e0 AS eta, theta_d010 AS theta_d730) FROM states) s, taus, ms")
    + CERTIFICATE_SQL,
)
def certification_violations(spark, sf_dir):
    """An eta far beyond its cap and a falling last knot must be caught."""
    broken = states(spark, sf_dir).withColumns({"eta": F.lit(BROKEN_ETA), "theta_d730": F.col("theta_d010")})
    return rounded(surface.certify(broken), 11, *RESIDUALS)


# --- start values from nodes ------------------------------------------------------------------

RANKED_SQL = sql.NODES_SQL + ", ranked AS (SELECT *, " + ", ".join(
    f"row_number() OVER (PARTITION BY option_root, quote_date ORDER BY abs(tau - {sql.num(t)}), abs(m), expiration, strike) AS r{i}"
    for i, t in enumerate(ssvi.KNOT_TAUS)
) + " FROM nodes)"


@register(
    "nearest_nodes",
    "JON12 SRT2",
    "WITH" + RANKED_SQL + "\n" + " UNION ALL ".join(
        f"SELECT option_root, quote_date, {i} AS target_no, expiration, strike, round(m, 6) AS m, round(node_iv, 6) AS node_iv FROM ranked WHERE r{i} = 1 "
        for i in range(11)
    ),
)
def nearest_nodes(spark, sf_dir):
    rows = surface.nearest_nodes(chain_nodes(spark, sf_dir))
    return rounded(rows.select(*KEY, "target_no", "expiration", "strike", "m", "node_iv"), 6, "m", "node_iv")


@register(
    "skew_start",
    "AGG28",
    "WITH" + sql.NODES_SQL + """,
skew AS (SELECT option_root, quote_date, CASE WHEN NOT isnan(regr_slope(node_iv, m) FILTER (abs(m) <= 0.25e0)) THEN regr_slope(node_iv, m) FILTER (abs(m) <= 0.25e0) END AS slope,
                count(*) FILTER (abs(m) <= 0.25e0) AS n FROM nodes GROUP BY 1, 2)
SELECT option_root, quote_date, round(slope, 5) AS skew_slope, CAST(n AS BIGINT) AS skew_samples,
       round(CASE WHEN n >= 3 THEN least(greatest(tanh(-8.0e0*slope), -0.8e0), 0.8e0) ELSE -0.4e0 END, 5) AS rho FROM skew""",
)
def skew_start(spark, sf_dir):
    return rounded(surface.skew_start(chain_nodes(spark, sf_dir)), 5, "skew_slope", "rho")


INITIAL_SQL = RANKED_SQL + """,
guess AS (
  SELECT option_root, quote_date, """ + ", ".join(
    f"greatest({sql.num(t)}*max(node_iv) FILTER (r{i} = 1)*max(node_iv) FILTER (r{i} = 1), 1.0e-6) AS t{i}" for i, t in enumerate(ssvi.KNOT_TAUS)
) + """, regr_slope(node_iv, m) FILTER (abs(m) <= 0.25e0) AS slope, count(*) FILTER (abs(m) <= 0.25e0) AS n
  FROM ranked GROUP BY 1, 2),
raised AS (
  SELECT option_root, quote_date, """ + ", ".join(
    (f"greatest({', '.join(f't{j}' for j in range(i + 1))})" if i else "t0") + f" AS {c}" for i, c in enumerate(ssvi.THETA_COLUMNS)
) + """, CASE WHEN n >= 3 THEN least(greatest(tanh(-8.0e0*slope), -0.8e0), 0.8e0) ELSE -0.4e0 END AS rho, 0.25e0 AS "lambda"
  FROM guess),
initial AS (SELECT *, least(0.75e0, 0.8e0*""" + sql.eta_cap("theta_d730", "rho", LAM) + """) AS eta FROM raised)
"""


@register(
    "initial_surface",
    "SRF5 AGG28 PRJ19",
    "WITH" + INITIAL_SQL + "SELECT option_root, quote_date, " + ", ".join(f'round("{c}", 5) AS "{c}"' for c in ssvi.PARAMETER_COLUMNS) + " FROM initial",
)
def initial_surface(spark, sf_dir):
    rows = surface.initial_surface(chain_nodes(spark, sf_dir))
    return rounded(rows.select(*KEY, *ssvi.PARAMETER_COLUMNS), 5, *ssvi.PARAMETER_COLUMNS)
