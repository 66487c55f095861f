"""Oracle SQL fragments used by several queries."""

from __future__ import annotations

from volpanel.functions import mathx
from volpanel.functions.ssvi import KNOT_TAUS, LATENT_COLUMNS, THETA_COLUMNS
from volpanel.plans.adapters import CHAIN_SQL


def num(value: float) -> str:
    """A double literal in both engines."""
    return f"CAST({value!r} AS DOUBLE)"


def horner(x: str, coefficients: tuple[float, ...]) -> str:
    text = num(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text}*{x}+{num(c)})"
    return text


def normal_cdf(x: str) -> str:
    size = f"abs({x})"
    density = f"exp(-{size}*{size}/2.0e0)"
    centre = f"{density}*{horner(size, mathx.NORMAL_NUMERATOR)}/{horner(size, mathx.NORMAL_DENOMINATOR)}"
    fraction = f"({size}+0.65e0)"
    for step in (4, 3, 2, 1):
        fraction = f"({size}+{step}.0e0/{fraction})"
    tail = (
        f"(CASE WHEN {size} > 37.0e0 THEN 0.0e0 WHEN {size} < {num(mathx.NORMAL_SPLIT)} THEN {centre} "
        f"ELSE {density}/{fraction}/{num(mathx.SQRT_TWO_PI)} END)"
    )
    return f"(CASE WHEN {x} > 0 THEN 1.0e0-{tail} ELSE {tail} END)"


def theta_curve(tau: str = "tau", thetas: tuple[str, ...] = THETA_COLUMNS) -> str:
    text = f"CASE WHEN {tau} <= {num(KNOT_TAUS[0])} THEN {thetas[0]}"
    for i in range(1, len(KNOT_TAUS)):
        left, right = KNOT_TAUS[i - 1], KNOT_TAUS[i]
        text += (
            f" WHEN {tau} <= {num(right)} THEN {thetas[i - 1]} + ({thetas[i]} - {thetas[i - 1]})"
            f"*(({tau} - {num(left)})/{num(right - left)})"
        )
    return text + f" ELSE {thetas[-1]} END"


def eta_cap(theta_max: str, rho: str, lam: str) -> str:
    top, tilt = f"greatest({theta_max}, 1.0e-12)", f"(1.0e0+abs({rho}))"
    return (
        f"greatest(least(4.0e0/greatest({tilt}*pow({top}, 1.0e0-({lam})), 1.0e-12), "
        f"sqrt(4.0e0/greatest({tilt}*pow({top}, 1.0e0-2.0e0*({lam})), 1.0e-12)))*0.999e0, 1.0e-6)"
    )


def constrained(source: str, keep: str) -> str:
    """SELECT that decodes latent columns of ``source`` and keeps the columns in ``keep``."""
    z = LATENT_COLUMNS
    steps = ", ".join(f"exp({z[i]}) AS e{i}" for i in range(11))
    thetas = ", ".join(
        f"greatest({', '.join(f'e{j}' for j in range(i + 1))}) AS {THETA_COLUMNS[i]}" if i else f"e0 AS {THETA_COLUMNS[0]}"
        for i in range(11)
    )
    return f"""
SELECT {keep}, {', '.join(THETA_COLUMNS)}, rho, lam AS "lambda",
       least(exp(eta_raw), {eta_cap(THETA_COLUMNS[-1], 'rho', 'lam')}) AS eta
FROM (SELECT {keep}, {thetas}, eta_raw,
             least(greatest(tanh({z[11]}), -0.999999e0), 0.999999e0) AS rho,
             least(greatest(0.5e0*(1.0e0/(1.0e0+exp(-{z[13]}))), 1.0e-6), 0.499999e0) AS lam
      FROM (SELECT *, {steps}, {z[12]} AS eta_raw FROM {source}))"""


def total_variance(source: str, keep: str, m: str = "m", tau: str = "tau") -> str:
    """SELECT adding theta_at, phi, km, radical and total_variance to the columns in ``keep``."""
    return f"""
SELECT {keep}, theta_at, phi, km, radical, 0.5e0*theta_at*(1.0e0+rho*km+radical) AS total_variance
FROM (SELECT *, sqrt((km+rho)*(km+rho)+1.0e0-rho*rho) AS radical
      FROM (SELECT *, phi*({m}) AS km
            FROM (SELECT *, greatest(eta, 1.0e-12)*pow(theta_at, -"lambda") AS phi
                  FROM (SELECT *, greatest({theta_curve(tau)}, 1.0e-12) AS theta_at FROM {source}))))"""


FORWARD_SQL = (
    CHAIN_SQL
    + """,
pairs AS (
  SELECT quote_date, root, expiration, strike,
         max(CASE WHEN option_type='C' THEN mid_1545 END) AS call_mid,
         max(CASE WHEN option_type='P' THEN mid_1545 END) AS put_mid,
         max(CASE WHEN option_type='C' THEN vega_1545 END) AS call_vega,
         max(CASE WHEN option_type='P' THEN vega_1545 END) AS put_vega
  FROM chain GROUP BY 1, 2, 3, 4),
matched AS (
  SELECT *, call_mid - put_mid AS y, least(call_vega, put_vega) AS w
  FROM pairs WHERE call_mid IS NOT NULL AND put_mid IS NOT NULL),
first_fit AS (
  SELECT quote_date, root, expiration, count(*) AS n, sum(w) AS s, sum(w*strike) AS sx, sum(w*y) AS sy,
         sum(w*strike*strike) AS sxx, sum(w*strike*y) AS sxy
  FROM matched GROUP BY 1, 2, 3),
residuals AS (
  SELECT m.*, f.n, y - ((sxx*sy - sx*sxy)/nullif(s*sxx - sx*sx, 0) + (s*sxy - sx*sy)/nullif(s*sxx - sx*sx, 0)*strike) AS residual
  FROM matched m JOIN first_fit f USING (quote_date, root, expiration)),
centred AS (
  SELECT *, abs(residual - median(residual) OVER (PARTITION BY quote_date, root, expiration)) AS deviation FROM residuals),
judged AS (
  SELECT *, median(deviation) OVER (PARTITION BY quote_date, root, expiration) AS mad FROM centred),
flagged AS (
  SELECT *, (mad IS NULL OR mad <= 0 OR abs(residual) <= 5.0e0*mad) AS is_kept FROM judged),
refit AS (
  SELECT quote_date, root, expiration, count(*) AS n_after, sum(w) AS s, sum(w*strike) AS sx, sum(w*y) AS sy,
         sum(w*strike*strike) AS sxx, sum(w*strike*y) AS sxy
  FROM flagged WHERE is_kept GROUP BY 1, 2, 3),
solved AS (
  SELECT e.quote_date, e.root, e.expiration, CAST(coalesce(f.n, 0) AS BIGINT) AS n_before,
         CAST(CASE WHEN coalesce(f.n, 0) >= 3 THEN coalesce(r.n_after, 0) ELSE 0 END AS BIGINT) AS n_after,
         -(r.s*r.sxy - r.sx*r.sy)/nullif(r.s*r.sxx - r.sx*r.sx, 0) AS d,
         (r.sxx*r.sy - r.sx*r.sxy)/nullif(r.s*r.sxx - r.sx*r.sx, 0) AS a
  FROM (SELECT DISTINCT quote_date, root, expiration FROM pairs) e
  LEFT JOIN first_fit f USING (quote_date, root, expiration)
  LEFT JOIN refit r USING (quote_date, root, expiration)),
reasoned AS (
  SELECT *, a/nullif(d, 0) AS f,
         CASE WHEN n_before < 3 THEN 'fewer_than_3_matched_strikes'
              WHEN n_after < 3 THEN 'fewer_than_3_after_mad_prune'
              WHEN d IS NULL OR d <= 0 THEN 'non_positive_discount_factor'
              WHEN a/nullif(d, 0) IS NULL OR a/nullif(d, 0) <= 0 THEN 'non_positive_forward_price' END AS invalid_reason
  FROM solved),
terms AS (
  SELECT quote_date, root, root AS option_root, expiration, d AS discount_factor, f AS forward_price,
         n_before AS matched_pairs_before_prune, n_after AS matched_pairs_after_prune
  FROM reasoned WHERE invalid_reason IS NULL)
"""
)

NODES_SQL = (
    FORWARD_SQL
    + """,
contracts AS (
  SELECT c.*, t.discount_factor, t.forward_price, ln(c.strike/t.forward_price) AS m
  FROM chain c JOIN terms t USING (quote_date, root, option_root, expiration)),
nodes AS (
  SELECT quote_date, root, expiration, strike, min(option_root) AS option_root, min(tau) AS tau, min(m) AS m,
         sum(implied_volatility_1545*vega_1545)/sum(vega_1545) AS node_iv, sum(vega_1545) AS node_vega,
         avg(active_underlying_price_1545) AS active_underlying_price_1545,
         CAST(sum(trade_volume) AS BIGINT) AS trade_volume, CAST(sum(open_interest) AS BIGINT) AS open_interest,
         median(rel_spread_1545) AS median_rel_spread_1545, min(forward_price) AS forward_price,
         min(discount_factor) AS discount_factor, CAST(count(*) AS BIGINT) AS collapsed_contract_count
  FROM contracts GROUP BY 1, 2, 3, 4)
"""
)
