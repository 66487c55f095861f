"""Registered queries: walk-forward forecasts of the daily state panel and candidate choice."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from volpanel.operators import forecast, score, tuning
from volpanel.operators.features import SCALAR_COLUMNS, with_scalar_features
from volpanel.plans.adapters import daily_states, table
from volpanel.plans.queries_daily import SPLIT_SQL, STATE_COLUMNS, daily_chunks
from volpanel.plans.registry import register
from volpanel.plans.shape import rounded
from volpanel.session import cut_lineage

ONE = STATE_COLUMNS[:1]

# Every row of the stage with its chunk, its training sums and both scalar forecasts.
def forecast_sql(stage: str) -> str:
    text = SPLIT_SQL
    if stage == "validation":
        text = text.replace("WHEN split_label = 'test' THEN", "WHEN split_label = 'validation' THEN")
    return text + f""",
starts AS (SELECT option_root, chunk_id, min(target_date) AS chunk_start FROM chunked WHERE split_label = '{stage}' GROUP BY 1, 2),
pairs AS (
  SELECT c.option_root, c.quote_date, c.target_date, c.split_label, c.chunk_id, o.state_z_000 AS x, t.state_z_000 AS y
  FROM chunked c JOIN state o ON o.option_root = c.option_root AND o.state_row_index = c.surface_state_row_index
  JOIN state t ON t.option_root = c.option_root AND t.state_row_index = c.target_state_row_index),
fitted AS (
  SELECT s.option_root, s.chunk_id, regr_slope(p.y, p.x) AS b, regr_intercept(p.y, p.x) AS a
  FROM starts s JOIN pairs p ON p.option_root = s.option_root AND p.target_date < s.chunk_start GROUP BY 1, 2),
forecasts AS (
  SELECT 'state_last' AS model_name, option_root, quote_date AS forecast_origin, target_date, chunk_id, x AS state_z_000, y
  FROM pairs WHERE split_label = '{stage}'
  UNION ALL
  SELECT 'state_var1', p.option_root, p.quote_date, p.target_date, p.chunk_id, a + b*x, y
  FROM pairs p JOIN fitted USING (option_root, chunk_id) WHERE p.split_label = '{stage}'),
losses AS (SELECT *, abs(state_z_000 - y) AS loss FROM forecasts)
"""


def scalar_panel(spark, sf_dir, stage):
    states = daily_states(spark, sf_dir)
    models = [forecast.StateLast(ONE), forecast.StateVar1(ONE)]
    return forecast.forecast_panel(models, daily_chunks(spark, sf_dir, stage), states)


@register(
    "state_forecasts",
    "FCT1 FCT2",
    "WITH" + forecast_sql("test") + "SELECT model_name, option_root, forecast_origin, target_date, chunk_id, round(state_z_000, 6) AS state_z_000 FROM forecasts",
)
def state_forecasts(spark, sf_dir):
    return rounded(scalar_panel(spark, sf_dir, "test"), 6, *ONE)


@register(
    "walk_forward_validation",
    "FCT4 WIN11",
    "WITH" + forecast_sql("validation") + "SELECT model_name, option_root, forecast_origin, target_date, chunk_id, round(loss, 6) AS rmse, round(loss, 6) AS mae FROM losses",
)
def walk_forward_validation(spark, sf_dir):
    panel = scalar_panel(spark, sf_dir, "validation")
    return rounded(forecast.state_losses(panel, daily_states(spark, sf_dir), ONE), 6, "rmse", "mae")


@register(
    "chosen_model",
    "FCT5 SRT4",
    "WITH" + forecast_sql("validation") + """
SELECT option_root, model_name, round(mean_loss, 6) AS mean_rmse, round(mean_loss, 6) AS mean_mae FROM (
  SELECT *, row_number() OVER (PARTITION BY option_root ORDER BY mean_loss, model_name) AS r FROM (
    SELECT option_root, model_name, avg(loss) AS mean_loss FROM losses GROUP BY 1, 2)) WHERE r = 1""",
)
def chosen_model(spark, sf_dir):
    panel = scalar_panel(spark, sf_dir, "validation")
    losses = forecast.state_losses(panel, daily_states(spark, sf_dir), ONE)
    return rounded(forecast.choose_candidate(losses), 6, "mean_rmse", "mean_mae")


@register("var_forecasts", "FCT2 FCT1")
def var_forecasts(spark, sf_dir):
    """Two-dimensional vector autoregression of the daily states over the test chunks."""
    return rounded(
        forecast.StateVar1(STATE_COLUMNS).fit_predict(daily_chunks(spark, sf_dir), daily_states(spark, sf_dir)), 6, *STATE_COLUMNS
    )


FEATURES = (*STATE_COLUMNS, *SCALAR_COLUMNS)


def direct_models():
    return [forecast.DirectHistory(FEATURES, STATE_COLUMNS, history_days=h) for h in (10, 22)]


DIRECT_PENALTIES = (0.1, 1.0, 10.0, 100.0)

# One-day windows of two features: normalized per refit, penalty by the refit's own holdout, closed form of two unknowns.
DIRECT_SQL = "WITH" + SPLIT_SQL + f""",
placed AS (
  SELECT c.option_root, c.quote_date, c.target_date, c.chunk_id, o.state_z_000 AS f0, o.state_z_001 AS f1, t.state_z_000 AS y,
    row_number() OVER (PARTITION BY c.option_root ORDER BY c.quote_date) - 1 AS pos
  FROM chunked c JOIN state o ON o.option_root = c.option_root AND o.state_row_index = c.history_end_index
  JOIN state t ON t.option_root = c.option_root AND t.state_row_index = c.target_state_row_index),
refits AS (
  SELECT option_root, chunk_id, rows, rows - greatest(1, rows // 10) AS fit_rows
  FROM (SELECT option_root, chunk_id, min(pos) AS rows FROM placed WHERE chunk_id >= 0 GROUP BY 1, 2)),
stats AS (
  SELECT r.*, avg(f0) AS m0, avg(f1) AS m1, stddev_pop(f0) AS s0, stddev_pop(f1) AS s1
  FROM refits r JOIN placed p ON p.option_root = r.option_root AND p.pos < r.fit_rows GROUP BY ALL),
rows_of AS (
  SELECT s.*, pos < fit_rows AS fits, (f0 - m0)/s0 AS a, (f1 - m1)/s1 AS b, y
  FROM stats s JOIN placed p ON p.option_root = s.option_root AND p.pos < s.rows),
sums AS (
  SELECT option_root, chunk_id, any_value(m0) AS m0, any_value(m1) AS m1, any_value(s0) AS s0, any_value(s1) AS s1, penalty, whole,
    count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, sum(a*a) - count(*)*avg(a)*avg(a) + penalty AS aa, sum(b*b) - count(*)*avg(b)*avg(b) + penalty AS bb,
    sum(a*b) - count(*)*avg(a)*avg(b) AS ab, sum(a*y) - count(*)*avg(a)*avg(y) AS ay, sum(b*y) - count(*)*avg(b)*avg(y) AS by_
  FROM rows_of CROSS JOIN (VALUES {", ".join(f"(CAST({p} AS DOUBLE))" for p in DIRECT_PENALTIES)}) v(penalty) CROSS JOIN (VALUES (true), (false)) w(whole)
  WHERE whole OR fits GROUP BY option_root, chunk_id, penalty, whole),
lines AS (SELECT *, (bb*ay - ab*by_)/(aa*bb - ab*ab) AS ba, (aa*by_ - ab*ay)/(aa*bb - ab*ab) AS bb_ FROM sums),
tried AS (
  SELECT l.option_root, l.chunk_id, l.penalty, sum(pow(y - my - ba*(a - ma) - bb_*(b - mb), 2)) AS error
  FROM lines l JOIN rows_of r ON r.option_root = l.option_root AND r.chunk_id = l.chunk_id AND NOT r.fits WHERE NOT whole GROUP BY 1, 2, 3),
chosen AS (SELECT option_root, chunk_id, first(penalty ORDER BY error, penalty) AS penalty FROM tried GROUP BY 1, 2)
SELECT 'direct_history' AS model_name, p.option_root, p.quote_date AS forecast_origin, p.target_date, p.chunk_id,
  round(my + ba*((f0 - m0)/s0 - ma) + bb_*((f1 - m1)/s1 - mb), 5) AS state_z_000
FROM placed p JOIN chosen USING (option_root, chunk_id) JOIN lines l ON l.option_root = p.option_root AND l.chunk_id = p.chunk_id
  AND l.penalty = chosen.penalty AND l.whole"""


@register("direct_two_features", "FCT3 AGG27", DIRECT_SQL)
def direct_two_features(spark, sf_dir):
    """Ridge forecasts of one state from one-day windows of both, with every refit's own statistics, holdout and penalty."""
    model = forecast.DirectHistory(STATE_COLUMNS, ONE, 1, DIRECT_PENALTIES)
    return rounded(model.fit_predict(cut_lineage(daily_chunks(spark, sf_dir)), cut_lineage(daily_states(spark, sf_dir))), 5, *ONE)


@register("direct_forecasts", "FCT3 WIN6 AGG27")
def direct_forecasts(spark, sf_dir):
    """Ridge forecasts from normalized ten-day windows of the two states and nine scalar features."""
    states = cut_lineage(with_scalar_features(daily_states(spark, sf_dir)))
    bucketed = cut_lineage(daily_chunks(spark, sf_dir))
    return rounded(direct_models()[0].fit_predict(bucketed, states), 5, *STATE_COLUMNS)


@register("tuned_history_length", "FCT5 FCT3")
def tuned_history_length(spark, sf_dir):
    """Validation choice between ten and twenty-two days of history."""
    states = cut_lineage(with_scalar_features(daily_states(spark, sf_dir)))
    bucketed = cut_lineage(daily_chunks(spark, sf_dir, "validation"))
    parts = []
    for model in direct_models():
        model.model_name = f"direct_history_{model.history_days}"
        parts.append(model.fit_predict(bucketed, states))
    losses = forecast.state_losses(parts[0].unionByName(parts[1]), states, STATE_COLUMNS)
    return rounded(forecast.choose_candidate(losses), 4, "mean_rmse", "mean_mae")


PENALTIES = (0.0, 0.5, 50.0)
PENALTY_VALUES = ", ".join(f"('penalty={p:g}', CAST({p} AS DOUBLE))" for p in PENALTIES)


def _stage_sql(stage: str) -> str:
    """The common tables of ``forecast_sql`` up to the sums, renamed for one stage, with all candidates' forecasts."""
    text = forecast_sql(stage).split("fitted AS (")[0]
    chunked = text[text.index("chunked AS (") :].rstrip().rstrip(",")
    for name in ("chunked", "starts", "pairs"):
        chunked = re.sub(rf"\b{name}\b", f"{stage}_{name}", chunked)
    return chunked + f""",
{stage}_sums AS (
  SELECT s.option_root, s.chunk_id, regr_sxx(p.y, p.x) AS sxx, regr_sxy(p.y, p.x) AS sxy, avg(p.x) AS mx, avg(p.y) AS my
  FROM {stage}_starts s JOIN {stage}_pairs p ON p.option_root = s.option_root AND p.target_date < s.chunk_start GROUP BY 1, 2),
{stage}_tried AS (
  SELECT p.option_root, candidate_id, p.quote_date, p.target_date, p.chunk_id, my + sxy/(sxx + penalty)*(x - mx) AS z, x, y
  FROM {stage}_pairs p JOIN {stage}_sums USING (option_root, chunk_id) CROSS JOIN (VALUES {PENALTY_VALUES}) v(candidate_id, penalty)
  WHERE p.split_label = '{stage}')"""


TUNED_SQL = "WITH" + SPLIT_SQL.split("chunked AS (")[0] + _stage_sql("validation") + ",\n" + _stage_sql("test") + """,
means AS (SELECT option_root, candidate_id, avg(abs(z - y)) AS loss FROM validation_tried GROUP BY 1, 2),
won AS (SELECT option_root, first(candidate_id ORDER BY loss, candidate_id) AS candidate_id FROM means GROUP BY 1)
SELECT 'state_var1' AS model_name, option_root, candidate_id, quote_date AS forecast_origin, target_date, chunk_id, round(z, 6) AS state_z_000
FROM test_tried JOIN won USING (option_root, candidate_id)
UNION ALL
SELECT 'state_last', option_root, 'only', quote_date, target_date, chunk_id, round(x, 6) FROM test_pairs WHERE split_label = 'test'"""


@register("tuned_backtest", "FCT5 FCT6 FCT2", TUNED_SQL)
def tuned_backtest(spark, sf_dir):
    """Autoregressions of three penalties compete on the validation window; each panel's winner forecasts the test window."""
    states = daily_states(spark, sf_dir)
    families = [tuning.single(forecast.StateLast(ONE)), tuning.RidgeVar(PENALTIES, ONE)]
    panel = tuning.tuned_states(families, daily_chunks(spark, sf_dir, "validation"), daily_chunks(spark, sf_dir, "test"), states, ONE)
    return rounded(panel, 6, *ONE)


CANDIDATE_SQL = """
WITH panel AS (
  SELECT event_type AS candidate_id, CAST(ts AS DATE) AS target_date, sqrt(avg(value*value)) AS rmse_iv, avg(value) AS vega_rmse_iv,
         CAST(count(*) FILTER (value > 20) AS BIGINT) AS calendar_violation_count, CAST(count(*) FILTER (value > 40) AS BIGINT) AS butterfly_violation_count
  FROM events GROUP BY 1, 2),
means AS (SELECT candidate_id, avg(vega_rmse_iv) AS v, avg(rmse_iv) AS r, avg(calendar_violation_count) AS c, avg(butterfly_violation_count) AS b FROM panel GROUP BY 1)
SELECT candidate_id, round(v, 6) AS mean_vega_rmse_iv, round(r, 6) AS mean_rmse_iv, round(c, 6) AS mean_calendar_violations,
       round(b, 6) AS mean_butterfly_violations, row_number() OVER (ORDER BY v, r, c, b, candidate_id) = 1 AS is_best FROM means"""


@register("candidate_ranking", "AGG29 SRT4", CANDIDATE_SQL)
def candidate_ranking(spark, sf_dir):
    panel = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("candidate_id"), F.to_date("ts").alias("target_date"))
        .agg(
            F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse_iv"),
            F.avg("value").alias("vega_rmse_iv"),
            F.count_if(F.col("value") > 20).alias("calendar_violation_count"),
            F.count_if(F.col("value") > 40).alias("butterfly_violation_count"),
        )
    )
    ranked = score.rank_candidates(panel, panel)
    return rounded(ranked, 6, *[c for c in ranked.columns if c.startswith("mean_")])
