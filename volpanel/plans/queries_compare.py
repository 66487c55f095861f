"""Registered queries on model losses: alignment, Diebold-Mariano, Holm and the model confidence set."""

from __future__ import annotations

from pyspark.sql import functions as F

from volpanel.operators import compare
from volpanel.plans.adapters import LOSS_SQL, loss, table
from volpanel.plans.registry import register
from volpanel.plans.shape import joined, rounded
from volpanel.session import cut_lineage

MODELS = ("click", "error", "purchase", "signup", "view")
SETTINGS = compare.BootstrapSettings(draws=500, block_length=10, seed=42)


@register(
    "aligned_losses",
    "STA1",
    "WITH" + LOSS_SQL + ", p AS (PIVOT loss ON model_name IN ('click','error','purchase','signup','view') USING sum(loss)) SELECT metric, target_date, "
    + ", ".join(f"round({m}, 8) AS {m}" for m in MODELS) + " FROM p",
)
def aligned_losses(spark, sf_dir):
    losses = loss(spark, sf_dir)
    return rounded(compare.aligned_losses(losses, compare.model_names(losses)), 8, *MODELS)


@register(
    "loss_problems",
    "STA2",
    """WITH per_model AS (SELECT user_id AS metric, event_type, count(*) AS n, count(DISTINCT d) AS dates FROM (
  SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY 1, 2),
all_dates AS (SELECT user_id AS metric, count(DISTINCT CAST(ts AS DATE)) AS all_dates FROM events GROUP BY 1),
per_panel AS (SELECT metric, count(*) AS models, min(n) AS lo, max(n) AS hi, sum(n - dates) AS repeated FROM per_model GROUP BY 1)
SELECT metric, CASE WHEN models < 2 THEN 'fewer_than_two_models' WHEN lo <> hi THEN 'unequal_length' WHEN repeated > 0 THEN 'repeated_dates'
       WHEN lo <> all_dates THEN 'unaligned_dates' WHEN lo < 3 THEN 'too_few_observations' END AS problem FROM per_panel JOIN all_dates USING (metric)
WHERE models < 2 OR lo <> hi OR repeated > 0 OR lo <> all_dates OR lo < 3""",
)
def loss_problems(spark, sf_dir):
    """Raw events per user are not aligned loss series; the check must say why."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("metric"),
        F.col("event_type").alias("model_name"),
        F.to_date("ts").alias("target_date"),
        F.col("value").alias("loss"),
    )
    return compare.loss_problems(rows)


PAIRS_SQL = LOSS_SQL + """,
pairs AS (
  SELECT a.metric, a.target_date, a.model_name AS model_a, b.model_name AS model_b, a.loss - b.loss AS differential
  FROM loss a JOIN loss b ON a.target_date = b.target_date AND a.model_name < b.model_name),
centred AS (
  SELECT *, differential - avg(differential) OVER (PARTITION BY model_a, model_b) AS c,
         row_number() OVER (PARTITION BY model_a, model_b ORDER BY target_date) AS r FROM pairs),
moments AS (
  SELECT model_a, model_b, count(*) AS n, avg(differential) AS mean_differential, sum(c*c) AS g0,""" + ", ".join(
    f" sum(c*l{k}) AS g{k}" for k in range(1, 6)
) + """ FROM (SELECT *, """ + ", ".join(f"lag(c, {k}) OVER (PARTITION BY model_a, model_b ORDER BY target_date) AS l{k}" for k in range(1, 6)) + """
  FROM centred) GROUP BY 1, 2),
tested AS (
  SELECT model_a, model_b, CAST(n AS BIGINT) AS n_obs, mean_differential,
         greatest((g0""" + "".join(f" + 2.0e0*(1.0e0 - {k}/6.0e0)*g{k}" for k in range(1, 6)) + """)/n, 1.0e-12) AS lrv FROM moments)
"""


@register(
    "model_pairs",
    "JON15",
    "WITH" + PAIRS_SQL + "SELECT metric, target_date, model_a, model_b, round(differential, 8) AS differential FROM pairs",
)
def model_pairs(spark, sf_dir):
    return rounded(compare.model_pairs(loss(spark, sf_dir)), 8, "differential")


@register(
    "long_run_variance",
    "WIN15",
    "WITH" + PAIRS_SQL + "SELECT 'value' AS metric, model_a, model_b, n_obs, round(mean_differential, 8) AS mean_differential, round(lrv, 9) AS long_run_variance FROM tested",
)
def long_run_variance(spark, sf_dir):
    rows = compare.long_run_variance(compare.model_pairs(loss(spark, sf_dir)))
    return rounded(rounded(rows, 8, "mean_differential"), 9, "long_run_variance")


@register(
    "diebold_mariano",
    "STA3 STA4 WIN15",
    "WITH" + PAIRS_SQL + "SELECT 'value' AS metric, model_a, model_b, n_obs, round(mean_differential/sqrt(lrv/n_obs)*sqrt((n_obs - 1.0e0)/n_obs), 5) AS statistic FROM tested",
)
def diebold_mariano(spark, sf_dir):
    rows = compare.diebold_mariano(loss(spark, sf_dir))
    return rounded(rows.select("metric", "model_a", "model_b", "n_obs", "statistic"), 5, "statistic")


def student_tail_sql(t: str, freedom: int) -> str:
    """Two-sided Student-t tail for an odd number of degrees of freedom: a finite sum in the cosine of the angle."""
    weight, terms = 1.0, []
    for power in range(1, freedom - 1, 2):
        terms.append(f"{weight!r}e0*cos(a)**{power}")
        weight *= (power + 1) / (power + 2)
    angle = f"atan(abs({t})/sqrt({freedom}.0e0))"
    return f"(SELECT 1.0e0 - 2.0e0/pi()*(a + sin(a)*({' + '.join(terms)})) FROM (SELECT {angle} AS a))"


# The events cover 30 days at every scale factor, so all pairs have 29 degrees of freedom.
P_VALUE_SQL = PAIRS_SQL + f""",
statistics AS (SELECT *, mean_differential/sqrt(lrv/n_obs)*sqrt((n_obs - 1.0e0)/n_obs) AS statistic FROM tested),
p AS (SELECT *, CASE WHEN n_obs = 30 THEN {student_tail_sql("statistic", 29)} END AS p_value FROM statistics),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, model_a, model_b) AS r, count(*) OVER () AS m FROM p)
SELECT 'value' AS metric, model_a, model_b, n_obs, 5 AS bandwidth, 1 AS horizon, round(statistic, 5) AS statistic, round(p_value, 6) AS p_value,
       round(max(least(1.0e0, (m - r + 1)*p_value)) OVER (ORDER BY r), 6) AS adjusted_p_value FROM ranked
"""


@register("diebold_mariano_p_values", "STA3 STA4", "WITH" + P_VALUE_SQL)
def diebold_mariano_p_values(spark, sf_dir):
    rows = compare.diebold_mariano(loss(spark, sf_dir)).drop("mean_differential", "long_run_variance")
    return rounded(rounded(rows, 5, "statistic"), 6, "p_value", "adjusted_p_value")


@register(
    "holm_adjustment",
    "WIN16 STA4",
    """WITH raw AS (SELECT event_type AS metric, CAST(CAST(ts AS DATE) AS VARCHAR) AS model_a, 'x' AS model_b, avg(value)/(avg(value) + max(value) + 40.0e0*count(*)) AS p_value
  FROM events GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY metric) AS n FROM raw WINDOW w AS (PARTITION BY metric ORDER BY p_value, model_a, model_b))
SELECT metric, model_a, round(p_value, 8) AS p_value,
       round(max(least(1.0e0, (n - r + 1)*p_value)) OVER (PARTITION BY metric ORDER BY r), 7) AS adjusted_p_value FROM ranked""",
)
def holm_adjustment(spark, sf_dir):
    v = F.col("value")
    raw = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("metric"), F.to_date("ts").cast("string").alias("model_a"))
        .agg((F.avg(v) / (F.avg(v) + F.max(v) + 40.0 * F.count(F.lit(1)))).alias("p_value"))
        .withColumn("model_b", F.lit("x"))
    )
    rows = compare.holm_adjust(raw).drop("model_b")
    return rounded(rounded(rows, 8, "p_value"), 7, "adjusted_p_value")


def uniform_sql(kind: str) -> str:
    return f"CAST('0x' || substr(md5('42:{kind}:' || CAST(draw AS VARCHAR) || ':' || CAST(o AS VARCHAR)), 1, 8) AS BIGINT)/4294967296.0e0"


def bootstrap_sql(draws: int) -> str:
    return LOSS_SQL + f""",
len AS (SELECT count(DISTINCT target_date) AS t FROM loss),
cells AS (SELECT draw, o, t FROM (SELECT unnest(range({draws})) AS draw) d, (SELECT t, unnest(range(t)) AS o FROM len) c),
rolled AS (SELECT *, o = 0 OR {uniform_sql('jump')} > 0.9e0 AS fresh, CAST(floor({uniform_sql('start')}*t) AS BIGINT) AS start FROM cells),
based AS (SELECT *, last_value(CASE WHEN fresh THEN start - o END IGNORE NULLS) OVER (PARTITION BY draw ORDER BY o) AS base FROM rolled),
paths AS (SELECT draw, o, CAST((base + o) % t AS BIGINT) AS position FROM based),
placed AS (SELECT model_name, loss, row_number() OVER (PARTITION BY model_name ORDER BY target_date) - 1 AS position FROM loss),
means AS (
  SELECT draw, model_name, avg(loss) AS mean_loss FROM paths JOIN placed USING (position) GROUP BY 1, 2
  UNION ALL SELECT -1, model_name, avg(loss) FROM loss GROUP BY 2)
"""


BOOTSTRAP_SQL = bootstrap_sql(SETTINGS.draws)


@register(
    "bootstrap_paths",
    "WIN17",
    "WITH" + BOOTSTRAP_SQL + "SELECT 'value' AS metric, CAST(draw AS INT) AS draw, CAST(o AS INT) AS \"offset\", position FROM paths",
)
def bootstrap_paths(spark, sf_dir):
    lengths = loss(spark, sf_dir).groupBy("metric").agg(F.count_distinct("target_date").alias("length"))
    return compare.bootstrap_paths(lengths, SETTINGS)


@register(
    "bootstrap_means",
    "STA5 WIN17",
    "WITH" + BOOTSTRAP_SQL + "SELECT 'value' AS metric, CAST(draw AS INT) AS draw, model_name, round(mean_loss, 8) AS mean_loss FROM means",
)
def bootstrap_means(spark, sf_dir):
    return rounded(compare.bootstrap_means(loss(spark, sf_dir), SETTINGS), 8, "mean_loss")


STEP_SQL = BOOTSTRAP_SQL + """,
obs AS (SELECT model_name, mean_loss AS m0 FROM means WHERE draw = -1),
gaps AS (SELECT draw, model_name, mean_loss - m0 AS g, m0 FROM means JOIN obs USING (model_name) WHERE draw >= 0),
single AS (
  SELECT draw, model_name, (count(*) OVER w*g - sum(g) OVER w)/(count(*) OVER w - 1) AS d, (count(*) OVER w*m0 - sum(m0) OVER w)/(count(*) OVER w - 1) AS o
  FROM gaps WINDOW w AS (PARTITION BY draw)),
single_t AS (SELECT model_name, greatest(var_samp(d), 1.0e-12) AS v, min(o)/sqrt(greatest(var_samp(d), 1.0e-12)) AS t FROM single GROUP BY 1),
single_boot AS (SELECT draw, max(d/sqrt(v)) AS boot FROM single JOIN single_t USING (model_name) GROUP BY 1),
pairwise AS (SELECT a.draw, a.model_name, b.model_name AS other, a.g - b.g AS d, a.m0 - b.m0 AS o FROM gaps a JOIN gaps b ON a.draw = b.draw AND a.model_name <> b.model_name),
double_t AS (SELECT model_name, other, greatest(var_samp(d), 1.0e-12) AS v, min(o)/sqrt(greatest(var_samp(d), 1.0e-12)) AS t FROM pairwise GROUP BY 1, 2),
double_boot AS (SELECT draw, max(abs(d)/sqrt(v)) AS boot FROM pairwise JOIN double_t USING (model_name, other) GROUP BY 1),
step AS (
  SELECT 'Tmax' AS method, (SELECT max(t) FROM single_t) AS statistic, (SELECT model_name FROM single_t ORDER BY t DESC, model_name LIMIT 1) AS model,
         (SELECT avg(CASE WHEN boot >= (SELECT max(t) FROM single_t) - 1.0e-9 THEN 1.0e0 ELSE 0.0e0 END) FROM single_boot) AS p
  UNION ALL
  SELECT 'TR', (SELECT max(abs(t)) FROM double_t), (SELECT model_name FROM double_t GROUP BY 1 ORDER BY max(t) DESC, model_name LIMIT 1),
         (SELECT avg(CASE WHEN boot >= (SELECT max(abs(t)) FROM double_t) - 1.0e-9 THEN 1.0e0 ELSE 0.0e0 END) FROM double_boot))
"""


@register(
    "elimination_step",
    "STA6",
    "WITH" + STEP_SQL + "SELECT 'value' AS metric, method, 'click,error,purchase,signup,view' AS models, round(statistic, 5) AS observed_statistic, round(p, 6) AS p_value, model AS eliminated_model FROM step",
)
def elimination_step(spark, sf_dir):
    means = cut_lineage(compare.bootstrap_means(loss(spark, sf_dir), SETTINGS))
    methods = F.explode(F.array(*[F.lit(m) for m in compare.METHODS])).alias("method")
    active = means.where("draw = -1").select("metric", "model_name", methods)
    step = compare.elimination_step(means, active).withColumn("models", joined("models"))
    return rounded(rounded(step, 5, "observed_statistic"), 6, "p_value")


def elimination_sql(draws: int, alpha: float = 0.10) -> str:
    """All elimination steps of both methods, unrolled: at most one step less than there are models."""
    parts = [
        bootstrap_sql(draws) + """,
obs AS (SELECT model_name, mean_loss AS m0 FROM means WHERE draw = -1),
gaps AS (SELECT draw, model_name, mean_loss - m0 AS g, m0 FROM means JOIN obs USING (model_name) WHERE draw >= 0),
active1 AS (SELECT method, model_name FROM obs, (VALUES ('Tmax'), ('TR')) v(method))"""
    ]
    for k in range(1, len(MODELS)):
        parts.append(f""",
held{k} AS (SELECT method, draw, model_name, g, m0 FROM gaps JOIN active{k} USING (model_name)),
item{k} AS (
  SELECT method, draw, model_name AS a, '' AS b, (count(*) OVER w*g - sum(g) OVER w)/(count(*) OVER w - 1) AS d,
    (count(*) OVER w*m0 - sum(m0) OVER w)/(count(*) OVER w - 1) AS o FROM held{k} WHERE method = 'Tmax' WINDOW w AS (PARTITION BY draw)
  UNION ALL
  SELECT x.method, x.draw, x.model_name, y.model_name, x.g - y.g, x.m0 - y.m0 FROM held{k} x JOIN held{k} y
  ON x.method = y.method AND x.draw = y.draw AND x.model_name <> y.model_name WHERE x.method = 'TR'),
scale{k} AS (SELECT method, a, b, sqrt(greatest(var_samp(d), 1.0e-12)) AS s, min(o)/sqrt(greatest(var_samp(d), 1.0e-12)) AS t FROM item{k} GROUP BY 1, 2, 3),
top{k} AS (SELECT method, max(CASE WHEN method = 'Tmax' THEN t ELSE abs(t) END) AS statistic, first(a ORDER BY t DESC, a) AS worst FROM scale{k} GROUP BY 1),
boot{k} AS (SELECT method, draw, max(CASE WHEN method = 'Tmax' THEN d/s ELSE abs(d/s) END) AS boot FROM item{k} JOIN scale{k} USING (method, a, b) GROUP BY 1, 2),
step{k} AS (
  SELECT {k} AS step, t.method, statistic, avg(CASE WHEN boot >= statistic - 1.0e-9 THEN 1.0e0 ELSE 0.0e0 END) AS p,
    (SELECT string_agg(model_name, ',' ORDER BY model_name) FROM active{k} c WHERE c.method = t.method) AS models,
    (SELECT count(*) FROM active{k} c WHERE c.method = t.method) AS n, any_value(worst) AS worst
  FROM top{k} t JOIN boot{k} q ON q.method = t.method GROUP BY t.method, statistic),
active{k + 1} AS (
  SELECT c.method, c.model_name FROM active{k} c JOIN step{k} s ON s.method = c.method
  WHERE s.p <= {alpha}e0 AND s.n > 2 AND c.model_name <> s.worst)""")
    union = " UNION ALL ".join(f"SELECT * FROM step{k}" for k in range(1, len(MODELS)))
    return "".join(parts) + f""",
steps AS (SELECT *, CASE WHEN p <= {alpha}e0 THEN worst END AS eliminated_model FROM ({union}))
"""


@register(
    "confidence_set_steps",
    "STA7",
    "WITH" + elimination_sql(SETTINGS.draws) + """SELECT 'value' AS metric, method, models, round(statistic, 5) AS observed_statistic, round(p, 5) AS p_value, eliminated_model, step FROM steps""",
)
def confidence_set_steps(spark, sf_dir):
    steps = compare.confidence_set_steps(loss(spark, sf_dir), settings=SETTINGS)
    return rounded(steps.withColumn("models", joined("models")), 5, "observed_statistic", "p_value")


@register(
    "model_confidence_set",
    "STA7",
    "WITH" + elimination_sql(5000) + f""", gone AS (SELECT method, string_agg(eliminated_model, ',' ORDER BY step) AS elimination_order FROM steps GROUP BY 1)
SELECT 'value' AS metric, method, coalesce(elimination_order, '') AS elimination_order,
  (SELECT coalesce(string_agg(m, ',' ORDER BY m), '') FROM unnest({list(MODELS)}) x(m) WHERE m NOT IN (SELECT eliminated_model FROM steps s WHERE s.method = g.method AND eliminated_model IS NOT NULL)) AS included_models,
  (SELECT coalesce(string_agg(eliminated_model, ',' ORDER BY eliminated_model), '') FROM steps s WHERE s.method = g.method AND eliminated_model IS NOT NULL) AS excluded_models
FROM gone g""",
)
def model_confidence_set(spark, sf_dir):
    losses = loss(spark, sf_dir)
    chosen = compare.confidence_set(compare.confidence_set_steps(losses, settings=compare.BootstrapSettings(5000)), losses)
    return chosen.select(
        "metric",
        "method",
        F.array_join("elimination_order", ",").alias("elimination_order"),
        joined("included_models").alias("included_models"),
        joined("excluded_models").alias("excluded_models"),
    )
