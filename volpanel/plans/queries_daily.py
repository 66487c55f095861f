"""Registered queries over the daily state panel: calendar, features, splits and the stage ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from volpanel.operators import calendar, features, ledger
from volpanel.plans.adapters import DAILY_SQL, daily, daily_states
from volpanel.plans.registry import register
from volpanel.plans.shape import rounded

STATE_COLUMNS = ("state_z_000", "state_z_001")
SIZES = {"validation_size": 126, "test_size": 252}

INDEX_SQL = DAILY_SQL + """,
idx AS (
  SELECT d.quote_date, d.option_root,
         CAST(row_number() OVER (PARTITION BY d.option_root ORDER BY d.quote_date) - 1 AS BIGINT) AS trading_day_index,
         lead(d.quote_date) OVER (PARTITION BY d.option_root ORDER BY d.quote_date) AS next_trading_date,
         s.state_row_index AS surface_state_row_index, s.state_row_index IS NOT NULL AS has_surface_state
  FROM daily d LEFT JOIN state s USING (option_root, quote_date)),
cand AS (
  SELECT i.quote_date, i.option_root, i.next_trading_date AS target_date, i.surface_state_row_index,
         t.state_row_index AS target_state_row_index,
         CASE WHEN i.surface_state_row_index IS NULL THEN 'missing_origin_state'
              WHEN t.state_row_index IS NULL THEN 'missing_target_state'
              WHEN i.surface_state_row_index < 21 THEN 'missing_history_window' END AS exclusion_reason
  FROM idx i LEFT JOIN state t ON t.option_root = i.option_root AND t.quote_date = i.next_trading_date
  WHERE i.next_trading_date IS NOT NULL),
feat AS (
  SELECT quote_date, option_root, target_date, surface_state_row_index - 21 AS history_start_index,
         surface_state_row_index AS history_end_index, surface_state_row_index, target_state_row_index
  FROM cand WHERE exclusion_reason IS NULL)
"""

SPLIT_SQL = INDEX_SQL + """,
labelled AS (
  SELECT *, CASE WHEN from_end < 252 THEN 'test' WHEN from_end < 378 THEN 'validation' ELSE 'train' END AS split_label
  FROM (SELECT *, row_number() OVER (PARTITION BY option_root ORDER BY target_date DESC) - 1 AS from_end FROM feat)),
chunked AS (
  SELECT *, CAST(CASE WHEN split_label = 'test' THEN
           floor((row_number() OVER (PARTITION BY option_root, split_label ORDER BY target_date) - 1)/21.0e0) ELSE -1 END AS INT) AS chunk_id
  FROM labelled)
"""


def daily_index(spark, sf_dir):
    return calendar.trading_date_index(daily(spark, sf_dir), daily_states(spark, sf_dir))


def daily_candidates(spark, sf_dir):
    return calendar.labelled_candidates(daily_index(spark, sf_dir))


def daily_features(spark, sf_dir, scalars=()):
    states = daily_states(spark, sf_dir)
    if scalars:
        states = features.with_scalar_features(states)
    return calendar.feature_rows(daily_candidates(spark, sf_dir), states, scalars)


def daily_labelled(spark, sf_dir):
    return calendar.label_splits(daily_features(spark, sf_dir), **SIZES)


def daily_chunks(spark, sf_dir, stage="test", refit_frequency=21):
    return calendar.walk_forward_buckets(daily_labelled(spark, sf_dir), stage, refit_frequency)


@register(
    "trading_date_index",
    "WIN1 JON8",
    "WITH" + INDEX_SQL + """SELECT quote_date, option_root, trading_day_index, next_trading_date,
       surface_state_row_index, has_surface_state FROM idx""",
)
def trading_date_index(spark, sf_dir):
    return daily_index(spark, sf_dir)


@register(
    "state_row_index",
    "WIN2",
    "WITH" + DAILY_SQL + """SELECT option_root, quote_date, state_row_index, round(state_z_000, 6) AS state_z_000 FROM state""",
)
def state_row_index(spark, sf_dir):
    return rounded(daily_states(spark, sf_dir).select("option_root", "quote_date", "state_row_index", "state_z_000"), 6, "state_z_000")


@register(
    "state_panel_problems",
    "WIN2",
    "WITH" + DAILY_SQL + """, late AS (SELECT *, row_number() OVER (PARTITION BY option_root ORDER BY quote_date) - 1 AS place
                                     FROM state WHERE state_row_index <> 5)
SELECT option_root, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT quote_date) AS BIGINT) AS dates,
       CAST(count(*) FILTER (place <> state_row_index) AS BIGINT) AS misplaced FROM late GROUP BY 1
HAVING count(*) FILTER (place <> state_row_index) > 0""",
)
def state_panel_problems(spark, sf_dir):
    """Dropping one state row per panel must be reported as a gap."""
    return calendar.state_panel_problems(daily_states(spark, sf_dir).where("state_row_index <> 5"))


SCALED_SQL = """,
scaled AS (
  SELECT option_root, quote_date,
    coalesce(ln(active_underlying_price_1545/lag(active_underlying_price_1545, 1) OVER w), 0.0e0) AS underlying_log_return_1d,
    coalesce(ln(active_underlying_price_1545/lag(active_underlying_price_1545, 5) OVER w), 0.0e0) AS underlying_log_return_5d,
    coalesce(ln(active_underlying_price_1545/lag(active_underlying_price_1545, 22) OVER w), 0.0e0) AS underlying_log_return_22d,
    ln(greatest(CAST(total_trade_volume AS DOUBLE), 1.0e0)) AS log_total_trade_volume,
    ln(greatest(CAST(total_open_interest AS DOUBLE), 1.0e0)) AS log_total_open_interest,
    coalesce(median_rel_spread_1545, 0.0e0) AS median_rel_spread_1545,
    coalesce(last_value(surface_fit_rmse_iv IGNORE NULLS) OVER w, 0.0e0) AS surface_fit_rmse_iv,
    CAST(surface_node_count AS DOUBLE) AS surface_node_count, CAST(valid_expiry_count AS DOUBLE) AS valid_expiry_count
  FROM state WINDOW w AS (PARTITION BY option_root ORDER BY quote_date))
"""
SCALARS_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in features.SCALAR_COLUMNS)


@register(
    "scalar_features",
    "WIN3 WIN4",
    "WITH" + DAILY_SQL + SCALED_SQL + f"SELECT option_root, quote_date, {SCALARS_SQL} FROM scaled",
)
def scalar_features(spark, sf_dir):
    rows = features.with_scalar_features(daily_states(spark, sf_dir))
    return rounded(rows.select("option_root", "quote_date", *features.SCALAR_COLUMNS), 6, *features.SCALAR_COLUMNS)


@register(
    "trailing_mean",
    "WIN5",
    "WITH" + DAILY_SQL + """
SELECT option_root, quote_date,
       CASE WHEN count(*) OVER w = 5 THEN round(avg(state_z_000) OVER w, 6) END AS state_z_000_mean,
       CASE WHEN count(*) OVER w = 5 THEN round(avg(state_z_001) OVER w, 6) END AS state_z_001_mean
FROM state WINDOW w AS (PARTITION BY option_root ORDER BY quote_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def trailing_mean(spark, sf_dir):
    rows = features.trailing_mean(daily_states(spark, sf_dir), STATE_COLUMNS, 5)
    out = [f"{c}_mean" for c in STATE_COLUMNS]
    return rounded(rows.select("option_root", "quote_date", *out), 6, *out)


@register(
    "history_window",
    "WIN6",
    "WITH" + DAILY_SQL + """
SELECT option_root, quote_date, CAST(count(*) OVER w AS INT) AS days, round(first_value(state_z_000) OVER w, 6) AS oldest,
       round(state_z_001, 6) AS newest, round(sum(state_z_000 + state_z_001) OVER w, 6) AS total
FROM state WINDOW w AS (PARTITION BY option_root ORDER BY quote_date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)
QUALIFY count(*) OVER w = 22""",
)
def history_window(spark, sf_dir):
    rows = features.with_history(daily_states(spark, sf_dir), STATE_COLUMNS, 22).where(F.col("history").isNotNull())
    flat = F.flatten("history")
    total = F.aggregate(flat, F.lit(0.0), lambda acc, x: acc + x)
    out = rows.select(
        "option_root",
        "quote_date",
        F.size("history").alias("days"),
        F.element_at(flat, 1).alias("oldest"),
        F.element_at(flat, -1).alias("newest"),
        total.alias("total"),
    )
    return rounded(out, 6, "oldest", "newest", "total")


@register(
    "feature_rows",
    "WIN7 JON9",
    "WITH" + INDEX_SQL + SCALED_SQL + """
SELECT option_root, quote_date, target_date, history_start_index, history_end_index, surface_state_row_index,
       target_state_row_index, """ + SCALARS_SQL + """
FROM feat JOIN scaled USING (option_root, quote_date)""",
)
def feature_rows(spark, sf_dir):
    return rounded(daily_features(spark, sf_dir, features.SCALAR_COLUMNS), 6, *features.SCALAR_COLUMNS)


@register(
    "exclusion_ledger",
    "WIN8 JON9",
    "WITH" + INDEX_SQL + """SELECT option_root, quote_date, target_date, exclusion_reason FROM cand
WHERE exclusion_reason IS NOT NULL""",
)
def exclusion_ledger(spark, sf_dir):
    return calendar.exclusions(daily_candidates(spark, sf_dir))


@register(
    "exclusion_counts",
    "AGG12",
    "WITH" + INDEX_SQL + """SELECT option_root, exclusion_reason, CAST(count(*) AS BIGINT) AS rows FROM cand
WHERE exclusion_reason IS NOT NULL GROUP BY 1, 2""",
)
def exclusion_counts(spark, sf_dir):
    return calendar.exclusion_counts(calendar.exclusions(daily_candidates(spark, sf_dir)))


@register(
    "gather_states",
    "JON10",
    "WITH" + INDEX_SQL + """
SELECT f.option_root, f.quote_date, round(o.state_z_000, 6) AS origin_state_z_000, round(t.state_z_000, 6) AS target_state_z_000
FROM feat f JOIN state o ON o.option_root = f.option_root AND o.state_row_index = f.surface_state_row_index
JOIN state t ON t.option_root = f.option_root AND t.state_row_index = f.target_state_row_index""",
)
def gather_states(spark, sf_dir):
    states, column = daily_states(spark, sf_dir), STATE_COLUMNS[:1]
    rows = calendar.gather_states(daily_features(spark, sf_dir), states, column, prefix="origin_")
    rows = calendar.gather_states(rows, states, column, "target_state_row_index", "target_")
    out = ("origin_state_z_000", "target_state_z_000")
    return rounded(rows.select("option_root", "quote_date", *out), 6, *out)


@register(
    "split_labels",
    "WIN10 PRJ16",
    "WITH" + SPLIT_SQL + "SELECT option_root, quote_date, target_date, split_label FROM labelled",
)
def split_labels(spark, sf_dir):
    return daily_labelled(spark, sf_dir).select("option_root", "quote_date", "target_date", "split_label")


@register(
    "split_problems",
    "WIN10",
    "WITH" + INDEX_SQL + """
SELECT option_root, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS unordered_targets, CAST(0 AS BIGINT) AS targets_not_later,
       CAST(2700 AS BIGINT) AS required_rows FROM feat GROUP BY 1 HAVING count(*) < 2700""",
)
def split_problems(spark, sf_dir):
    return calendar.split_problems(daily_features(spark, sf_dir), 252, 504, 1944)


@register(
    "walk_forward_chunks",
    "WIN11 WIN12",
    "WITH" + SPLIT_SQL + """
SELECT c.option_root, c.chunk_id, min(c.target_date) AS chunk_start, max(c.target_date) AS chunk_end,
       CAST(count(*) AS BIGINT) AS chunk_rows,
       (SELECT CAST(count(*) AS BIGINT) FROM labelled l WHERE l.option_root = c.option_root AND l.target_date < min(c.target_date)) AS train_rows,
       (SELECT max(l.target_date) FROM labelled l WHERE l.option_root = c.option_root AND l.target_date < min(c.target_date)) AS train_end
FROM chunked c WHERE c.chunk_id >= 0 GROUP BY 1, 2""",
)
def walk_forward_chunks(spark, sf_dir):
    return calendar.chunk_windows(daily_chunks(spark, sf_dir))


@register(
    "chronology_violations",
    "WIN12",
    "WITH" + SPLIT_SQL.replace("21.0e0", "20.0e0") + """
SELECT option_root, chunk_id, max(target_date) AS train_end FROM chunked WHERE chunk_id >= 0 GROUP BY 1, 2 HAVING count(*) < 20""",
)
def chronology_violations(spark, sf_dir):
    """Chunk windows are clean; a leak put into every partial chunk must be reported."""
    windows = calendar.chunk_windows(daily_chunks(spark, sf_dir, refit_frequency=20))
    leaking = F.when(F.col("chunk_rows") < 20, F.col("chunk_end")).otherwise(F.col("train_end"))
    bad = calendar.chronology_violations(windows.withColumn("train_end", leaking))
    return bad.select("option_root", "chunk_id", "train_end")


@register(
    "holdout_split",
    "SRT3",
    "WITH" + SPLIT_SQL + """, tr AS (SELECT *, count(*) OVER (PARTITION BY option_root) AS n,
         row_number() OVER (PARTITION BY option_root ORDER BY quote_date DESC) AS r FROM labelled WHERE split_label = 'train')
SELECT option_root, quote_date, r <= greatest(1, floor(n/10.0e0)) AS is_holdout FROM tr""",
)
def holdout_split(spark, sf_dir):
    train = daily_labelled(spark, sf_dir).where("split_label = 'train'")
    return calendar.holdout_split(train).select("option_root", "quote_date", "is_holdout")


NORMAL_SQL = SPLIT_SQL + """,
used AS (
  SELECT DISTINCT s.* FROM state s JOIN labelled f ON f.option_root = s.option_root AND f.split_label = 'train'
   AND s.state_row_index BETWEEN f.history_end_index - 9 AND f.history_end_index),
stats AS (
  SELECT option_root, avg(state_z_000) AS m0, avg(state_z_001) AS m1,
         CASE WHEN stddev_pop(state_z_000) < 1e-6 THEN 1.0e0 ELSE stddev_pop(state_z_000) END AS s0,
         CASE WHEN stddev_pop(state_z_001) < 1e-6 THEN 1.0e0 ELSE stddev_pop(state_z_001) END AS s1
  FROM used GROUP BY 1)
"""


def daily_normalization(spark, sf_dir):
    states = daily_states(spark, sf_dir)
    train = daily_labelled(spark, sf_dir).where("split_label = 'train'")
    return features.normalization_stats(features.used_states(states, train, 10), STATE_COLUMNS)


@register(
    "normalization_stats",
    "AGG27",
    "WITH" + NORMAL_SQL + """SELECT option_root, round(m0, 6) AS state_z_000_mean, round(m1, 6) AS state_z_001_mean,
       round(s0, 6) AS state_z_000_std, round(s1, 6) AS state_z_001_std FROM stats""",
)
def normalization_stats(spark, sf_dir):
    stats = daily_normalization(spark, sf_dir)
    return rounded(stats, 6, *[c for c in stats.columns if c != "option_root"])


@register(
    "normalized_states",
    "AGG27",
    "WITH" + NORMAL_SQL + """SELECT s.option_root, s.quote_date, round((s.state_z_000 - m0)/s0, 5) AS state_z_000,
       round((s.state_z_001 - m1)/s1, 5) AS state_z_001 FROM state s JOIN stats USING (option_root)""",
)
def normalized_states(spark, sf_dir):
    scaled = features.normalize(daily_states(spark, sf_dir), daily_normalization(spark, sf_dir), STATE_COLUMNS)
    return rounded(scaled.select("option_root", "quote_date", *STATE_COLUMNS), 5, *STATE_COLUMNS)


@register(
    "forecast_window_summary",
    "AGG11",
    "WITH" + INDEX_SQL + """
SELECT option_root, 'raw_trading_days' AS window_name, min(quote_date) AS start_date, max(quote_date) AS end_date, CAST(count(*) AS BIGINT) AS row_count FROM idx GROUP BY 1
UNION ALL SELECT option_root, 'feature_candidates', min(quote_date), max(quote_date), count(*) FROM cand GROUP BY 1
UNION ALL SELECT option_root, 'surface_states', min(quote_date), max(quote_date), count(*) FROM state GROUP BY 1
UNION ALL SELECT option_root, 'feature_origins', min(quote_date), max(quote_date), count(*) FROM feat GROUP BY 1
UNION ALL SELECT option_root, 'feature_targets', min(target_date), max(target_date), count(*) FROM feat GROUP BY 1
UNION ALL SELECT option_root, 'feature_exclusions', min(quote_date), max(quote_date), count(*) FROM cand
          WHERE exclusion_reason IS NOT NULL GROUP BY 1""",
)
def forecast_window_summary(spark, sf_dir):
    candidates = daily_candidates(spark, sf_dir)
    return calendar.forecast_window_summary(
        daily_index(spark, sf_dir),
        daily_states(spark, sf_dir),
        daily_features(spark, sf_dir),
        calendar.exclusions(candidates),
    )


# --- stage ledger -----------------------------------------------------------------------------

LEDGER_SQL = INDEX_SQL + """,
diag AS (
  SELECT option_root, quote_date, n AS subset_rows, CASE WHEN n > 1 THEN n ELSE 0 END AS clean_rows,
         CASE WHEN k % 7 = 0 THEN 0 ELSE least(n, 5) END AS valid_expiries, 10*n AS nodes, least(n, 6) AS expiries
  FROM (SELECT option_root, quote_date, total_trade_volume AS n, total_open_interest AS k FROM daily)),
ledger AS (
  SELECT i.quote_date, i.option_root, i.next_trading_date AS target_date, i.trading_day_index, d.*
         EXCLUDE (quote_date, option_root), i.has_surface_state, c.exclusion_reason, f.quote_date IS NOT NULL AS kept,
         CASE WHEN clean_rows <= 0 THEN 'cleaning' WHEN valid_expiries <= 0 THEN 'forward_estimation'
              WHEN NOT (nodes >= 40 AND expiries >= 4) THEN 'node_construction' WHEN NOT i.has_surface_state THEN 'ssvi_calibration'
              WHEN c.exclusion_reason IS NOT NULL THEN 'feature_target_formation' END AS stage
  FROM idx i JOIN diag d USING (option_root, quote_date)
  LEFT JOIN cand c ON c.option_root = i.option_root AND c.quote_date = i.quote_date AND c.exclusion_reason IS NOT NULL
  LEFT JOIN feat f ON f.option_root = i.option_root AND f.quote_date = i.quote_date),
coded AS (
  SELECT *, CASE stage WHEN 'cleaning' THEN 'cleaning_eliminated_all_contracts'
                WHEN 'forward_estimation' THEN 'fewer_than_3_matched_strikes'
                WHEN 'node_construction' THEN concat_ws(',', CASE WHEN nodes < 40 THEN 'below_min_surface_nodes' END,
                                                       CASE WHEN expiries < 4 THEN 'below_min_valid_expiries' END)
                WHEN 'ssvi_calibration' THEN 'missing_ssvi_state'
                WHEN 'feature_target_formation' THEN exclusion_reason ELSE '' END AS codes FROM ledger)
"""


def daily_ledger(spark, sf_dir):
    """Stage ledger with build counts derived from the order counts of each day."""
    n = F.col("total_trade_volume")
    valid = F.when(F.col("total_open_interest") % 7 == 0, 0).otherwise(F.least(n, F.lit(5)))
    diagnostics = daily(spark, sf_dir).select(
        "option_root",
        "quote_date",
        n.alias("subset_rows"),
        F.when(n > 1, n).otherwise(0).alias("clean_contract_rows"),
        valid.alias("forward_term_rows"),
        F.least(n, F.lit(5)).alias("forward_total_expiries"),
        valid.alias("forward_valid_expiries"),
        (F.least(n, F.lit(5)) - valid).alias("forward_invalid_expiries"),
        F.when(valid == 0, F.array(F.lit("fewer_than_3_matched_strikes"))).alias("forward_invalid_reason_codes"),
        (n * 10).alias("surface_node_count"),
        F.least(n, F.lit(6)).alias("valid_expiry_count"),
        F.lit(1).alias("root_count"),
        ((n >= 4) & (F.least(n, F.lit(6)) >= 4)).alias("modeling_valid"),
    )
    candidates = daily_candidates(spark, sf_dir)
    return ledger.stage_ledger(
        daily_index(spark, sf_dir), diagnostics, daily_features(spark, sf_dir), calendar.exclusions(candidates)
    )


@register(
    "stage_ledger",
    "WIN18 JON11",
    "WITH" + LEDGER_SQL + """
SELECT quote_date, target_date, option_root, trading_day_index, CAST(clean_rows AS BIGINT) AS clean_contract_rows,
       CAST(valid_expiries AS BIGINT) AS forward_valid_expiries, has_surface_state,
       exclusion_reason AS feature_exclusion_reason, kept AS feature_row_kept, stage AS first_failed_stage, codes AS reason_codes
FROM coded""",
)
def stage_ledger(spark, sf_dir):
    rows = daily_ledger(spark, sf_dir)
    return rows.select(
        "quote_date", "target_date", "option_root", "trading_day_index", "clean_contract_rows",
        "forward_valid_expiries", "has_surface_state", "feature_exclusion_reason", "feature_row_kept",
        "first_failed_stage", F.array_join("first_failure_reason_codes", ",").alias("reason_codes"),
    )


@register(
    "coverage_by_year",
    "AGG10",
    "WITH" + LEDGER_SQL + """
SELECT option_root, CAST(year(quote_date) AS INT) AS year, CAST(count(*) AS BIGINT) AS raw_trading_days,
       CAST(count(*) FILTER (clean_rows > 0) AS BIGINT) AS days_after_cleaning,
       CAST(count(*) FILTER (valid_expiries > 0) AS BIGINT) AS days_with_forward_terms,
       CAST(count(nodes) AS BIGINT) AS days_with_node_quality,
       CAST(count(*) FILTER (nodes >= 40 AND expiries >= 4) AS BIGINT) AS modeling_valid_days,
       CAST(count(*) FILTER (has_surface_state) AS BIGINT) AS ssvi_state_days,
       CAST(count(target_date) AS BIGINT) AS feature_candidate_days, CAST(count(*) FILTER (kept) AS BIGINT) AS feature_rows,
       CAST(count(*) FILTER (target_date IS NULL) AS BIGINT) AS terminal_days,
       CAST(sum(least(subset_rows, 5) - valid_expiries) AS BIGINT) AS forward_invalid_expiry_count
FROM coded GROUP BY 1, 2""",
)
def coverage_by_year(spark, sf_dir):
    return ledger.coverage_by_year(daily_ledger(spark, sf_dir), ("option_root",))


@register(
    "failure_counts_by_year",
    "AGG10",
    "WITH" + LEDGER_SQL + """
SELECT option_root, CAST(year(quote_date) AS INT) AS year, 'stage' AS kind, stage AS code, CAST(count(*) AS BIGINT) AS days
FROM coded WHERE stage IS NOT NULL GROUP BY 1, 2, 4
UNION ALL
SELECT option_root, CAST(year(quote_date) AS INT), 'reason', code, CAST(count(*) AS BIGINT)
FROM (SELECT option_root, quote_date, unnest(string_split(codes, ',')) AS code FROM coded WHERE codes <> '') GROUP BY 1, 2, 4""",
)
def failure_counts_by_year(spark, sf_dir):
    return ledger.failure_counts_by_year(daily_ledger(spark, sf_dir), ("option_root",))
