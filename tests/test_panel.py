from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel.functions import ssvi
from volpanel.operators import calendar, clean, features, forecast, ledger

START = date(2020, 1, 2)


def state_panel(spark, n, skip=(), roots=("SPX",)):
    rows = []
    for root in roots:
        for i in range(n):
            if i in skip:
                continue
            theta = np.linspace(0.02, 0.06, 11) + 0.0003 * i
            raw = [*np.log(theta), -0.35 + 0.001 * i, -0.25, 0.0]
            rows.append((
                root, START + timedelta(days=i), 3000.0 + i, 10000 + 10 * i, 20000 + 20 * i, 0.01 + 1e-4 * i,
                0.005 + 1e-4 * i, 60, 5, *[float(v) for v in raw],
            ))
    schema = (
        "option_root string, quote_date date, active_underlying_price_1545 double, total_trade_volume bigint, "
        "total_open_interest bigint, median_rel_spread_1545 double, surface_fit_rmse_iv double, surface_node_count bigint, "
        "valid_expiry_count bigint, " + ", ".join(f"{c} double" for c in ssvi.LATENT_COLUMNS)
    )
    return features.with_scalar_features(calendar.with_state_row_index(spark.createDataFrame(rows, schema)))


def dates(spark, n, roots=("SPX",)):
    return spark.createDataFrame([(r, START + timedelta(days=i)) for r in roots for i in range(n)], "option_root string, quote_date date")


def artifacts(spark, n, skip=(), roots=("SPX",)):
    states = state_panel(spark, n, skip, roots)
    candidates = calendar.labelled_candidates(calendar.trading_date_index(dates(spark, n, roots), states))
    return states, candidates, calendar.feature_rows(candidates, states, features.SCALAR_COLUMNS)


def test_feature_rows_start_after_the_history_window(spark):
    _, _, rows = artifacts(spark, 32)
    ordered = rows.orderBy("quote_date").collect()
    assert len(ordered) == 10
    assert ordered[0].quote_date == START + timedelta(days=21)
    assert ordered[0].target_date == START + timedelta(days=22)
    labelled = calendar.label_splits(rows, 2, 2)
    counts = {r.split_label: r["count"] for r in labelled.groupBy("split_label").count().collect()}
    assert counts == {"train": 6, "validation": 2, "test": 2}
    assert calendar.split_problems(rows, 2, 2, 6).count() == 0
    assert calendar.split_problems(rows, 2, 2, 7).count() == 1


def test_panels_do_not_mix(spark):
    _, _, one = artifacts(spark, 32)
    _, _, two = artifacts(spark, 32, roots=("SPX", "XYZ"))
    drop = lambda df, r: sorted(tuple(x) for x in df.where(F.col("option_root") == r).drop("option_root").collect())
    assert drop(two, "SPX") == drop(two, "XYZ") == drop(one, "SPX")


def test_missing_day_is_never_skipped_over(spark):
    _, candidates, rows = artifacts(spark, 26, skip=(23,))
    prior, missing, after = [START + timedelta(days=d) for d in (22, 23, 24)]
    assert rows.where((F.col("quote_date") == prior) & (F.col("target_date") == after)).count() == 0
    excluded = calendar.exclusions(candidates).where(F.col("quote_date") == prior).collect()
    assert [(r.exclusion_reason, r.target_date) for r in excluded] == [("missing_target_state", missing)]


def test_leading_dates_without_state(spark):
    states = state_panel(spark, 28, skip=(0, 1))
    index = calendar.trading_date_index(dates(spark, 28), states).orderBy("quote_date").collect()
    assert [r.has_surface_state for r in index[:3]] == [False, False, True]
    assert [r.surface_state_row_index for r in index[:3]] == [None, None, 0]
    assert index[-1].next_trading_date is None


def test_future_shock_does_not_reach_earlier_features(spark):
    states = state_panel(spark, 28)
    shocked = features.with_scalar_features(
        states.withColumn("total_trade_volume", F.when(F.col("state_row_index") >= 25, 10**9).otherwise(F.col("total_trade_volume")))
    )
    before = F.col("state_row_index") < 25
    assert states.where(before).select(*features.SCALAR_COLUMNS).exceptAll(shocked.where(before).select(*features.SCALAR_COLUMNS)).count() == 0


def test_normalization_uses_training_rows_only(spark):
    states = state_panel(spark, 35).withColumn(
        "surface_fit_rmse_iv", F.when(F.col("state_row_index") >= 30, 25.0).otherwise(F.col("surface_fit_rmse_iv"))
    )
    index = calendar.trading_date_index(dates(spark, 35), states)
    rows = calendar.feature_rows(calendar.labelled_candidates(index), states)
    train = rows.orderBy("quote_date").limit(6)
    used = features.used_states(states, train, 10)
    assert sorted(r.state_row_index for r in used.collect()) == list(range(12, 27))
    stats = features.normalization_stats(used, features.HISTORY_COLUMNS).first()
    values = np.array([[r[c] for c in features.HISTORY_COLUMNS] for r in used.collect()], dtype=float)
    assert np.allclose([stats[f"{c}_mean"] for c in features.HISTORY_COLUMNS], values.mean(axis=0))
    deviations = values.std(axis=0)
    deviations[deviations < 1e-6] = 1.0
    assert np.allclose([stats[f"{c}_std"] for c in features.HISTORY_COLUMNS], deviations)
    assert stats["surface_fit_rmse_iv_mean"] < 1.0


def test_trailing_mean_and_history_need_a_full_window(spark):
    states = state_panel(spark, 8)
    rows = features.trailing_mean(states, ("active_underlying_price_1545",), 3).orderBy("quote_date").collect()
    got = [r.active_underlying_price_1545_mean for r in rows]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([3001.0 + i for i in range(6)])
    windows = features.with_history(states, features.HISTORY_COLUMNS, 3).orderBy("quote_date").collect()
    assert windows[1].history is None and np.array(windows[2].history).shape == (3, 23)
    with pytest.raises(Exception, match="underflow"):
        features.with_history(states, features.HISTORY_COLUMNS, 3, strict=True).collect()
    with pytest.raises(ValueError):
        features.trailing_mean(states, ("state_z_000",), 0)


def test_non_positive_price_is_an_error(spark):
    rows = [("SPX", START + timedelta(days=i), p) for i, p in enumerate((1.0, 0.0, 2.0))]
    frame = spark.createDataFrame(rows, "option_root string, quote_date date, price double")
    with pytest.raises(Exception, match="positive prices"):
        frame.withColumn("r", features.log_return("price", 1)).collect()


def test_walk_forward_buckets_and_chronology(spark):
    _, _, rows = artifacts(spark, 40)
    bucketed = calendar.walk_forward_buckets(calendar.label_splits(rows, 3, 7), "test", 3)
    windows = {r.chunk_id: r for r in calendar.chunk_windows(bucketed).collect()}
    assert {c: (r.chunk_rows, r.train_rows) for c, r in windows.items()} == {0: (3, 11), 1: (3, 14), 2: (1, 17)}
    assert calendar.chronology_violations(calendar.chunk_windows(bucketed)).count() == 0
    validation = calendar.walk_forward_buckets(calendar.label_splits(rows, 3, 7), "validation", 3)
    assert validation.where("split_label = 'test'").count() == 0


def test_var1_matches_least_squares_per_chunk(spark):
    rng = np.random.default_rng(3)
    n, columns = 60, ("state_z_000", "state_z_001", "state_z_002")
    walk = np.cumsum(rng.normal(size=(n, 3)), axis=0) * 0.1 + np.array([3.0, -2.0, 0.5])
    rows = [("SPX", START + timedelta(days=i), *map(float, walk[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "option_root string, quote_date date, " + ", ".join(f"{c} double" for c in columns))
    states = calendar.with_state_row_index(frame)
    index = calendar.trading_date_index(frame, states)
    kept = calendar.feature_rows(calendar.labelled_candidates(index, 1), states, (), 1)
    bucketed = calendar.walk_forward_buckets(calendar.label_splits(kept, 5, 14), "test", 5)
    got = {r.forecast_origin: r for r in forecast.StateVar1(columns).fit_predict(bucketed, states).collect()}
    assert len(got) == 14
    first_test = (n - 1) - 14
    for k in range(14):
        origin = first_test + k
        train = first_test + 5 * (k // 5)
        design = np.column_stack([np.ones(train), walk[:train]])
        coefficients = np.linalg.lstsq(design, walk[1 : train + 1], rcond=None)[0]
        expected = np.concatenate([[1.0], walk[origin]]) @ coefficients
        row = got[START + timedelta(days=origin)]
        assert np.allclose([row[c] for c in columns], expected, rtol=1e-8)
        assert row.target_date == START + timedelta(days=origin + 1)


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_direct_history_matches_ridge(spark, block_rows):
    rng = np.random.default_rng(5)
    n, history, penalties = 70, 3, (0.5, 2.0, 50.0)
    walk = np.cumsum(rng.normal(size=(n, 2)), axis=0) * 0.1
    rows = [("SPX", START + timedelta(days=i), *map(float, walk[i])) for i in range(n)]
    columns = ("state_z_000", "state_z_001")
    frame = spark.createDataFrame(rows, "option_root string, quote_date date, state_z_000 double, state_z_001 double")
    states = calendar.with_state_row_index(frame)
    kept = calendar.feature_rows(
        calendar.labelled_candidates(calendar.trading_date_index(frame, states), history), states, (), history
    )
    bucketed = calendar.walk_forward_buckets(calendar.label_splits(kept, 6, 12), "test", 6)
    model = forecast.DirectHistory(columns, columns, history, penalties, block_rows=block_rows)
    got = {r.forecast_origin: r for r in model.fit_predict(bucketed, states).collect()}
    origins = list(range(history - 1, n - 1))
    prior = len(origins) - 12
    y = np.stack([walk[o + 1] for o in origins])

    def ridge(design, target, penalty):
        weights = np.diag([1e-9] + [penalty] * (design.shape[1] - 1))
        return np.linalg.solve(design.T @ design + weights, design.T @ target)

    for k in range(12):
        train = prior + 6 * (k // 6)
        fit = train - max(1, train // 10)
        used = walk[: origins[fit - 1] + 1]
        z = (walk - used.mean(axis=0)) / used.std(axis=0)
        x = np.stack([np.append(1.0, z[o - history + 1 : o + 1].ravel()) for o in origins])
        held = [np.sum((y[fit:train] - x[fit:train] @ ridge(x[:fit], y[:fit], p)) ** 2) for p in penalties]
        expected = x[prior + k] @ ridge(x[:train], y[:train], penalties[int(np.argmin(held))])
        row = got[START + timedelta(days=origins[prior + k])]
        assert np.allclose([row[c] for c in columns], expected, rtol=1e-7)


def test_refits_need_training_rows(spark):
    frame = dates(spark, 12).withColumn("chunk_id", F.when(F.col("quote_date") < F.lit(START + timedelta(days=5)), -1).otherwise(0))
    with pytest.raises(Exception, match="a refit needs 6 training rows, found 5"):
        forecast.refit_cuts(frame, ("option_root",)).collect()


def test_holdout_split(spark):
    frame = dates(spark, 25)
    assert calendar.holdout_split(frame).where("is_holdout").count() == 2
    with pytest.raises(Exception, match="holdout"):
        calendar.holdout_split(dates(spark, 5)).collect()


LEDGER_DAYS = [date(2020, 1, d) for d in (2, 3, 6, 7, 8, 9, 10)]


def golden_ledger(spark):
    d = LEDGER_DAYS
    index = spark.createDataFrame(
        [("SPX", d[i], i, d[i + 1] if i < 6 else None, i in (3, 5, 6), {3: 0, 5: 1, 6: 2}.get(i)) for i in range(7)],
        "option_root string, quote_date date, trading_day_index bigint, next_trading_date date, has_surface_state boolean, "
        "surface_state_row_index bigint",
    )
    def day(i, clean_rows, terms, total, valid, invalid, reasons=None, nodes=None, expiries=None, roots=None, ok=False):
        return ("SPX", d[i], 120, clean_rows, terms, total, valid, invalid, reasons, nodes, expiries, roots, ok)

    diagnostics = spark.createDataFrame(
        [
            day(0, 0, 0, 0, 0, 0),
            day(1, 60, 0, 3, 0, 3, ["fewer_than_3_matched_strikes"]),
            day(2, 60, 4, 4, 4, 0, None, 18, 3, 1),
            day(3, 60, 5, 5, 5, 0, None, 55, 5, 1, True),
            day(4, 0, 0, 0, 0, 0),
            day(5, 60, 5, 5, 5, 0, None, 60, 5, 1, True),
            day(6, 60, 5, 5, 5, 0, None, 61, 5, 1, True),
        ],
        "option_root string, quote_date date, subset_rows bigint, clean_contract_rows bigint, forward_term_rows bigint, "
        "forward_total_expiries bigint, forward_valid_expiries bigint, forward_invalid_expiries bigint, "
        "forward_invalid_reason_codes array<string>, surface_node_count bigint, valid_expiry_count bigint, root_count bigint, "
        "modeling_valid boolean",
    )
    kept = spark.createDataFrame([("SPX", d[5])], "option_root string, quote_date date")
    why = ["missing_origin_state"] * 3 + ["missing_target_state", "missing_origin_state"]
    excluded = spark.createDataFrame([("SPX", d[i], why[i]) for i in range(5)], "option_root string, quote_date date, exclusion_reason string")
    return index, diagnostics, kept, excluded


def test_stage_ledger_golden_week(spark):
    table = ledger.stage_ledger(*golden_ledger(spark))
    rows = {r.quote_date: r for r in table.collect()}
    expected = [
        ("cleaning", ["cleaning_eliminated_all_contracts"]),
        ("forward_estimation", ["fewer_than_3_matched_strikes"]),
        ("node_construction", ["below_min_surface_nodes", "below_min_valid_expiries"]),
        ("feature_target_formation", ["missing_target_state"]),
        ("cleaning", ["cleaning_eliminated_all_contracts"]),
        (None, []),
        (None, []),
    ]
    for day, (stage, codes) in zip(LEDGER_DAYS, expected):
        assert (rows[day].first_failed_stage, rows[day].first_failure_reason_codes) == (stage, codes)
    assert rows[LEDGER_DAYS[5]].feature_row_kept and not rows[LEDGER_DAYS[6]].has_next_trading_date
    year = ledger.coverage_with_counts(table).first().asDict()
    assert year == {
        "year": 2020, "raw_trading_days": 7, "days_after_cleaning": 5, "days_with_forward_terms": 4, "days_with_node_quality": 4,
        "modeling_valid_days": 3, "ssvi_state_days": 3, "feature_candidate_days": 6, "feature_rows": 1, "terminal_days": 1,
        "forward_invalid_expiry_count": 3,
        "first_failed_stage_counts": {"cleaning": 2, "feature_target_formation": 1, "forward_estimation": 1, "node_construction": 1},
        "first_failure_reason_counts": {
            "below_min_surface_nodes": 1, "below_min_valid_expiries": 1, "cleaning_eliminated_all_contracts": 2,
            "fewer_than_3_matched_strikes": 1, "missing_target_state": 1,
        },
    }


def test_stage_ledger_rejects_contradictions(spark):
    index, diagnostics, kept, excluded = golden_ledger(spark)
    both = excluded.unionByName(kept.withColumn("exclusion_reason", F.lit("missing_target_state")))
    with pytest.raises(Exception, match="kept and excluded"):
        ledger.stage_ledger(index, diagnostics, kept, both).collect()
    with pytest.raises(Exception, match="neither kept nor excluded"):
        ledger.stage_ledger(index, diagnostics, kept.limit(0), excluded).collect()


def test_early_close_makes_time_to_settlement_longer(spark):
    row = (date(2020, 11, 27), date(2020, 12, 18))
    frame = spark.createDataFrame([row], "quote_date date, expiration date")
    normal = frame.select(clean.year_fraction(F.lit(False)).alias("t")).first().t
    early = frame.select(clean.year_fraction(F.lit(True)).alias("t")).first().t
    assert early > normal == pytest.approx((21 * 86400 - 22500) / 31536000)
    spring = spark.createDataFrame([(date(2020, 3, 6), date(2020, 3, 20))], "quote_date date, expiration date")
    assert spring.select(clean.year_fraction(F.lit(False)).alias("t")).first().t == pytest.approx((14 * 86400 - 22500) / 31536000)
    with pytest.raises(Exception, match="does not follow"):
        spark.createDataFrame([(row[0], row[0])], "quote_date date, expiration date").select(clean.year_fraction(F.lit(False))).collect()
