from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel.operators import compare


def losses(spark, series, metric="m"):
    rows = [(metric, name, date(2020, 1, 1) + timedelta(days=i), float(v)) for name, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, model_name string, target_date date, loss double")


# Golden loss series; the expected statistics stand beside their tests.
DM_A = [0.80, 1.00, 1.10, 0.95, 1.05, 0.90, 1.15, 0.98]
DM_B = [1.05, 1.10, 1.20, 1.08, 1.16, 1.02, 1.22, 1.09]
DOMINATED = {
    "best": [0.10, 0.12, 0.11, 0.10, 0.13, 0.09, 0.11, 0.12],
    "mid": [0.20, 0.22, 0.21, 0.20, 0.23, 0.19, 0.21, 0.22],
    "worst": [0.80, 0.82, 0.81, 0.80, 0.83, 0.79, 0.81, 0.82],
}
AUTOCORRELATED = {
    "a": [0.30, 0.35, 0.33, 0.36, 0.34, 0.37, 0.35, 0.38, 0.36, 0.39],
    "b": [0.32, 0.34, 0.36, 0.35, 0.37, 0.36, 0.38, 0.37, 0.39, 0.38],
    "c": [0.50, 0.52, 0.51, 0.53, 0.52, 0.54, 0.53, 0.55, 0.54, 0.56],
}


def test_diebold_mariano_golden(spark):
    row = compare.diebold_mariano(losses(spark, {"a": DM_A, "b": DM_B}), bandwidth=2).first()
    assert row.statistic == pytest.approx(-7.148256223078783, rel=1e-10)
    assert row.p_value == pytest.approx(0.00018564281821276118, rel=1e-8)
    assert row.adjusted_p_value == row.p_value and row.n_obs == 8


def test_bandwidth_is_limited_by_the_sample(spark):
    short = losses(spark, {"a": [1.0, 1.1, 0.9], "b": [1.2, 1.3, 1.1]})
    row = compare.diebold_mariano(short, bandwidth=5).first()
    assert np.isfinite(row.statistic) and 0.0 <= row.p_value <= 1.0


def test_holm_is_monotone_and_capped(spark):
    rows = [("m", f"a{i}", "b", p) for i, p in enumerate((0.04, 0.01, 0.03, 0.6))]
    adjusted = compare.holm_adjust(spark.createDataFrame(rows, "metric string, model_a string, model_b string, p_value double"))
    got = {r.model_a: r.adjusted_p_value for r in adjusted.collect()}
    assert got == pytest.approx({"a1": 0.04, "a2": 0.09, "a0": 0.09, "a3": 0.6})


@pytest.mark.parametrize(
    ("series", "problem"),
    [
        ({"a": [1.0, 2.0, 3.0]}, "fewer_than_two_models"),
        ({"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0]}, "unequal_length"),
        ({"a": [1.0, 2.0, float("nan")], "b": [1.0, 2.0, 3.0]}, "non_finite_loss"),
        ({"a": [1.0, 2.0], "b": [1.0, 2.0]}, "too_few_observations"),
    ],
)
def test_loss_validation(spark, series, problem):
    assert [r.problem for r in compare.loss_problems(losses(spark, series)).collect()] == [problem]
    with pytest.raises(ValueError, match=problem):
        compare.require_comparable(losses(spark, series))


def test_unaligned_dates_are_refused(spark):
    early = losses(spark, {"a": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]})
    late = losses(spark, {"b": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}).withColumn("target_date", F.date_add("target_date", 3))
    both = early.unionByName(late)
    assert [r.problem for r in compare.loss_problems(both).collect()] == ["unaligned_dates"]
    for call in (compare.diebold_mariano, compare.confidence_set_steps):
        with pytest.raises(ValueError, match="unaligned_dates"):
            call(both)
    with pytest.raises(Exception, match="a model has no loss on some dates"):
        compare.bootstrap_means(both, compare.BootstrapSettings(5, 2, 1)).collect()


def test_a_null_panel_is_checked_too(spark):
    frame = losses(spark, {"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0]}, None)
    assert [r.problem for r in compare.loss_problems(frame).collect()] == ["unequal_length"]


def chosen(spark, frame, settings):
    steps = compare.confidence_set_steps(frame, settings=settings)
    sets = {r.method: r for r in compare.confidence_set(steps, frame).collect()}
    return {(r.method, r.step): r for r in steps.collect()}, sets


def test_dominated_models_are_eliminated(spark):
    frame = losses(spark, DOMINATED)
    steps, sets = chosen(spark, frame, compare.BootstrapSettings(400, 4, 7))
    for method, statistic in (("Tmax", 650000.0), ("TR", 700000.0)):
        assert sets[method].elimination_order == ["worst", "mid"]
        assert sets[method].included_models == ["best"]
        assert sets[method].excluded_models == ["mid", "worst"]
        assert steps[method, 1].observed_statistic == pytest.approx(statistic, rel=1e-6)


def test_equal_models_all_stay(spark):
    same = [0.20, 0.30, 0.25, 0.22, 0.28, 0.27]
    steps, sets = chosen(spark, losses(spark, {"m1": same, "m2": same, "m3": same}), compare.BootstrapSettings(300, 3, 11))
    for method in compare.METHODS:
        assert sets[method].included_models == ["m1", "m2", "m3"] and sets[method].excluded_models == []
        assert steps[method, 1].observed_statistic == pytest.approx(0.0, abs=1e-9)
        assert steps[method, 1].p_value == 1.0


def test_autocorrelated_elimination_order_and_several_panels(spark):
    frame = losses(spark, AUTOCORRELATED, "x").unionByName(losses(spark, DOMINATED, "y"))
    steps = compare.confidence_set_steps(frame, settings=compare.BootstrapSettings(500, 5, 19))
    sets = {(r.metric, r.method): r.elimination_order for r in compare.confidence_set(steps, frame).collect()}
    for method in compare.METHODS:
        assert sets["x", method] == ["c", "b"] and sets["y", method] == ["worst", "mid"]


def test_step_matches_numpy_on_the_same_paths(spark):
    settings = compare.BootstrapSettings(200, 4, 5)
    frame = losses(spark, AUTOCORRELATED)
    lengths = spark.createDataFrame([("m", 10)], "metric string, length bigint")
    paths = compare.bootstrap_paths(lengths, settings).toPandas().sort_values(["draw", "offset"])
    index = paths["position"].to_numpy().reshape(200, 10)
    assert ((index >= 0) & (index < 10)).all()
    matrix = np.column_stack([AUTOCORRELATED[k] for k in "abc"])
    means, observed = matrix[index].mean(axis=1), matrix.mean(axis=0)
    gap = means - observed
    d = (3 * gap - gap.sum(axis=1, keepdims=True)) / 2
    o = (3 * observed - observed.sum()) / 2
    sd = np.sqrt(np.maximum(d.var(axis=0, ddof=1), 1e-12))
    tmax, boot = (o / sd).max(), (d / sd).max(axis=1)
    dd = gap[:, :, None] - gap[:, None, :]
    oo = observed[:, None] - observed[None, :]
    sdd = np.sqrt(np.maximum(dd.var(axis=0, ddof=1), 1e-12))
    tr, bootr = np.abs(oo / sdd).max(), np.abs(dd / sdd).max(axis=(1, 2))
    steps = {r.method: r for r in compare.confidence_set_steps(frame, settings=settings).where("step = 1").collect()}
    assert steps["Tmax"].observed_statistic == pytest.approx(tmax, rel=1e-9)
    assert steps["Tmax"].p_value == pytest.approx((boot >= tmax).mean())
    assert steps["TR"].observed_statistic == pytest.approx(tr, rel=1e-9)
    assert steps["TR"].p_value == pytest.approx((bootr >= tr).mean())


def test_draws_are_dealt_to_tasks_and_units_change_no_row(spark):
    frame = losses(spark, AUTOCORRELATED, "x").unionByName(losses(spark, DOMINATED, "y"))
    whole = compare.BootstrapSettings(120, 4, 5, unit_draws=1000)
    split = compare.BootstrapSettings(120, 4, 5, unit_draws=7)
    tables = [
        {(r.metric, r.draw, r.model_name): r.mean_loss for r in compare.bootstrap_means(frame, s).collect()} for s in (whole, split)
    ]
    assert tables[0] == tables[1] and len(tables[0]) == 2 * 121 * 6 // 2
    # Both panels are without the other's models; those have no row.
    assert {m for p, _, m in tables[0] if p == "x"} == {"a", "b", "c"}
    lengths = spark.createDataFrame([("m", 10)], "metric string, length bigint")
    dealt = compare.bootstrap_paths(lengths, split)
    assert dealt.rdd.getNumPartitions() == 18 and compare.bootstrap_paths(lengths, whole).rdd.getNumPartitions() == 8
    busy = dealt.select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy > 8 and dealt.exceptAll(compare.bootstrap_paths(lengths, whole)).isEmpty()


def test_gaps_from_losses_equal_gaps_from_means(spark):
    settings = compare.BootstrapSettings(40, 4, 5, unit_draws=9)
    frame = losses(spark, AUTOCORRELATED, "x").unionByName(losses(spark, DOMINATED, "y"))
    straight = compare.drawn_gaps(frame, settings, ("metric",), compare.model_names(frame))
    regrouped = compare.draw_rows(compare.bootstrap_means(frame, settings))
    assert straight.count() == 80 and straight.exceptAll(regrouped).isEmpty()


def test_parts_change_no_step(spark):
    frame = losses(spark, AUTOCORRELATED)
    steps = [
        sorted(compare.confidence_set_steps(frame, settings=compare.BootstrapSettings(200, 4, 5, unit_draws=u)).collect())
        for u in (200, 11)
    ]
    for one, other in zip(*steps):
        assert one.eliminated_model == other.eliminated_model and one.p_value == pytest.approx(other.p_value, abs=1e-12)
        assert one.observed_statistic == pytest.approx(other.observed_statistic, rel=1e-12)
