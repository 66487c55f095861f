import math
from datetime import date

import numpy as np
import pytest
from corpus import business_days, day_quotes, write_archive, archive_name
from pyspark.sql import Window
from pyspark.sql import functions as F

from volpanel.functions import exact, ssvi
from volpanel.operators import calibrate, compare, forecast, nodes, parity, score, skew, surface, tuning
from volpanel.plans.build import BuildSettings, ExperimentSettings, build_panel, run_experiment
from volpanel.sources import vendor
from volpanel.sources.schema import quote_schema

KEY = ("option_root", "quote_date")


def true_nodes(spark, raw=(0.02, 0.05, -0.4, -0.8, 0.2)):
    latent = [*np.log(np.linspace(raw[0], raw[1], 11)), *raw[2:]]
    schema = "option_root string, quote_date date, " + ", ".join(f"{c} double" for c in ssvi.LATENT_COLUMNS)
    state = spark.createDataFrame([("SPX", date(2020, 1, 2), *map(float, latent))], schema)
    taus = [d / 365.0 for d in (10, 30, 60, 91, 182, 365, 730)]
    grid = surface.on_grid(ssvi.with_constrained(state), [-0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2], taus)
    return ssvi.with_implied_vol(grid, "node_iv").select(
        *KEY, "m", "tau", "node_iv", (1.0 + 0.1 * F.col("m_no")).alias("node_vega"),
        (F.col("m_no") * 5.0 + 3000.0).alias("strike"), F.date_add("quote_date", F.col("tau_no")).alias("expiration"),
    )


def rmse(panel, fitted):
    return score.fit_diagnostics(calibrate.fitted_nodes(panel, fitted)).first().fit_rmse_iv


def test_calibration_recovers_a_surface(spark):
    panel = true_nodes(spark)
    lattice = calibrate.lattice_fit(panel)
    assert rmse(panel, lattice) < 2e-3
    refined = calibrate.refine_fit(panel, lattice, iterations=4)
    assert rmse(panel, refined) < 2e-5
    assert refined.select(ssvi.parameters_valid().alias("ok")).first().ok


def test_refinement_never_loses_to_its_start(spark):
    panel = true_nodes(spark).withColumn("node_iv", F.col("node_iv") + F.when(F.col("m") > 0.15, 0.03).otherwise(0.0))
    start = surface.initial_surface(panel)
    before = calibrate.fitted_nodes(panel, start).select(
        score.weighted_huber(F.col("predicted_iv") - F.col("node_iv"), F.col("node_vega")).alias("l")
    ).first().l
    after = calibrate.refine_fit(panel, start, iterations=3).first().loss
    assert after <= before


def test_rounding_in_the_nodes_does_not_grow(spark):
    """Few maturities leave several knots undetermined; nodes moved by 1e-15 must give the same state."""
    panel = true_nodes(spark).where("tau > 0.05 AND tau < 0.6").withColumn("node_iv", F.col("node_iv") + 0.004 * F.abs("m"))
    sign = F.when(F.xxhash64("m", "tau") % 2 == 0, 1.0).otherwise(-1.0)
    moved = panel.withColumns({"m": F.col("m") + sign * 1e-15, "node_iv": F.col("node_iv") * (1.0 - sign * 1e-15)})
    plain, other = [calibrate.calibrate(p).first() for p in (panel, moved)]
    assert max(abs(plain[c] - other[c]) for c in ssvi.LATENT_COLUMNS) < 1e-11


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_forwards_do_not_depend_on_the_order_of_rows(spark, partitions):
    rows = contract_rows(7, 9)
    first = parity.forward_diagnostics(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    again = parity.forward_diagnostics(spark.createDataFrame(rows[::-1], SCHEMA).repartition(partitions))
    columns = ("expiration", "discount_factor", "forward_price")
    a, b = [sorted((tuple(r) for r in f.select(*columns).collect()), key=str) for f in (first, again)]
    assert a == b and any(r[1] for r in a)
    split = parity.split_forward_diagnostics(spark.createDataFrame(rows[::-1], SCHEMA).repartition(partitions))
    assert sorted((tuple(r) for r in split.select(*columns).collect()), key=str) == a


def test_exact_sums(spark):
    rng = np.random.default_rng(4)
    values = {"wide": [*(rng.normal(size=2000) * 10.0 ** rng.integers(-12, 12, size=2000))], "zero": [0.0, -0.0], "none": [None, None],
              "odd": [float("nan"), float("inf"), 1.5], "one": [1e300, 1e300], "small": [5e-324, 1e-310]}
    rows = [(k, None if v is None else float(v)) for k, vs in values.items() for v in vs]
    want = {"zero": 0.0, "none": None, "odd": 1.5, "one": 2e300}
    found = []
    for n in (1, 7):
        frame = spark.createDataFrame(rows if n == 1 else rows[::-1], "k string, v double").repartition(n)
        by_group = {r.k: r.t for r in exact.group_sums(frame, ["k"], {"t": F.col("v")}).collect()}
        by_window = {r.k: r.t for r in exact.window_sums(frame, {"t": F.col("v")}, Window.partitionBy("k")).collect()}
        assert by_group == by_window
        found.append(by_group)
    assert found[0] == found[1]
    assert {k: found[0][k] for k in want} == want
    assert found[0]["wide"] == pytest.approx(math.fsum(values["wide"]), rel=1e-12)


def test_initial_surface_by_hand(spark):
    panel = true_nodes(spark)
    rows = panel.collect()
    got = surface.initial_surface(panel).first()
    thetas = []
    for t in ssvi.KNOT_TAUS:
        best = min(rows, key=lambda r: (abs(r.tau - t), abs(r.m), r.expiration, r.strike))
        thetas.append(max(t * best.node_iv**2, 1e-6))
    assert np.allclose([got[c] for c in ssvi.THETA_COLUMNS], np.maximum.accumulate(thetas))
    slope = np.polyfit([r.m for r in rows], [r.node_iv for r in rows], 1)[0]
    assert got.rho == pytest.approx(np.clip(np.tanh(-8 * slope), -0.8, 0.8))


def test_spread_groups_splits_a_heavy_group(spark):
    frame = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 1).otherwise(0).alias("k"), F.col("id").alias("v"))
    spread = skew.spread_groups(frame, ("k",), ("v",), 300)
    tasks = spread.withColumn("p", F.spark_partition_id()).where("k = 0").select("p").distinct().count()
    assert tasks > 3
    ordinary = spread.withColumn("p", F.spark_partition_id()).where("k > 0").groupBy("k").agg(F.count_distinct("p").alias("n"))
    assert ordinary.agg(F.max("n")).first()[0] == 1
    assert spread.exceptAll(frame).count() == 0 and spread.count() == 4000


def brute_forward(rows):
    calls = {r["strike"]: r for r in rows if r["option_type"] == "C"}
    puts = {r["strike"]: r for r in rows if r["option_type"] == "P"}
    k = sorted(set(calls) & set(puts))
    if len(k) < 3:
        return None
    x = np.array(k)
    y = np.array([calls[s]["mid_1545"] - puts[s]["mid_1545"] for s in k])
    w = np.array([min(calls[s]["vega_1545"], puts[s]["vega_1545"]) for s in k])

    def fit(keep):
        a = np.column_stack([np.ones(keep.sum()), x[keep]]) * np.sqrt(w[keep])[:, None]
        return np.linalg.lstsq(a, y[keep] * np.sqrt(w[keep]), rcond=None)[0]

    alpha, beta = fit(np.ones(len(x), bool))
    r = y - alpha - beta * x
    mad = np.median(np.abs(r - np.median(r)))
    keep = np.abs(r) <= 5 * mad if mad > 0 else np.ones(len(x), bool)
    if keep.sum() < 3:
        return None
    alpha, beta = fit(keep)
    return -beta, alpha / -beta, len(x), int(keep.sum())


def contract_rows(seed=1, expiries=6):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(expiries):
        strikes = sorted(rng.choice(np.arange(50, 150, 5), size=2 if e == 0 else 12, replace=False).tolist())
        for s in strikes:
            for side in "CP":
                if rng.random() < 0.1 and e > 0:
                    continue
                noise = rng.normal() * (5.0 if rng.random() < 0.15 else 0.02)
                mid = max(0.98 * (100.0 - s), 0.0) + 5 + noise if side == "C" else max(0.98 * (s - 100.0), 0.0) + 5 + noise
                rows.append((date(2020, 1, 2), "R", date(2020, 3 + e, 1), float(s), side, float(mid), float(rng.uniform(0.5, 2))))
    return rows


SCHEMA = "quote_date date, root string, expiration date, strike double, option_type string, mid_1545 double, vega_1545 double"


@pytest.mark.parametrize("partitions", [1, 7])
def test_forward_terms_match_brute_force(spark, partitions):
    rows = contract_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = {r.expiration: r for r in parity.forward_diagnostics(frame).collect()}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    pruned = 0
    for expiration in {r[2] for r in rows}:
        expected = brute_forward([dict(zip(names, r)) for r in rows if r[2] == expiration])
        row = got[expiration]
        if expected is None:
            assert row.discount_factor is None and row.invalid_reason is not None
            continue
        assert row.discount_factor == pytest.approx(expected[0], rel=1e-9)
        assert row.forward_price == pytest.approx(expected[1], rel=1e-9)
        assert (row.matched_pairs_before_prune, row.matched_pairs_after_prune) == expected[2:]
        pruned += expected[2] - expected[3]
    assert pruned > 0


def test_split_route_gives_the_same_forwards(spark):
    frame = spark.createDataFrame(contract_rows(4, 9), SCHEMA)
    whole = {r.expiration: r for r in parity.forward_diagnostics(frame).collect()}
    split = {r.expiration: r for r in parity.split_forward_diagnostics(frame).collect()}
    assert whole.keys() == split.keys()
    for expiration, row in whole.items():
        other = split[expiration]
        assert row.invalid_reason == other.invalid_reason
        assert (row.matched_pairs_before_prune, row.matched_pairs_after_prune) == (
            other.matched_pairs_before_prune, other.matched_pairs_after_prune)
        assert row.forward_price is None or row.forward_price == pytest.approx(other.forward_price, rel=1e-10)


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_exact_median_of_a_heavy_group(spark, accuracy):
    rng = np.random.default_rng(2)
    groups = {
        "hot": rng.normal(size=30001), "even": np.round(rng.normal(size=4000), 1), "pair": np.array([1.0, 2.0]),
        "one": np.array([7.0]), "same": np.full(500, 3.0),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r["median"] for r in skew.exact_median(frame, ("k",), "v", accuracy=accuracy).collect()}
    assert got == {k: pytest.approx(np.median(v), abs=1e-12) for k, v in groups.items()}


def test_forward_reasons(spark):
    def chain(expiration, pairs):
        return [(date(2020, 1, 2), "R", expiration, float(k), side, mid, 1.0) for k, c, p in pairs for side, mid in (("C", c), ("P", p))]

    rows = (
        chain(date(2020, 3, 1), [(90, 12.0, 2.0), (100, 5.0, 5.0)])
        + chain(date(2020, 4, 1), [(90, 2.0, 12.0), (100, 5.0, 5.0), (110, 12.0, 2.0)])
        + chain(date(2020, 5, 1), [(90, 1.0, 101.0), (100, 1.0, 111.0), (110, 1.0, 121.0)])
        + [(date(2020, 1, 2), "R", date(2020, 6, 1), 100.0, "C", 1.0, 1.0)]
    )
    got = {r.expiration.month: r for r in parity.forward_diagnostics(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].invalid_reason == "fewer_than_3_matched_strikes" and got[3].matched_pairs_after_prune == 0
    assert got[4].invalid_reason == "non_positive_discount_factor"
    assert got[5].invalid_reason == "non_positive_forward_price"
    assert (got[6].invalid_reason, got[6].matched_pairs_before_prune) == ("fewer_than_3_matched_strikes", 0)


def test_mixed_roots_are_reported(spark):
    rows = [(date(2020, 1, 2), r, date(2020, 3, 1), float(k)) for r in ("A", "B") for k in range(30)]
    panel = spark.createDataFrame(rows, "quote_date date, root string, expiration date, strike double")
    quality = nodes.date_quality(panel)
    assert nodes.mixed_root_dates(quality).count() == 1 and not quality.first().modeling_valid
    with pytest.raises(ValueError, match="mixed"):
        nodes.require_empty(nodes.mixed_root_dates(quality), "mixed roots")


def test_hedged_error_equals_price_error(spark):
    row = ("m", "R", date(2020, 1, 2), date(2020, 1, 3), "R", date(2020, 3, 1), 100.0, "C", 5.0, 0.4, 100.0, 6.0, 101.0, 6.5)
    carried = spark.createDataFrame(
        [row],
        "model_name string, option_root string, forecast_origin date, target_date date, root string, expiration date, strike double, "
        "option_type string, mid_1545 double, delta_1545 double, active_underlying_price_1545 double, mid_1545_t1 double, "
        "active_underlying_price_1545_t1 double, predicted_price double",
    )
    buckets = spark.createDataFrame(
        [("R", date(2020, 1, 2), "atm_call_30d", "R", date(2020, 3, 1), 100.0, "C")],
        "option_root string, quote_date date, bucket string, root string, expiration date, strike double, option_type string",
    )
    got = {r.bucket: r.hedged_pnl_mae for r in score.hedged_utility(carried, buckets).collect()}
    assert got == pytest.approx({"all": 0.5, "atm_call_30d": 0.5})


def test_straddle_summaries(spark):
    rows = [("v", 30, 0.4, 0.3), ("v", 30, 0.2, 0.1), ("w", 30, 0.1, 0.1)]
    frame = spark.createDataFrame(rows, "model_name string, anchor_days int, gross_return double, net_return double")
    plain = {r.model_name: r for r in score.straddle_summary(frame).collect()}
    assert plain["v"].mean_net_return == pytest.approx(0.2) and plain["v"].hit_rate == 1.0
    assert plain["v"].sharpe_ratio == pytest.approx(1.4142, abs=1e-4)
    assert plain["w"].sharpe_ratio == pytest.approx(0.1 / 1e-12)
    yearly = {r.model_name: r for r in score.annualized_straddle(frame).collect()}
    assert yearly["v"].sharpe_ratio == pytest.approx(np.sqrt(252) * 0.2 / np.std([0.3, 0.1], ddof=1))
    assert yearly["w"].sharpe_ratio == 0.0


def raw_quotes(spark, count, roots=("SPX",)):
    """Typed quote rows without the archive round trip."""
    rows = [r for i, day in enumerate(business_days(count)) for r in day_quotes(day, i, roots)]
    names = list(rows[0])
    text = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    kinds = {f.name: f.dataType for f in quote_schema().fields}
    return text.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])


def test_build_and_experiment_on_synthetic_archives(spark, tmp_path):
    for i, day in enumerate(business_days(24)):
        rows = day_quotes(day, i, ("SPX", "SPXW"))
        if i == 6:
            rows = [r for r in rows if r["option_type"] == "C"]
        write_archive(tmp_path / "raw" / archive_name(day), rows)
    quotes = vendor.scan_archives(vendor.discover(spark, str(tmp_path / "raw"))).drop("source_file", "trade_date")
    settings = BuildSettings(history_days=4)
    build = build_panel(quotes, settings, out=str(tmp_path / "out"))
    terms = build.forward_terms.withColumn("tau", F.datediff("expiration", "quote_date") / 365.0)
    worst = terms.select(F.max(F.abs(F.col("discount_factor") - F.exp(-0.01 * F.col("tau"))))).first()[0]
    assert worst < 2e-3
    assert build.certificates.where("NOT passes_static_arb").count() == 0
    assert build.fit_diagnostics.agg(F.max("fit_rmse_iv")).first()[0] < 1e-2
    assert build.fit_diagnostics.count() == 2 * 23
    ledger = {(r.option_root, r.trading_day_index): r for r in build.stage_ledger.collect()}
    lost = ledger["SPX", 6]
    assert (lost.first_failed_stage, lost.first_failure_reason_codes) == ("forward_estimation", ["fewer_than_3_matched_strikes"])
    assert ledger["SPX", 5].first_failure_reason_codes == ["missing_target_state"]
    kept = build.feature_rows
    index = build.trading_index.select("option_root", "quote_date", "next_trading_date")
    off = kept.join(index, ["option_root", "quote_date"]).where("target_date <> next_trading_date")
    assert off.count() == 0 and kept.count() > 20

    direct = {f"h{h}": forecast.DirectHistory(("state_z_000", "state_z_011"), history_days=h, block_rows=4) for h in (2, 3)}
    families = [tuning.RidgeVar((0.0, 1.0)), tuning.Family("direct_history", direct)]
    tables = run_experiment(
        build,
        ExperimentSettings(3, 6, 4, 3, bootstrap=compare.BootstrapSettings(100, 3), models=[forecast.StateLast()], families=families),
        out=str(tmp_path / "run"),
    )
    losses = tables.loss_panel
    chosen = {(r.option_root, r.family): r.candidate_id for r in tables.chosen_candidates.collect()}
    assert len(chosen) == 2 * 3 and chosen["SPX", "state_last"] == "only"
    assert {(r.option_root, r.model_name): r.candidate_id for r in losses.collect()} == chosen
    scores = tables.candidate_scores.collect()
    assert len(scores) == 2 * 2 * 2
    for root, family in chosen:
        tried = [r for r in scores if (r.option_root, r.family) == (root, family)]
        assert not tried or min(tried, key=lambda r: (r.mean_vega_rmse_iv, r.mean_rmse_iv)).candidate_id == chosen[root, family]
    assert losses.count() == 3 * 6 * 2
    assert losses.where("model_name = 'state_last'").agg(F.max("rmse_iv")).first()[0] < 2e-2
    assert tables.certificates.count() == 36 and tables.pricing_utility.count() == 36
    assert tables.hedged_utility.where("bucket = 'all'").count() <= 36
    assert tables.diebold_mariano.count() == 3 * 2 * 2
    assert tables.confidence_set.count() == 2 * 2 * 2
    assert tables.straddle_summary.count() >= 0


def test_roots_do_not_influence_each_other(spark):
    settings = BuildSettings(history_days=2)
    both = build_panel(raw_quotes(spark, 4, ("SPX", "SPXW")), settings)
    alone = build_panel(raw_quotes(spark, 4), settings)
    columns = [c for c in alone.states.columns if c != "quote_date"]
    rounded = [F.round(c, 9).alias(c) if dict(alone.states.dtypes)[c] == "double" else F.col(c) for c in columns]
    a = both.states.where("option_root = 'SPX'").select(*rounded)
    assert a.exceptAll(alone.states.select(*rounded)).count() == 0 and a.count() == 4
