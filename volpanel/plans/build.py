"""From raw quotes to the modelled panel: every stage for all dates and roots, written once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions import ssvi
from volpanel.operators import calendar, calibrate, clean, features, ledger, nodes, parity, score, surface
from volpanel.operators.keys import STATE_KEY
from volpanel.session import cut_lineage

PANEL_DATE = ("quote_date", "root")


@dataclass(frozen=True)
class BuildSettings:
    """Thresholds of the build; the defaults are the study's published ones."""

    rules: clean.CleanRules = clean.CleanRules()
    min_pairs: int = parity.MIN_PAIRS
    mad_multiple: float = parity.MAD_MULTIPLE
    min_nodes: int = nodes.MIN_NODES
    min_expiries: int = nodes.MIN_EXPIRIES
    history_days: int = calendar.HISTORY_DAYS
    lattice: calibrate.Lattice = calibrate.Lattice()
    tolerance: float = surface.TOLERANCE


class Stages:
    """Keeps each stage as a table below ``out``, or as a reliable checkpoint when no path is given."""

    def __init__(self, out: str | None = None):
        self.out, self.tables, self.history_days = out, {}, calendar.HISTORY_DAYS

    def keep(self, name: str, df: DataFrame, leaf: bool = False) -> DataFrame:
        """Stage a table; a leaf that no later stage reads stays lazy unless it is to be written."""
        if self.out is None:
            kept = df if leaf else cut_lineage(df)
        else:
            path = f"{self.out.rstrip('/')}/{name}"
            df.write.mode("overwrite").parquet(path)
            kept = df.sparkSession.read.schema(df.schema).parquet(path)
        self.tables[name] = kept
        return kept

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def build_panel(
    quotes: DataFrame,
    settings: BuildSettings = BuildSettings(),
    out: str | None = None,
    early_closes: list | None = None,
    prepared: bool = False,
) -> Stages:
    """Build all stage tables.

    ``quotes`` are raw quote rows of any number of underlyings' roots; with ``prepared`` they are
    already clean contracts. Every failing date stays visible in the stage ledger. A fitted surface
    that breaks static arbitrage is an error raised by the plan.
    """
    stages = Stages(out)
    stages.history_days = settings.history_days
    if prepared:
        contracts = stages.keep("contracts", quotes)
        raw_dates = contracts
    else:
        cleaned = clean.clean_contracts(quotes, early_closes, settings.rules)
        # Write first, then look for conflicts in the written rows: the raw quotes are read once.
        distinct = stages.keep("contracts", cleaned.rows)
        clean.Deduplicated(distinct, clean.conflicting_keys(distinct)).require_no_conflicts()
        contracts = distinct.drop("copies")
        raw_dates = quotes.withColumn("option_root", F.col("root"))
    raw_counts = stages.keep(
        "raw_counts", raw_dates.groupBy("option_root", "quote_date").agg(F.count(F.lit(1)).alias("subset_rows"))
    )

    # One pass over the contracts; forwards, diagnostics and nodes all come from its strikes.
    strikes = stages.keep(
        "strikes",
        parity.with_forward(
            nodes.strike_table(contracts), min_pairs=settings.min_pairs, multiple=settings.mad_multiple
        ),
    )
    diagnostics = stages.keep("forward_diagnostics", parity.diagnostics_of(strikes))
    terms = parity.forward_terms(diagnostics)
    stages.tables["forward_terms"] = terms
    all_nodes = nodes.nodes_of(strikes)
    quality = stages.keep(
        "date_quality", nodes.date_quality(all_nodes, settings.min_nodes, settings.min_expiries, PANEL_DATE)
    )
    panel = stages.keep("nodes", nodes.valid_nodes(all_nodes, quality, PANEL_DATE))

    calibrated = stages.keep("calibration", calibrate.calibrate(panel, lattice=settings.lattice))
    fitted = stages.tables["fitted"] = calibrated.select(*STATE_KEY, *ssvi.PARAMETER_COLUMNS, *ssvi.LATENT_COLUMNS)
    certificates = surface.require_certified(surface.certify(fitted, tolerance=settings.tolerance))
    stages.keep("certificates", certificates)
    fit = stages.keep("fit_diagnostics", score.fit_diagnostics(calibrate.fitted_nodes(panel, fitted)))

    quality_of_fit = fit.select(
        *STATE_KEY,
        F.col("fit_rmse_iv").alias("surface_fit_rmse_iv"),
        F.col("fit_vega_rmse_iv").alias("surface_fit_vega_rmse_iv"),
    )
    state_panel = fitted.join(nodes.state_summary(panel), list(STATE_KEY)).join(quality_of_fit, list(STATE_KEY))
    states = features.with_scalar_features(calendar.with_state_row_index(state_panel))
    states = stages.keep("states", states)

    index = stages.keep("trading_index", calendar.trading_date_index(raw_counts, states))
    candidates = calendar.labelled_candidates(index, settings.history_days)
    candidates = stages.keep("candidates", candidates)
    kept = stages.keep(
        "feature_rows", calendar.feature_rows(candidates, states, features.SCALAR_COLUMNS, settings.history_days)
    )
    excluded = calendar.exclusions(candidates)
    stages.tables["exclusions"] = excluded

    daily = daily_diagnostics(raw_counts, contracts, diagnostics, quality)
    stages.keep("stage_ledger", ledger.stage_ledger(index, daily, kept, excluded, settings.min_nodes, settings.min_expiries), leaf=True)
    return stages


def daily_diagnostics(raw_counts: DataFrame, contracts: DataFrame, diagnostics: DataFrame, quality: DataFrame) -> DataFrame:
    """Counts of every build stage per (root, date), outer to the raw dates."""
    key = ["option_root", "quote_date"]
    clean_counts = contracts.groupBy(*key).agg(F.count(F.lit(1)).alias("clean_contract_rows"))
    forward = parity.forward_rollup(diagnostics, ("quote_date", "root")).withColumnRenamed("root", "option_root")
    forward = forward.withColumn("forward_term_rows", F.col("forward_valid_expiries"))
    return (
        raw_counts.join(clean_counts, key, "left")
        .join(forward, key, "left")
        .join(quality.withColumnRenamed("root", "option_root"), key, "left")
    )


@dataclass
class ExperimentSettings:
    validation_size: int = 252
    test_size: int = 504
    min_train_size: int = 756
    refit_frequency: int = 21
    alpha: float = 0.10
    bandwidth: int = 5
    bootstrap: object = None
    #: Plain models, each forecasting as it is.
    models: list = field(default_factory=list)
    #: Families whose candidates compete on the validation window first.
    families: list = field(default_factory=list)


def default_families(history_days: int) -> list:
    """Persistence, autoregressions of several penalties, and history regressions of two lengths."""
    from volpanel.operators import forecast, tuning

    lengths = sorted({max(1, history_days // 2), history_days})
    direct = {f"history={h}": forecast.DirectHistory(features.HISTORY_COLUMNS, history_days=h) for h in lengths}
    return [tuning.single(forecast.StateLast()), tuning.RidgeVar(), tuning.Family("direct_history", direct)]


def chosen_candidates(families: list, labelled: DataFrame, states: DataFrame, panel: DataFrame, refit_frequency: int, stages: Stages) -> DataFrame:
    """(option_root, family, candidate_id): per panel the candidate with the best scores on the validation nodes.

    All candidates of all families are fitted and scored in one job.
    """
    from volpanel.operators import tuning

    only = tuning.only_candidates(families, labelled)
    if all(len(f.candidate_ids()) == 1 for f in families):
        return stages.keep("chosen_candidates", only)
    validation = calendar.walk_forward_buckets(labelled, "validation", refit_frequency)
    nodes.require_empty(
        calendar.chronology_violations(calendar.chunk_windows(validation)), "training rows reach into their validation chunk"
    )
    tried = score.forecast_states(tuning.candidate_panel(families, validation, states).drop("chunk_id"))
    tried = stages.keep("candidate_forecasts", tried)
    losses = score.node_losses(score.node_forecasts(tried, panel)).withColumns(tuning.split_name())
    checks = score.forecast_certificates(tried).withColumns(tuning.split_name())
    ranked = score.rank_candidates(losses, checks, by=("option_root", "family"))
    ranked = stages.keep("candidate_scores", ranked)
    best = ranked.where("is_best").select("option_root", "family", "candidate_id")
    return stages.keep("chosen_candidates", best.unionByName(only))


def run_experiment(build: Stages, settings: ExperimentSettings, out: str | None = None) -> Stages:
    """Test-window backtest of all families on common dates with every score and comparison table.

    Families with several candidates are tuned per panel on the validation window; ``loss_panel`` names the candidate.
    """
    from volpanel.operators import compare, tuning

    stages = Stages(out)
    states, contracts, panel = build.states, build.contracts, build.nodes
    kept = build.feature_rows
    problems = calendar.split_problems(kept, settings.validation_size, settings.test_size, settings.min_train_size)
    nodes.require_empty(problems, "panels that cannot be split")
    labelled = calendar.label_splits(kept, settings.validation_size, settings.test_size)
    bucketed = stages.keep("labelled", calendar.walk_forward_buckets(labelled, "test", settings.refit_frequency))
    nodes.require_empty(
        calendar.chronology_violations(calendar.chunk_windows(bucketed)), "training rows reach into their chunk"
    )

    families = [*map(tuning.single, settings.models), *settings.families] or default_families(build.history_days)
    chosen = chosen_candidates(families, labelled, states, panel, settings.refit_frequency, stages)
    raw = tuning.winner_panel(families, chosen, bucketed, states).drop("chunk_id", "candidate_id")
    forecasts = stages.keep("forecasts", score.forecast_states(raw))

    priced_source = nodes.contracts_with_forward(contracts, build.forward_terms)
    priced_source = stages.keep("contracts_with_forward", priced_source)
    predicted = stages.keep("node_forecasts", score.node_forecasts(forecasts, panel), leaf=True)
    told = chosen.withColumnRenamed("family", "model_name")
    losses = stages.keep("loss_panel", score.node_losses(predicted).join(told, ["option_root", "model_name"]))
    stages.keep("certificates", score.forecast_certificates(forecasts), leaf=True)
    priced = stages.keep("contract_forecasts", score.contract_forecasts(forecasts, priced_source), leaf=True)
    stages.keep("pricing_utility", score.pricing_utility(priced), leaf=True)

    carried = score.carried_contracts(priced_source, priced)
    stages.keep("hedged_utility", score.hedged_utility(carried, score.hedge_buckets(priced_source)), leaf=True)
    steps = kept.select("option_root", "quote_date", "target_date")
    straddles = score.carried_straddles(score.straddle_pairs(priced_source), priced_source, steps)
    stages.keep("straddle_returns", score.straddle_returns(straddles, states, forecasts), leaf=True)

    by = ("option_root", "metric")
    series = stages.keep("loss_series", compare.loss_series(losses, by=("option_root",)))
    compare.require_comparable(series, by=by)
    stages.keep("diebold_mariano", compare.diebold_mariano(series, settings.bandwidth, by=by), leaf=True)
    bootstrap = settings.bootstrap or compare.BootstrapSettings()
    mcs = compare.confidence_set_steps(series, settings.alpha, bootstrap, by)
    stages.keep("confidence_set_steps", mcs, leaf=True)
    stages.keep("confidence_set", compare.confidence_set(mcs, series, by), leaf=True)
    stages.tables["loss_summary"] = score.summary_table(losses, ("vega_rmse_iv", "rmse_iv", "mae_iv"))
    stages.tables["straddle_summary"] = score.straddle_summary(stages.straddle_returns)
    return stages
