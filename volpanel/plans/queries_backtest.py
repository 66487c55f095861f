"""Registered queries: the whole build and backtest over the monthly chain."""

from __future__ import annotations

from volpanel.operators import compare, forecast, tuning
from volpanel.plans.adapters import chain
from volpanel.plans.build import BuildSettings, ExperimentSettings, build_panel, run_experiment
from volpanel.plans.registry import register
from volpanel.plans.shape import joined, rounded

BUILD = BuildSettings(min_nodes=20, min_expiries=4, history_days=6)
HISTORY = 4


def experiment(spark, sf_dir):
    build = build_panel(chain(spark, sf_dir, "month"), BUILD, prepared=True)
    columns = ("log_total_trade_volume", "median_rel_spread_1545", "surface_fit_rmse_iv")
    latent = forecast.LATENT_COLUMNS
    direct = {f"history={h}": forecast.DirectHistory((*latent[-3:], *columns), latent, h, block_rows=8) for h in (2, HISTORY)}
    families = [tuning.single(forecast.StateLast()), tuning.RidgeVar(), tuning.Family("direct_history", direct)]
    settings = ExperimentSettings(
        validation_size=6, test_size=12, min_train_size=6, refit_frequency=4,
        bootstrap=compare.BootstrapSettings(draws=500, block_length=4), families=families,
    )
    return build, run_experiment(build, settings)


@register("backtest_losses", "FCT5 FCT6 SRF7 SRF8 FCT1 FCT2 FCT3")
def backtest_losses(spark, sf_dir):
    _, tables = experiment(spark, sf_dir)
    losses = tables.loss_panel
    return rounded(losses, 5, "rmse_iv", "mae_iv", "mape_iv_clipped", "vega_rmse_iv")


@register("backtest_confidence_set", "FCT6 STA7")
def backtest_confidence_set(spark, sf_dir):
    _, tables = experiment(spark, sf_dir)
    chosen = tables.confidence_set
    return chosen.select(
        "option_root", "metric", "method", joined("included_models").alias("included"), joined("excluded_models").alias("excluded")
    )
