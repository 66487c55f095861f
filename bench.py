"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and executed in full (no-op sink), once to warm up and once timed; the time
includes checkpoints that the query writes on the way.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "forward_terms",
    "surface_nodes",
    "quality_filter",
    "duplicate_policy",
    "clean_diagnostics",
    "null_rates",
    "root_row_counts",
    "settlement_year_fraction",
    "feature_rows",
    "stage_ledger",
    "walk_forward_chunks",
    "normalization_stats",
    "certification",
    "initial_surface",
    "lattice_calibration",
    "refined_calibration",
    "loss_panel",
    "pricing_utility",
    "hedged_utility",
    "straddle_returns",
    "var_forecasts",
    "direct_forecasts",
    "walk_forward_validation",
    "diebold_mariano",
    "bootstrap_means",
    "model_confidence_set",
    "stream_nodes",
)


def session():
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("volpanel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    from volpanel.plans import catalog

    times: dict[str, float] = {}
    for name in wanted:
        if name not in catalog.QUERIES:
            continue
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
