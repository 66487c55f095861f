"""First-failed-stage ledger per trading date and its yearly coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.keys import PANEL_KEY

DIAGNOSTIC_COUNTS = (
    "subset_rows",
    "clean_contract_rows",
    "forward_term_rows",
    "forward_total_expiries",
    "forward_valid_expiries",
    "forward_invalid_expiries",
)
NO_REASONS = "array<string>"


def reasons(*codes: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in codes]))


def stage_ledger(
    index: DataFrame,
    diagnostics: DataFrame,
    features: DataFrame,
    excluded: DataFrame,
    min_nodes: int = 40,
    min_expiries: int = 4,
    by: tuple[str, ...] = PANEL_KEY,
) -> DataFrame:
    """One row per trading date with the first stage that lost it and why.

    ``diagnostics`` holds the daily counts of the build; missing dates count as zero. A date that
    is both kept and excluded, or a candidate that is neither, is an error raised by the plan.
    """
    key = [*by, "quote_date"]
    kept = features.select(*key, F.lit(True).alias("_kept"))
    reason = excluded.select(*key, F.col("exclusion_reason").alias("feature_exclusion_reason"))
    side = diagnostics.withColumnRenamed("has_surface_state", "_built") if (
        "has_surface_state" in diagnostics.columns
    ) else diagnostics.withColumn("_built", F.lit(None).cast("boolean"))
    rows = (
        index.join(side, key, "left")
        .join(reason, key, "left")
        .join(kept, key, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in DIAGNOSTIC_COUNTS})
        .withColumns(
            {
                "target_date": F.col("next_trading_date"),
                "has_next_trading_date": F.col("next_trading_date").isNotNull(),
                "feature_row_kept": F.coalesce("_kept", F.lit(False)),
                "modeling_valid": F.coalesce("modeling_valid", F.lit(False)),
                "_built": F.coalesce("_built", "has_surface_state"),
                "forward_invalid_reason_codes": F.coalesce(
                    "forward_invalid_reason_codes", F.array().cast(NO_REASONS)
                ),
            }
        )
    )
    stage = (
        F.when(F.col("clean_contract_rows") <= 0, "cleaning")
        .when(F.col("forward_valid_expiries") <= 0, "forward_estimation")
        .when(~F.col("modeling_valid"), "node_construction")
        .when(~F.col("_built"), "ssvi_calibration")
        .when(F.col("feature_exclusion_reason").isNotNull(), "feature_target_formation")
    )
    node_reasons = reasons(
        (F.col("surface_node_count") < min_nodes, "below_min_surface_nodes"),
        (F.col("valid_expiry_count") < min_expiries, "below_min_valid_expiries"),
        (F.col("root_count") != 1, "mixed_option_roots"),
    )
    forward_reasons = F.col("forward_invalid_reason_codes")

    def fixed(code: str | Column) -> Column:
        return F.array(F.lit(code) if isinstance(code, str) else code)

    codes = (
        F.when(F.col("first_failed_stage") == "cleaning", fixed("cleaning_eliminated_all_contracts"))
        .when(
            F.col("first_failed_stage") == "forward_estimation",
            F.when(F.size(forward_reasons) > 0, forward_reasons).otherwise(fixed("no_forward_terms_after_parity")),
        )
        .when(
            F.col("first_failed_stage") == "node_construction",
            F.when(F.size(node_reasons) > 0, node_reasons).otherwise(fixed("node_panel_not_modeling_valid")),
        )
        .when(F.col("first_failed_stage") == "ssvi_calibration", fixed("missing_ssvi_state"))
        .when(F.col("first_failed_stage") == "feature_target_formation", fixed(F.col("feature_exclusion_reason")))
        .otherwise(F.array().cast(NO_REASONS))
    )
    both = F.col("feature_row_kept") & F.col("feature_exclusion_reason").isNotNull()
    neither = F.col("has_next_trading_date") & F.col("first_failed_stage").isNull() & ~F.col("feature_row_kept")
    checked_kept = (
        F.when(both, F.raise_error(F.concat(F.lit("kept and excluded: "), F.col("quote_date").cast("string"))).cast("boolean"))
        .when(neither, F.raise_error(F.concat(F.lit("neither kept nor excluded: "), F.col("quote_date").cast("string"))).cast("boolean"))
        .otherwise(F.col("feature_row_kept"))
    )
    return (
        rows.withColumn("first_failed_stage", stage)
        .withColumn("first_failure_reason_codes", codes)
        .withColumn("feature_row_kept", checked_kept)
        .select(
            "quote_date", "target_date", *by, "trading_day_index", "has_next_trading_date",
            *DIAGNOSTIC_COUNTS, "forward_invalid_reason_codes", "surface_node_count", "valid_expiry_count",
            "root_count", "modeling_valid", "has_surface_state", "feature_exclusion_reason",
            "feature_row_kept", "first_failed_stage", "first_failure_reason_codes",
        )
    )


def coverage_by_year(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ten conditional day counts and the invalid-expiry total per year."""
    return ledger.groupBy(*by, F.year("quote_date").alias("year")).agg(
        F.count(F.lit(1)).alias("raw_trading_days"),
        F.count_if(F.col("clean_contract_rows") > 0).alias("days_after_cleaning"),
        F.count_if(F.col("forward_term_rows") > 0).alias("days_with_forward_terms"),
        F.count("surface_node_count").alias("days_with_node_quality"),
        F.count_if("modeling_valid").alias("modeling_valid_days"),
        F.count_if("has_surface_state").alias("ssvi_state_days"),
        F.count_if("has_next_trading_date").alias("feature_candidate_days"),
        F.count_if("feature_row_kept").alias("feature_rows"),
        F.count_if(~F.col("has_next_trading_date")).alias("terminal_days"),
        F.sum("forward_invalid_expiries").alias("forward_invalid_expiry_count"),
    )


def failure_counts_by_year(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Days per year and failed stage, and per year and failure reason, as long rows."""
    year = F.year("quote_date").alias("year")
    stages = ledger.where(F.col("first_failed_stage").isNotNull()).select(
        *by, year, F.lit("stage").alias("kind"), F.col("first_failed_stage").alias("code")
    )
    codes = ledger.select(*by, year, F.lit("reason").alias("kind"), F.explode("first_failure_reason_codes").alias("code"))
    return stages.unionByName(codes).groupBy(*by, "year", "kind", "code").agg(F.count(F.lit(1)).alias("days"))


def coverage_with_counts(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Yearly coverage with the two count maps attached; a map holds one entry per code."""
    def as_map(kind: str, out: str) -> DataFrame:
        rows = failure_counts_by_year(ledger, by).where(F.col("kind") == kind)
        entries = F.array_sort(F.collect_list(F.struct("code", "days")))
        return rows.groupBy(*by, "year").agg(F.map_from_entries(entries).alias(out))

    empty = F.expr("map()").cast("map<string,bigint>")
    result = coverage_by_year(ledger, by)
    for kind, out in (("stage", "first_failed_stage_counts"), ("reason", "first_failure_reason_counts")):
        result = result.join(as_map(kind, out), [*by, "year"], "left").withColumn(out, F.coalesce(out, empty))
    return result
