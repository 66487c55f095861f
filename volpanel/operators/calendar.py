"""Trading calendar, feature and target rows, exclusion ledger and chronological splits.

Every window is partitioned by panel (``option_root`` by default). One partition holds the trading
dates of one panel, a few thousand rows for decades of data, never the quotes behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.keys import PANEL_KEY

HISTORY_DAYS = 22


def date_order(by: tuple[str, ...] = PANEL_KEY, column: str = "quote_date", descending: bool = False):
    return Window.partitionBy(*by).orderBy(F.col(column).desc() if descending else F.col(column))


def position(window) -> Column:
    """Zero-based position."""
    return (F.row_number().over(window) - 1).cast("bigint")


def with_state_row_index(states: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """Zero-based contiguous index of the state rows of each panel."""
    return states.withColumn("state_row_index", position(date_order(by)))


def state_panel_problems(states: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """Panels with repeated or missing dates or an index that is not 0, 1, 2, … in date order."""
    checked = states.withColumn("_at", position(date_order(by)))
    return (
        checked.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("quote_date").alias("dates"),
            F.count_if(F.coalesce(F.col("_at") != F.col("state_row_index"), F.lit(True))).alias("misplaced"),
        )
        .where((F.col("rows") != F.col("dates")) | (F.col("misplaced") > 0))
    )


def trading_date_index(dates: DataFrame, states: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """Position, next trading date and state pointer of every trading date.

    ``dates`` may repeat dates (for example one row per quote); they are made distinct first.
    """
    order = date_order(by)
    calendar = dates.select(*by, "quote_date").distinct().withColumns(
        {"trading_day_index": position(order), "next_trading_date": F.lead("quote_date").over(order)}
    )
    pointers = states.select(*by, "quote_date", F.col("state_row_index").alias("surface_state_row_index"))
    return calendar.join(pointers, [*by, "quote_date"], "left").withColumn(
        "has_surface_state", F.col("surface_state_row_index").isNotNull()
    )


def labelled_candidates(
    index: DataFrame, history_days: int = HISTORY_DAYS, by: tuple[str, ...] = PANEL_KEY
) -> DataFrame:
    """Dates that have a next trading date, with the target's pointer and the exclusion reason.

    The last date of a panel has no target and is neither kept nor excluded. Because the index
    covers every trading date, the target pointer is the next row's pointer and needs no join.
    """
    order = date_order(by)
    with_target = index.withColumn(
        "target_state_row_index", F.lead("surface_state_row_index").over(order)
    ).where(F.col("next_trading_date").isNotNull())
    reason = (
        F.when(F.col("surface_state_row_index").isNull(), "missing_origin_state")
        .when(F.col("target_state_row_index").isNull(), "missing_target_state")
        .when(F.col("surface_state_row_index") < history_days - 1, "missing_history_window")
    )
    return with_target.withColumnRenamed("next_trading_date", "target_date").withColumn("exclusion_reason", reason)


def feature_rows(
    candidates: DataFrame,
    states: DataFrame,
    scalars: tuple[str, ...] = (),
    history_days: int = HISTORY_DAYS,
    by: tuple[str, ...] = PANEL_KEY,
) -> DataFrame:
    """Kept origin dates with history pointers and the scalar features of the origin state."""
    end = F.col("surface_state_row_index")
    kept = candidates.where(F.col("exclusion_reason").isNull()).select(
        *by,
        "quote_date",
        "target_date",
        (end - (history_days - 1)).alias("history_start_index"),
        end.alias("history_end_index"),
        "surface_state_row_index",
        "target_state_row_index",
    )
    if not scalars:
        return kept
    return kept.join(states.select(*by, "quote_date", *scalars), [*by, "quote_date"])


def exclusions(candidates: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    return candidates.where(F.col("exclusion_reason").isNotNull()).select(
        *by, "quote_date", "target_date", "exclusion_reason"
    )


def exclusion_counts(excluded: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    return excluded.groupBy(*by, "exclusion_reason").agg(F.count(F.lit(1)).alias("rows"))


def gather_states(
    rows: DataFrame,
    states: DataFrame,
    columns: tuple[str, ...],
    pointer: str = "surface_state_row_index",
    prefix: str = "",
    by: tuple[str, ...] = PANEL_KEY,
) -> DataFrame:
    """State columns behind a row pointer."""
    side = states.select(
        *by, F.col("state_row_index").alias(pointer), *[F.col(c).alias(prefix + c) for c in columns]
    )
    return rows.join(side, [*by, pointer])


# --- splits -----------------------------------------------------------------------------------

def label_splits(
    features: DataFrame, validation_size: int = 252, test_size: int = 504, by: tuple[str, ...] = PANEL_KEY
) -> DataFrame:
    """Last ``test_size`` targets are test, the ones before validation, the rest train."""
    from_end = position(date_order(by, "target_date", descending=True))
    label = (
        F.when(F.col("_from_end") < test_size, "test")
        .when(F.col("_from_end") < test_size + validation_size, "validation")
        .otherwise("train")
    )
    return features.withColumn("_from_end", from_end).withColumn("split_label", label).drop("_from_end")


def split_problems(
    features: DataFrame,
    validation_size: int = 252,
    test_size: int = 504,
    min_train_size: int = 756,
    by: tuple[str, ...] = PANEL_KEY,
) -> DataFrame:
    """Panels that cannot be split: too short, null or repeated targets, targets not after origins,
    or origins whose order differs from the order of their targets."""
    order = date_order(by)
    previous = F.lag("target_date").over(order)
    checked = features.withColumns(
        {
            "_bad_order": F.coalesce(previous >= F.col("target_date"), F.lit(False)),
            "_bad_row": F.coalesce(F.col("quote_date") >= F.col("target_date"), F.lit(True)),
        }
    )
    required = validation_size + test_size + min_train_size
    return (
        checked.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("_bad_order").alias("unordered_targets"),
            F.count_if("_bad_row").alias("targets_not_later"),
        )
        .withColumn("required_rows", F.lit(required).cast("bigint"))
        .where(
            (F.col("rows") < F.col("required_rows"))
            | (F.col("unordered_targets") > 0)
            | (F.col("targets_not_later") > 0)
        )
    )


# Buckets of the walk-forward pass: everything before the evaluated stage trains every chunk.
PRIOR_BUCKET = -1


def walk_forward_buckets(
    labelled: DataFrame, stage: str = "test", refit_frequency: int = 21, by: tuple[str, ...] = PANEL_KEY
) -> DataFrame:
    """Bucket -1 for rows before the stage and 0, 1, 2, … for its refit chunks.

    Chunk ``c`` trains on all rows with a smaller bucket, which are exactly the rows whose target
    lies before the chunk's first target; rows after the stage are dropped.
    """
    order = Window.partitionBy(*by, "split_label").orderBy("target_date")
    allowed = {"validation": ("train", "validation"), "test": ("train", "validation", "test")}[stage]
    chunk = F.floor((F.row_number().over(order) - 1) / F.lit(refit_frequency)).cast("int")
    bucket = F.when(F.col("split_label") == stage, chunk).otherwise(F.lit(PRIOR_BUCKET))
    return labelled.where(F.col("split_label").isin(*allowed)).withColumn("chunk_id", bucket)


def chunk_windows(bucketed: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """Per chunk: first and last target, rows, and size and last target of its training rows."""
    per_chunk = bucketed.groupBy(*by, "chunk_id").agg(
        F.min("target_date").alias("chunk_start"),
        F.max("target_date").alias("chunk_end"),
        F.count(F.lit(1)).alias("chunk_rows"),
    )
    before = Window.partitionBy(*by).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.withColumns(
        {
            "train_rows": F.coalesce(F.sum("chunk_rows").over(before), F.lit(0)),
            "train_end": F.max("chunk_end").over(before),
        }
    ).where(F.col("chunk_id") != PRIOR_BUCKET)


def chronology_violations(windows: DataFrame) -> DataFrame:
    """Chunks without training rows or whose training targets reach into the chunk."""
    fine = F.coalesce(F.col("train_end") < F.col("chunk_start"), F.lit(False))
    return windows.where(~fine | (F.col("train_rows") == 0))


def holdout_split(
    rows: DataFrame, by: tuple[str, ...] = PANEL_KEY, share: int = 10, min_rows: int = 6
) -> DataFrame:
    """Flag the last tenth (at least one row) of each group; raises for groups that are too small."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    checked = F.when(size >= min_rows, size).otherwise(
        F.raise_error(F.concat(F.lit(f"a holdout split needs {min_rows} rows, found "), size.cast("string"))).cast("bigint")
    )
    held = F.greatest(F.lit(1), F.floor(F.col("_size") / share))
    return (
        rows.withColumns({"_size": checked, "_from_end": position(date_order(by, descending=True))})
        .withColumn("is_holdout", F.col("_from_end") < held)
        .drop("_size", "_from_end")
    )


def forecast_window_summary(
    index: DataFrame, states: DataFrame, features: DataFrame, excluded: DataFrame, by: tuple[str, ...] = PANEL_KEY
) -> DataFrame:
    """First date, last date and rows of the calendar, state, origin and target windows, and exclusions."""
    def window(frame: DataFrame, name: str, column: str) -> DataFrame:
        return frame.groupBy(*by).agg(
            F.min(column).alias("start_date"), F.max(column).alias("end_date"), F.count(F.lit(1)).alias("row_count")
        ).withColumn("window_name", F.lit(name))

    parts = [
        window(index, "raw_trading_days", "quote_date"),
        window(index.where(F.col("next_trading_date").isNotNull()), "feature_candidates", "quote_date"),
        window(states, "surface_states", "quote_date"),
        window(features, "feature_origins", "quote_date"),
        window(features, "feature_targets", "target_date"),
        window(excluded, "feature_exclusions", "quote_date"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
