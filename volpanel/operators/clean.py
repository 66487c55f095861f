"""Contract filters, derived quote columns and the duplicate policy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.keys import CONTRACT_KEY

SECONDS_PER_DAY = 86400
SECONDS_PER_YEAR = 365.0 * SECONDS_PER_DAY


@dataclass(frozen=True)
class CleanRules:
    """Thresholds and clock settings of the contract filter (clock values in seconds after midnight)."""

    min_dte_days: int = 10
    max_dte_days: int = 730
    snapshot_seconds: int = 56700
    early_snapshot_seconds: int = 45900
    settlement_seconds: int = 34200
    mid_floor: float = 1e-6


def study_filter(df: DataFrame, underlying: str | None = None, root: str | None = None) -> DataFrame:
    """Keep one underlying and root; both predicates reach the Parquet scan."""
    if underlying is not None:
        df = df.where(F.col("underlying_symbol") == underlying)
    if root is not None:
        df = df.where(F.col("root") == root)
    return df


def dte_days() -> Column:
    return F.datediff(F.col("expiration"), F.col("quote_date"))


def quality_predicates(rules: CleanRules = CleanRules()) -> list[tuple[str, Column]]:
    """Named predicates in the order they are reported; a null never passes."""
    return [
        ("option_type", F.col("option_type").isin("C", "P")),
        ("strike", F.col("strike") > 0),
        ("expired", F.col("quote_date") < F.col("expiration")),
        ("min_dte", dte_days() >= rules.min_dte_days),
        ("max_dte", dte_days() <= rules.max_dte_days),
        ("bid", F.col("bid_1545") > 0),
        ("ask", F.col("ask_1545") > 0),
        ("crossed", F.col("ask_1545") >= F.col("bid_1545")),
        ("implied_volatility", F.col("implied_volatility_1545") > 0),
        ("vega", F.col("vega_1545") > 0),
        ("underlying_price", F.col("active_underlying_price_1545") > 0),
    ]


def quality_filter(df: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """All predicates as one conjunction."""
    return df.where(reduce(lambda a, b: a & b, [p for _, p in quality_predicates(rules)]))


def reject_counts(df: DataFrame, by: tuple[str, ...] = ("root",), rules: CleanRules = CleanRules()) -> DataFrame:
    """Rows per first failing predicate (``passed`` for the survivors), one aggregation pass."""
    first = F.coalesce(
        *[F.when(~F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in quality_predicates(rules)],
        F.lit("passed"),
    )
    return df.groupBy(*by, first.alias("first_failed")).agg(F.count(F.lit(1)).alias("rows"))


def with_quote_columns(df: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Days to expiry, mid, spread and relative spread."""
    mid = 0.5 * (F.col("bid_1545") + F.col("ask_1545"))
    return df.withColumns(
        {"dte_days": dte_days(), "mid_1545": mid, "spread_1545": F.col("ask_1545") - F.col("bid_1545")}
    ).withColumn(
        "rel_spread_1545", F.col("spread_1545") / F.greatest(F.col("mid_1545"), F.lit(rules.mid_floor))
    )


def year_fraction(early_close: Column, rules: CleanRules = CleanRules()) -> Column:
    """ACT/365 wall-clock time from the snapshot to the morning settlement; raises when not positive.

    Both clocks are local wall clocks, so daylight-saving shifts never enter.
    """
    snapshot = F.when(early_close, rules.early_snapshot_seconds).otherwise(rules.snapshot_seconds)
    seconds = dte_days() * SECONDS_PER_DAY + rules.settlement_seconds - snapshot
    return F.when(seconds > 0, seconds / SECONDS_PER_YEAR).otherwise(
        F.raise_error(
            F.concat(
                F.lit("settlement does not follow the snapshot: "),
                F.col("quote_date").cast("string"), F.lit(" -> "), F.col("expiration").cast("string"),
            )
        ).cast("double")
    )


@dataclass(frozen=True)
class Deduplicated:
    """Distinct rows with their copy counts, and the keys whose rows disagree."""

    rows: DataFrame
    conflicts: DataFrame

    def require_no_conflicts(self) -> "Deduplicated":
        shown = [tuple(r) for r in self.conflicts.take(5)]
        if shown:
            raise ValueError(f"Conflicting duplicate contracts for keys: {shown}")
        return self


def deduplicate(df: DataFrame, key: tuple[str, ...] = CONTRACT_KEY, copies: str = "copies") -> Deduplicated:
    """Collapse exact copies and list conflicting keys.

    Grouping on every column combines copies before the shuffle, so a group of copies of any size
    leaves each task as one row. The conflict report groups those rows by key with a plain count.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))
    return Deduplicated(rows, conflicting_keys(rows, key, copies))


def conflicting_keys(rows: DataFrame, key: tuple[str, ...] = CONTRACT_KEY, copies: str = "copies") -> DataFrame:
    """Keys that still have several different rows after exact copies were collapsed."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("variants"), F.sum(copies).alias("rows"))
    return counted.where(F.col("variants") > 1)


def mixed_date_files(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Files that hold more than one quote date. Min and max decide, so no distinct set is built."""
    return (
        df.groupBy(file_col)
        .agg(F.min("quote_date").alias("first_date"), F.max("quote_date").alias("last_date"))
        .where(F.col("first_date") < F.col("last_date"))
    )


def clean_contracts(
    df: DataFrame,
    early_closes: list | None = None,
    rules: CleanRules = CleanRules(),
    underlying: str | None = None,
    root: str | None = None,
    key: tuple[str, ...] = CONTRACT_KEY,
) -> Deduplicated:
    """Filter, deduplicate and enrich the quotes of every date in one plan; derived columns stay out of the shuffle."""
    distinct = deduplicate(quality_filter(study_filter(df, underlying, root), rules), key).rows
    enriched = with_contract_columns(distinct, early_closes, rules)
    rows = enriched.select(*[c for c in enriched.columns if c != "copies"], "copies")
    return Deduplicated(rows, conflicting_keys(rows, key))


def with_contract_columns(df: DataFrame, early_closes: list | None = None, rules: CleanRules = CleanRules()) -> DataFrame:
    """Quote columns, option root, early close and time to settlement: what cleaning adds to a row."""
    from volpanel.sources.early_close import is_early_close

    enriched = with_quote_columns(df, rules).withColumns(
        {"option_root": F.col("root"), "is_early_close": is_early_close("quote_date", early_closes)}
    )
    return enriched.withColumn("tau", year_fraction(F.col("is_early_close"), rules))


def clean_diagnostics(result: Deduplicated, by: tuple[str, ...] = (), copies: str = "copies") -> DataFrame:
    """Rows and dates after cleaning and the number of exact copies removed."""
    per_date = result.rows.groupBy(*by, "quote_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(copies) - 1).alias("removed")
    )
    return per_date.groupBy(*by).agg(
        F.sum("n").alias("rows_after_cleaning"),
        F.count(F.lit(1)).alias("dates_after_cleaning"),
        F.sum("removed").alias("exact_duplicates_removed"),
    )
