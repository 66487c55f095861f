"""Implied forwards per expiry from put-call parity, with outlier pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from volpanel.functions import exact
from volpanel.functions.mathx import is_finite
from volpanel.operators.keys import EXPIRY_KEY
from volpanel.operators.skew import exact_median
from volpanel.session import cut_lineage

MIN_PAIRS = 3
MAD_MULTIPLE = 5.0
#: Weighted squared spread, relative to the squared mean, below which all x are equal.
SAME_X = 1e-28


def strike_pairs(df: DataFrame, key: tuple[str, ...] = EXPIRY_KEY, strike: str = "strike") -> DataFrame:
    """One row per strike with both legs side by side; unmatched strikes keep a null leg.

    A conditional aggregation replaces the self-join: one shuffle on (key, strike), combined
    before the exchange, so a hot expiry is spread over its strikes.
    """
    return df.groupBy(*key, strike).agg(*leg_columns())


def leg_columns() -> list[Column]:
    """Aggregates that put the call and the put of a strike side by side."""
    def leg(side: str, value: str) -> Column:
        return F.max(F.when(F.col("option_type") == side, F.col(value)))

    return [
        leg("C", "mid_1545").alias("call_mid"),
        leg("P", "mid_1545").alias("put_mid"),
        leg("C", "vega_1545").alias("call_vega"),
        leg("P", "vega_1545").alias("put_vega"),
    ]


def matched_only(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("call_mid").isNotNull() & F.col("put_mid").isNotNull())


def weighted_sums(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """What the weighted means of a straight-line fit need."""
    return {"s": w, "sx": w * x, "sy": w * y}


def co_moments(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Weighted products of deviations from the means ``mx`` and ``my``."""
    dx, dy = x - F.col("mx"), y - F.col("my")
    return {"cxx": w * dx * dx, "cxy": w * dx * dy}


def with_means(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"mx": F.try_divide("sx", "s"), "my": F.try_divide("sy", "s")})


def line_from_moments() -> tuple[Column, Column]:
    """Intercept and slope from means and co-moments; null where the system is singular.

    A spread within the rounding of the mean is none: deviations from it are not exactly zero where all x are equal.
    """
    spread = F.col("cxx") > F.lit(SAME_X) * F.col("s") * F.col("mx") * F.col("mx")
    slope = F.when(spread, F.try_divide("cxy", "cxx"))
    return F.col("my") - slope * F.col("mx"), slope


MOMENTS = ("s", "sx", "sy", "mx", "my", "cxx", "cxy")


def window_line(rows: DataFrame, x: Column, y: Column, w: Column, group: WindowSpec) -> DataFrame:
    """``rows`` with means and co-moments of their group. The sums don't depend on the order of rows."""
    rows = with_means(exact.window_sums(rows, weighted_sums(x, y, w), group))
    return exact.window_sums(rows, co_moments(x, y, w), group)


def group_line(rows: DataFrame, key: list[str], x: str, y: str, w: str) -> DataFrame:
    """One row per group with its means and co-moments, for groups of any size."""
    columns = (F.col(x), F.col(y), F.col(w))
    means = with_means(exact.group_sums(rows, key, weighted_sums(*columns)))
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_m.{k}")) for k in key]
    met = rows.alias("_r").join(means.alias("_m"), same).select("_r.*", "_m.mx", "_m.my")
    moments = exact.group_sums(met, key, co_moments(*columns))
    same = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in key]
    return means.alias("_a").join(moments.alias("_b"), same).select("_a.*", "_b.cxx", "_b.cxy")


def weighted_line_fit(df: DataFrame, key: tuple[str, ...], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares y = intercept + slope * x per group, as one aggregation of plain sums.

    Where the order of rows must not show, or x lies far from zero, ``group_line`` is the way.
    """
    weight, weighted = F.col(w), F.col(w) * F.col(x)
    sums = df.groupBy(*key).agg(
        F.sum(weight).alias("s"),
        F.sum(weighted).alias("sx"),
        F.sum(weight * F.col(y)).alias("sy"),
        F.sum(weighted * F.col(x)).alias("sxx"),
        F.sum(weighted * F.col(y)).alias("sxy"),
        F.count(F.lit(1)).alias("n"),
    )
    s, sx, sy, sxx, sxy = [F.col(c) for c in ("s", "sx", "sy", "sxx", "sxy")]
    determinant = s * sxx - sx * sx
    return sums.select(
        *key,
        "n",
        F.try_divide(sxx * sy - sx * sxy, determinant).alias("intercept"),
        F.try_divide(s * sxy - sx * sy, determinant).alias("slope"),
    )


def pruned_pairs(pairs: DataFrame, key: tuple[str, ...] = EXPIRY_KEY, multiple: float = MAD_MULTIPLE) -> DataFrame:
    """Fit every expiry, take residuals and flag the strikes that survive the MAD rule.

    Rows per partition of the window are the distinct strikes of one expiry, already collapsed by
    ``strike_pairs``; the fit and both medians share one exchange.
    """
    group = Window.partitionBy(*key)
    # Null propagates: an unmatched strike has no y and no weight.
    staged = pairs.withColumns(
        {
            "y": F.col("call_mid") - F.col("put_mid"),
            "w": F.when(
                F.col("call_vega").isNotNull() & F.col("put_vega").isNotNull(),
                F.least("call_vega", "put_vega"),
            ),
        }
    ).withColumn("is_matched", F.col("y").isNotNull())
    x = F.when(F.col("is_matched"), F.col("strike"))
    w = F.when(F.col("is_matched"), F.col("w"))
    staged = window_line(staged, x, F.col("y"), w, group)
    intercept, slope = line_from_moments()
    staged = staged.withColumns(
        {
            "matched_pairs_before_prune": F.count("y").over(group),
            "first_intercept": intercept,
            "first_slope": slope,
        }
    ).withColumn("residual", F.col("y") - (F.col("first_intercept") + F.col("first_slope") * F.col("strike")))
    staged = staged.withColumn("deviation", F.abs(F.col("residual") - F.median("residual").over(group)))
    staged = staged.withColumn("mad", F.median("deviation").over(group))
    keep = F.col("is_matched") & (
        (F.col("mad") <= 0) | F.col("mad").isNull() | (F.abs(F.col("residual")) <= multiple * F.col("mad"))
    )
    return staged.withColumn("is_kept", F.coalesce(keep, F.lit(False))).drop(*MOMENTS, "deviation")


def with_forward(
    pairs: DataFrame,
    key: tuple[str, ...] = EXPIRY_KEY,
    min_pairs: int = MIN_PAIRS,
    multiple: float = MAD_MULTIPLE,
) -> DataFrame:
    """Strike rows with the outcome of their expiry: pair counts, discount factor, forward and reason.

    The refit runs over the window that already holds the first fit, so a strike table becomes
    forwards, diagnostics or nodes with a single exchange and without joining anything back.
    """
    group = Window.partitionBy(*key)
    pruned = pruned_pairs(pairs, key, multiple)
    x, y, w = [F.when(F.col("is_kept"), F.col(c)) for c in ("strike", "y", "w")]
    staged = pruned.withColumn("kept_pairs", F.count(F.when(F.col("is_kept"), 1)).over(group))
    staged = window_line(staged, x, y, w, group)
    added = (
        "discount_factor", "forward_price", "matched_pairs_before_prune", "matched_pairs_after_prune", "invalid_reason",
    )
    return judged(staged, min_pairs).select(*pairs.columns, *added)


def judged(staged: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Discount factor, forward and reason from the refit moments and pair counts of an expiry."""
    intercept, slope = line_from_moments()
    enough = F.col("matched_pairs_before_prune") >= min_pairs
    staged = staged.withColumns(
        {
            "matched_pairs_after_prune": F.when(enough, F.col("kept_pairs")).otherwise(F.lit(0)),
            "_alpha": intercept,
            "_discount": -slope,
        }
    ).withColumn("_forward", F.try_divide(F.col("_alpha"), F.col("_discount")))
    bad_discount = ~is_finite(F.col("_discount")) | (F.col("_discount") <= 0)
    bad_forward = ~is_finite(F.col("_forward")) | (F.col("_forward") <= 0)
    reason = (
        F.when(~enough, F.lit("fewer_than_3_matched_strikes"))
        .when(F.col("matched_pairs_after_prune") < min_pairs, F.lit("fewer_than_3_after_mad_prune"))
        .when(bad_discount, F.lit("non_positive_discount_factor"))
        .when(bad_forward, F.lit("non_positive_forward_price"))
    )
    valid = F.col("invalid_reason").isNull()
    return staged.withColumn("invalid_reason", reason).withColumns(
        {
            "discount_factor": F.when(valid, F.col("_discount")),
            "forward_price": F.when(valid, F.col("_forward")),
        }
    )


def split_forward_diagnostics(
    contracts: DataFrame,
    key: tuple[str, ...] = EXPIRY_KEY,
    min_pairs: int = MIN_PAIRS,
    multiple: float = MAD_MULTIPLE,
) -> DataFrame:
    """``forward_diagnostics`` for expiries with so many strikes that one task should not hold them.

    Both fits are aggregations and both medians come from ``skew.exact_median``; per-expiry results
    are joined back to the strikes, where adaptive execution can split a heavy expiry.
    """
    keys = list(key)
    pairs = strike_pairs(contracts, key)
    matched = matched_only(pairs).select(
        *keys,
        "strike",
        (F.col("call_mid") - F.col("put_mid")).alias("y"),
        F.least("call_vega", "put_vega").alias("w"),
    )
    matched = cut_lineage(matched)
    intercept, slope = line_from_moments()
    first = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"))
    fitted = group_line(matched, keys, "strike", "y", "w").join(first, keys)
    fitted = cut_lineage(fitted.select(*keys, "before", intercept.alias("_a"), slope.alias("_b")))
    residual = F.col("y") - (F.col("_a") + F.col("_b") * F.col("strike"))
    rows = cut_lineage(matched.join(fitted, keys).withColumn("residual", residual))
    centred = rows.join(exact_median(rows, key, "residual", "_centre"), keys, "left").withColumn(
        "deviation", F.abs(F.col("residual") - F.col("_centre"))
    )
    mads = exact_median(centred, key, "deviation", "mad")
    keep = (F.col("mad") <= 0) | F.col("mad").isNull() | (F.abs("residual") <= multiple * F.col("mad"))
    kept = cut_lineage(rows.join(mads, keys, "left").where(keep).select(*keys, "strike", "y", "w"))
    refit = group_line(kept, keys, "strike", "y", "w").join(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept_pairs")), keys)
    counts = (
        pairs.select(*keys).distinct()
        .join(first.select(*keys, "before"), keys, "left")
        .join(refit, keys, "left")
        .withColumns(
            {
                "matched_pairs_before_prune": F.coalesce("before", F.lit(0)),
                "kept_pairs": F.coalesce("kept_pairs", F.lit(0)),
            }
        )
    )
    return judged(counts, min_pairs).select(
        *keys, "discount_factor", "forward_price", "matched_pairs_before_prune", "matched_pairs_after_prune", "invalid_reason"
    )


def diagnostics_of(strikes: DataFrame, key: tuple[str, ...] = EXPIRY_KEY) -> DataFrame:
    """One row per expiry from the output of ``with_forward``; already partitioned by expiry."""
    return strikes.groupBy(*key).agg(
        *[
            F.max(c).alias(c)
            for c in (
                "discount_factor", "forward_price", "matched_pairs_before_prune", "matched_pairs_after_prune", "invalid_reason",
            )
        ]
    )


def forward_diagnostics(
    contracts: DataFrame,
    key: tuple[str, ...] = EXPIRY_KEY,
    min_pairs: int = MIN_PAIRS,
    multiple: float = MAD_MULTIPLE,
) -> DataFrame:
    """One row per expiry: pair counts, discount factor, forward and the reason it is invalid."""
    return diagnostics_of(with_forward(strike_pairs(contracts, key), key, min_pairs, multiple), key)


def forward_terms(diagnostics: DataFrame, root: str = "root") -> DataFrame:
    """The usable expiries only."""
    valid = diagnostics.where(F.col("invalid_reason").isNull()).drop("invalid_reason")
    return valid.withColumn("option_root", F.col(root))


def forward_rollup(diagnostics: DataFrame, by: tuple[str, ...] = ("quote_date",)) -> DataFrame:
    """Valid and invalid expiries per date with the sorted distinct reasons."""
    bad = F.col("invalid_reason").isNotNull()
    return diagnostics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("forward_total_expiries"),
        F.count_if(~bad).alias("forward_valid_expiries"),
        F.count_if(bad).alias("forward_invalid_expiries"),
        F.array_sort(F.collect_set("invalid_reason")).alias("forward_invalid_reason_codes"),
    )


def invalid_reason_summary(diagnostics: DataFrame) -> DataFrame:
    """Invalid expiries by reason, overall (null year) and by year, from one grouping-sets pass."""
    invalid = diagnostics.where(F.col("invalid_reason").isNotNull()).select(
        F.year("quote_date").alias("year"), "invalid_reason"
    )
    counted = invalid.groupBy("year", "invalid_reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupingSets(
        [[F.col("year"), F.col("invalid_reason")], [F.col("invalid_reason")], [F.col("year")], []],
        F.col("year"),
        F.col("invalid_reason"),
    ).agg(F.sum("n").alias("expiries"))
