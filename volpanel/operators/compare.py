"""Forecast comparison: aligned losses, Diebold-Mariano tests, Holm adjustment and the model confidence set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.mathx import hash_uniform, is_finite
from volpanel.functions.student import student_t_two_sided
from volpanel.session import cut_lineage

PANEL = ("metric",)
VARIANCE_FLOOR = 1e-12
# Differences below this are summation noise when a bootstrap statistic is held against the observed one.
TIE_TOLERANCE = 1e-9


# --- loss panels ------------------------------------------------------------------------------

def loss_series(
    losses: DataFrame, metrics: tuple[str, ...] = ("rmse_iv", "vega_rmse_iv"), by: tuple[str, ...] = ()
) -> DataFrame:
    """Squared metrics of a loss panel as long rows (panel, metric, model, target date, loss)."""
    entries = F.array(
        *[F.struct(F.lit(f"{m}_sq").alias("metric"), (F.col(m) * F.col(m)).alias("loss")) for m in metrics]
    )
    long = losses.select(*by, "model_name", "target_date", F.inline(entries))
    return long.select(*by, "metric", "model_name", "target_date", "loss")


def aligned_losses(losses: DataFrame, models: list[str], by: tuple[str, ...] = PANEL) -> DataFrame:
    """One row per (panel, target date) with one column per model."""
    return losses.groupBy(*by, "target_date").pivot("model_name", models).agg(F.first("loss"))


def loss_problems(losses: DataFrame, min_rows: int = 3, by: tuple[str, ...] = PANEL) -> DataFrame:
    """Panels that cannot be compared, with the reason; empty when everything is fine.

    Fewer than two models, unequal or short series, repeated dates, dates that not all models have, or a
    non-finite loss.
    """
    all_dates = losses.groupBy(*by, "target_date").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("one").alias("all_dates"))
    per_model = losses.groupBy(*by, "model_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("target_date").alias("dates"),
        F.count_if(~is_finite(F.col("loss"))).alias("bad"),
    )
    per_panel = per_model.groupBy(*by).agg(
        F.count(F.lit(1)).alias("models"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
        F.sum("bad").alias("non_finite"),
        F.sum(F.col("n") - F.col("dates")).alias("repeated"),
    )
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    per_panel = per_panel.join(all_dates.withColumnsRenamed({c: f"_{c}" for c in by}), same)
    reason = (
        F.when(F.col("models") < 2, "fewer_than_two_models")
        .when(F.col("non_finite") > 0, "non_finite_loss")
        .when(F.col("shortest") != F.col("longest"), "unequal_length")
        .when(F.col("repeated") > 0, "repeated_dates")
        .when(F.col("shortest") != F.col("all_dates"), "unaligned_dates")
        .when(F.col("shortest") < min_rows, "too_few_observations")
    )
    return per_panel.withColumn("problem", reason).where(F.col("problem").isNotNull()).select(*by, "problem")


def require_comparable(losses: DataFrame, min_rows: int = 3, by: tuple[str, ...] = PANEL) -> None:
    found = [tuple(r) for r in loss_problems(losses, min_rows, by).take(5)]
    if found:
        raise ValueError(f"loss series cannot be compared: {found}")


def model_pairs(losses: DataFrame, by: tuple[str, ...] = PANEL) -> DataFrame:
    """Loss differential of every unordered model pair per date, joined on the date."""
    left = losses.select(*by, "target_date", F.col("model_name").alias("model_a"), F.col("loss").alias("_a"))
    right = losses.select(*by, "target_date", F.col("model_name").alias("model_b"), F.col("loss").alias("_b"))
    joined = left.join(right, [*by, "target_date"]).where(F.col("model_a") < F.col("model_b"))
    return joined.withColumn("differential", F.col("_a") - F.col("_b")).drop("_a", "_b")


# --- Diebold-Mariano --------------------------------------------------------------------------

def long_run_variance(pairs: DataFrame, bandwidth: int = 5, by: tuple[str, ...] = PANEL) -> DataFrame:
    """Mean and Newey-West long-run variance of each pair's differential.

    Windows hold one pair's dates; every lag uses the same partitioning and order.
    """
    key = [*by, "model_a", "model_b"]
    whole = Window.partitionBy(*key)
    order = whole.orderBy("target_date")
    centred = pairs.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_mean": F.avg("differential").over(whole),
        }
    ).withColumn("_c", F.col("differential") - F.col("_mean"))
    lagged = centred.withColumns({f"_l{k}": F.lag("_c", k).over(order) for k in range(1, bandwidth + 1)})
    sums = lagged.groupBy(*key).agg(
        F.max("_n").alias("n_obs"),
        F.max("_mean").alias("mean_differential"),
        F.sum(F.col("_c") * F.col("_c")).alias("_g0"),
        *[F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_g{k}") for k in range(1, bandwidth + 1)],
    )
    last = F.least(F.lit(bandwidth), F.col("n_obs") - 1)
    variance = F.col("_g0")
    for k in range(1, bandwidth + 1):
        weight = F.when(F.lit(k) <= last, 1.0 - F.lit(k) / (last + 1.0)).otherwise(F.lit(0.0))
        variance = variance + 2.0 * weight * F.col(f"_g{k}")
    floored = F.greatest(variance / F.col("n_obs"), F.lit(VARIANCE_FLOOR))
    return sums.select(*key, "n_obs", "mean_differential", floored.alias("long_run_variance"))


def diebold_mariano(losses: DataFrame, bandwidth: int = 5, horizon: int = 1, by: tuple[str, ...] = PANEL) -> DataFrame:
    """Small-sample adjusted statistic and two-sided Student-t p-value per model pair, with Holm adjustment."""
    if bandwidth < 0 or horizon < 1:
        raise ValueError("bandwidth must be non-negative and horizon positive")
    require_comparable(losses, by=by)
    variance = long_run_variance(model_pairs(losses, by), bandwidth, by)
    n = F.col("n_obs")
    raw = F.col("mean_differential") / F.sqrt(F.col("long_run_variance") / n)
    scale = F.sqrt((n + 1.0 - 2.0 * horizon + horizon * (horizon - 1.0) / n) / n)
    tested = variance.withColumn("statistic", raw * scale).withColumn(
        "p_value", student_t_two_sided(F.col("statistic"), n - 1)
    )
    return holm_adjust(tested, by=by).withColumns({"bandwidth": F.lit(bandwidth), "horizon": F.lit(horizon)})


def holm_adjust(
    tests: DataFrame, p: str = "p_value", out: str = "adjusted_p_value",
    by: tuple[str, ...] = PANEL, ties: tuple[str, ...] = ("model_a", "model_b"),
) -> DataFrame:
    """Step-down adjustment within each panel: ranked p-values times the remaining count, made monotone."""
    order = Window.partitionBy(*by).orderBy(p, *ties)
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (total - F.row_number().over(order) + 1) * F.col(p))
    raised = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_step", step).withColumn(out, raised).drop("_step")


# --- stationary bootstrap ---------------------------------------------------------------------

@dataclass(frozen=True)
class BootstrapSettings:
    draws: int = 5000
    block_length: int = 10
    seed: int = 42
    # Draws of one panel that are worked on together; a panel with more of them is dealt to several tasks.
    unit_draws: int = 250

    def __post_init__(self):
        if self.draws <= 0 or self.block_length <= 0 or self.unit_draws <= 0:
            raise ValueError("draws, block length and draws per unit must be positive")

    @property
    def units(self) -> int:
        return -(-self.draws // self.unit_draws)


def deal_draws(panels: DataFrame, settings: BootstrapSettings) -> DataFrame:
    """Panel rows once per unit of draws, spread over at least as many tasks as a panel has units.

    The number of tasks is stated, so adaptive execution doesn't put the few bytes of many draws back together. A
    panel's columns are repeated once per unit, not once per draw.
    """
    tasks = max(settings.units, int(panels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return panels.select("*", F.explode(F.sequence(F.lit(0), F.lit(settings.units - 1))).alias("unit")).repartition(tasks)


def _unit_draws(settings: BootstrapSettings) -> Column:
    first = F.col("unit") * settings.unit_draws
    return F.sequence(first, F.least(first + settings.unit_draws, F.lit(settings.draws)) - 1)


def _random(kind: str, draw: Column, offset: Column, settings: BootstrapSettings) -> Column:
    """Uniform number of (seed, kind, draw, offset): any task can rebuild any of them."""
    return hash_uniform(F.lit(settings.seed), F.lit(kind), draw, offset)


def _fresh(draw: Column, offset: Column, settings: BootstrapSettings) -> Column:
    """Whether the path starts anew: at offset 0 and with probability 1 / block length afterwards."""
    return (offset == 0) | (_random("jump", draw, offset, settings) > 1.0 - 1.0 / settings.block_length)


def _start(draw: Column, offset: Column, length: Column, settings: BootstrapSettings) -> Column:
    return F.floor(_random("start", draw, offset, settings) * length).cast("bigint")


def bootstrap_paths(lengths: DataFrame, settings: BootstrapSettings = BootstrapSettings(), by: tuple[str, ...] = PANEL) -> DataFrame:
    """Index paths of the stationary bootstrap: one row per (panel, draw, offset) with a position.

    ``lengths`` gives ``length`` per panel. A new uniform start is drawn where the path starts anew; in between it
    moves on by one, modulo the length. A path is an array built inside its (panel, draw) row, so
    the rows of this report are never shuffled; ranges of draws are dealt to tasks before.
    """
    dealt = deal_draws(lengths.select(*by, "length"), settings)
    draws = dealt.select(*by, "length", F.explode(_unit_draws(settings)).alias("draw"))
    draw, length = F.col("draw"), F.col("length")
    offsets = F.sequence(F.lit(0), (length - 1).cast("int"))
    starts = F.filter(offsets, lambda o: _fresh(draw, o, settings))
    # Each start carries its block, up to the next start.
    begun = F.transform(
        F.arrays_zip(starts.alias("at"), F.array_append(F.slice(starts, F.lit(2), F.size(starts)), length.cast("int")).alias("to")),
        lambda s: F.transform(
            F.sequence(s["at"], s["to"] - 1),
            lambda o: F.pmod(_start(draw, s["at"], length, settings) + o - s["at"], length),
        ),
    )
    cells = draws.select(*by, "draw", F.posexplode(F.flatten(begun)).alias("offset", "position"))
    return cells.select(*by, "draw", "offset", "position")


def positioned_losses(losses: DataFrame, models: list[str], by: tuple[str, ...] = PANEL) -> DataFrame:
    """Aligned losses with a zero-based position per panel."""
    order = Window.partitionBy(*by).orderBy("target_date")
    return aligned_losses(losses, models, by).withColumn("position", (F.row_number().over(order) - 1).cast("bigint"))


def model_names(losses: DataFrame) -> list[str]:
    """The compared models, sorted: a handful of names."""
    return sorted(r[0] for r in losses.select("model_name").distinct().collect())


def drawn_means(losses: DataFrame, settings: BootstrapSettings, by: tuple[str, ...], models: list[str]) -> DataFrame:
    """One row per (panel, draw): the models' ``observed`` means and their ``means`` along the draw's path.

    Both arrays are in the order of ``models``, null for a model that the panel is without. The aligned losses of a
    panel are one array over its dates. It is dealt to tasks by ranges of draws; a draw is one row that walks its path and
    adds up all models in the same order, so equal series give equal means and nothing of size draws x dates
    is shuffled. A model that lacks some dates of a panel is an error.
    """
    wide = aligned_losses(losses, models, by)
    dated = wide.select(*by, *models, F.struct("target_date", F.array(*models).alias("values")).alias("entry"))
    length = F.count(F.lit(1))
    holes = reduce(lambda x, y: x | y, [F.count(F.col(m)).between(F.lit(1), length - 1) for m in models])
    # One panel's dates: an array the length of its test window. A panel may be without a model altogether.
    rows = F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["values"])
    gap = F.raise_error(F.lit("a model has no loss on some dates of its panel")).cast("array<array<double>>")
    panel = dated.groupBy(*by).agg(F.when(holes, gap).otherwise(rows).alias("rows"), length.alias("length"))
    draw, length = F.col("draw"), F.col("length")
    none = F.array_repeat(F.lit(0.0), len(models))

    def add(sums: Column, row: Column) -> Column:
        return F.zip_with(sums, row, lambda x, y: x + y)

    def mean(sums: Column) -> Column:
        return F.transform(sums, lambda x: x / length)

    def walk(acc: Column, o: Column) -> Column:
        base = F.when(_fresh(draw, o, settings), _start(draw, o, length, settings) - o).otherwise(acc["base"])
        row = F.element_at("rows", (F.pmod(base + o, length) + 1).cast("int"))
        return F.struct(base.alias("base"), add(acc["sums"], row).alias("sums"))

    dealt = deal_draws(panel.withColumn("observed", F.aggregate("rows", none, add, mean)), settings)
    draws = dealt.select("*", F.explode(_unit_draws(settings)).alias("draw"))
    start = F.struct(F.lit(0).cast("bigint").alias("base"), none.alias("sums"))
    offsets = F.sequence(F.lit(0), (length - 1).cast("int"))
    return draws.select(*by, "draw", "observed", F.aggregate(offsets, start, walk, lambda acc: mean(acc["sums"])).alias("means"))


def bootstrap_means(
    losses: DataFrame,
    settings: BootstrapSettings = BootstrapSettings(),
    by: tuple[str, ...] = PANEL,
    models: list[str] | None = None,
) -> DataFrame:
    """Mean loss per (panel, draw, model); draw -1 is the observed sample."""
    models = models or model_names(losses)
    drawn = drawn_means(losses, settings, by, models)
    sample = F.struct(F.col("draw").alias("draw"), F.col("means").alias("means"))
    observed = F.struct(F.lit(-1).alias("draw"), F.col("observed").alias("means"))
    # The panel's first draw also carries the observed sample.
    summed = drawn.select(*by, F.inline(F.when(F.col("draw") == 0, F.array(observed, sample)).otherwise(F.array(sample))))
    named = F.arrays_zip(F.array(*[F.lit(m) for m in models]).alias("model_name"), F.col("means").alias("mean_loss"))
    return summed.select(*by, "draw", F.inline(named)).where(F.col("mean_loss").isNotNull())


# --- model confidence set ---------------------------------------------------------------------

METHODS = ("Tmax", "TR")


def draw_rows(means: DataFrame, by: tuple[str, ...] = PANEL) -> DataFrame:
    """One row per (panel, draw) with the models' deviations from the observed means, sorted by name.

    The array holds the compared models, a handful; the observed sample is draw -1 of ``means``.
    """
    entries = F.array_sort(F.collect_list(F.struct("model_name", "mean_loss")))
    rows = means.groupBy(*by, "draw").agg(entries.alias("_models"))
    observed = rows.where("draw = -1").select(*by, F.col("_models").alias("_observed"))
    paired = F.zip_with(
        "_models",
        "_observed",
        lambda m, o: F.struct(
            m["model_name"].alias("model_name"),
            (m["mean_loss"] - o["mean_loss"]).alias("gap"),
            o["mean_loss"].alias("observed"),
        ),
    )
    return rows.where("draw >= 0").join(observed, list(by)).select(*by, "draw", paired.alias("entries"))


def drawn_gaps(losses: DataFrame, settings: BootstrapSettings, by: tuple[str, ...], models: list[str]) -> DataFrame:
    """The rows of ``draw_rows`` straight from the losses: every draw knows the observed means, nothing is regrouped."""
    models = sorted(models)
    named = F.arrays_zip(F.array(*[F.lit(m) for m in models]).alias("name"), "means", "observed")
    entries = F.transform(
        F.filter(named, lambda e: e["means"].isNotNull()),
        lambda e: F.struct(
            e["name"].alias("model_name"), (e["means"] - e["observed"]).alias("gap"), e["observed"].alias("observed")
        ),
    )
    return drawn_means(losses, settings, by, models).select(*by, "draw", entries.alias("entries"))


def _part(draw: Column, parts: int) -> Column:
    return F.pmod(draw, F.lit(parts)).cast("int")


def _every_part(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")


def step_items(drawn: DataFrame, active: DataFrame, by: tuple[str, ...], parts: int = 1) -> DataFrame:
    """Per (panel, method, draw) the compared quantities with their observed values, in name order.

    Tmax sets each active model against the average of the others, TR against every other model. A panel's draws meet its
    short list of models in ``parts`` parts, so that they needn't be in one task.
    """
    key = [*by, "method"]
    listed = active.groupBy(*key).agg(F.array_sort(F.collect_set("model_name")).alias("models")).select("*", _every_part(parts))
    rows = drawn.withColumn("_part", _part(F.col("draw"), parts)).join(listed, [*by, "_part"]).withColumn(
        "_e", F.filter("entries", lambda e: F.array_contains("models", e["model_name"]))
    )
    count = F.size("models").cast("double")

    def total(field: str) -> Column:
        return F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e[field])

    rows = rows.withColumns({"_gaps": total("gap"), "_levels": total("observed")})
    single = F.transform(
        "_e",
        lambda e: F.struct(
            e["model_name"].alias("a"),
            F.lit("").alias("b"),
            ((count * e["gap"] - F.col("_gaps")) / (count - 1.0)).alias("d"),
            ((count * e["observed"] - F.col("_levels")) / (count - 1.0)).alias("o"),
        ),
    )
    pairs = F.flatten(
        F.transform(
            "_e",
            lambda e: F.transform(
                F.filter("_e", lambda f: f["model_name"] != e["model_name"]),
                lambda f: F.struct(
                    e["model_name"].alias("a"),
                    f["model_name"].alias("b"),
                    (e["gap"] - f["gap"]).alias("d"),
                    (e["observed"] - f["observed"]).alias("o"),
                ),
            ),
        )
    )
    items = F.when(F.col("method") == "Tmax", single).otherwise(pairs)
    return rows.select(*key, "_part", "draw", "models", items.alias("items"))


def elimination_step(
    means: DataFrame | None,
    active: DataFrame,
    by: tuple[str, ...] = PANEL,
    drawn: DataFrame | None = None,
    parts: int = 1,
) -> DataFrame:
    """One step for every (panel, method): statistic, bootstrap p-value and the model to drop.

    ``means`` are bootstrap means with the observed sample as draw -1; ``active`` lists the models
    still in each (panel, method); ``drawn`` are the rows made of them, if they are at hand. Both methods share three
    aggregations whose map sides combine the draws, and joins dealt by ``parts``.
    """
    key = [*by, "method"]
    items = step_items(drawn if drawn is not None else draw_rows(means, by), active, by, parts)
    one_sided = F.col("method") == "Tmax"
    spread = (
        items.select(*key, F.inline("items"))
        .groupBy(*key, "a", "b")
        .agg(F.sqrt(F.greatest(F.var_samp("d"), F.lit(VARIANCE_FLOOR))).alias("s"), F.min("o").alias("o"))
        .withColumn("t", F.col("o") / F.col("s"))
    )
    summary = spread.groupBy(*key).agg(
        F.max(F.when(one_sided, F.col("t")).otherwise(F.abs("t"))).alias("observed_statistic"),
        F.min_by("a", F.struct(-F.col("t"), F.col("a"))).alias("eliminated_model"),
        F.array_sort(F.collect_list(F.struct("a", "b", "s"))).alias("scales"),
    )
    scaled = F.zip_with("items", "scales", lambda i, s: i["d"] / s["s"])
    boot = F.when(one_sided, F.array_max(scaled)).otherwise(F.array_max(F.transform(scaled, F.abs)))
    reached = (boot >= F.col("observed_statistic") - TIE_TOLERANCE).cast("double")
    return items.join(summary.select("*", _every_part(parts)), [*key, "_part"]).groupBy(*key).agg(
        F.max("models").alias("models"),
        F.max("observed_statistic").alias("observed_statistic"),
        F.avg(reached).alias("p_value"),
        F.max("eliminated_model").alias("eliminated_model"),
    )


def confidence_set_steps(
    losses: DataFrame,
    alpha: float = 0.10,
    settings: BootstrapSettings = BootstrapSettings(),
    by: tuple[str, ...] = PANEL,
) -> DataFrame:
    """All elimination steps of all panels and both methods.

    The loop runs at most (models - 1) times whatever the number of panels; the draws are
    checkpointed once and every step only re-reads them. ``eliminated_model`` is null where a panel
    stops because its p-value exceeds alpha.
    """
    models = model_names(losses)
    if len(models) < 2:
        raise ValueError("a model confidence set needs at least two models")
    require_comparable(losses, by=by)
    drawn = cut_lineage(drawn_gaps(losses, settings, by, models))
    key = [*by, "method"]
    methods = F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method")
    entered = losses.select(*by, "model_name").distinct().select(*by, "model_name", methods)
    active, steps = entered, None
    for number in range(1, len(models)):
        step = elimination_step(None, active, by, drawn, settings.units).withColumn("step", F.lit(number))
        stops = F.col("p_value") > alpha
        step = cut_lineage(step.withColumn("eliminated_model", F.when(~stops, F.col("eliminated_model"))))
        steps = step if steps is None else steps.unionByName(step)
        # A panel goes on when it dropped a model and at least two are left.
        goes_on = step.where(F.col("eliminated_model").isNotNull() & (F.size("models") > 2)).select(*key)
        if goes_on.isEmpty():
            break
        gone = steps.where("eliminated_model IS NOT NULL").select(*key, F.col("eliminated_model").alias("model_name"))
        active = entered.join(goes_on, key, "left_semi").join(gone, [*key, "model_name"], "left_anti")
    return steps


def confidence_set(steps: DataFrame, losses: DataFrame, by: tuple[str, ...] = PANEL) -> DataFrame:
    """Elimination order, included and excluded models per (panel, method)."""
    key = [*by, "method"]
    order = F.filter(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "eliminated_model"))), lambda s: s["eliminated_model"]),
        lambda m: m.isNotNull(),
    )
    ordered = steps.groupBy(*key).agg(order.alias("elimination_order"))
    everyone = losses.groupBy(*by).agg(F.array_sort(F.collect_set("model_name")).alias("_all"))
    return ordered.join(everyone, list(by)).select(
        *key,
        "elimination_order",
        F.array_except("_all", "elimination_order").alias("included_models"),
        F.array_sort("elimination_order").alias("excluded_models"),
    )
