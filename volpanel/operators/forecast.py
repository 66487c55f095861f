"""Next-date forecasts of panel states, refitted chunk by chunk over an expanding window.

A model takes the bucketed feature rows of ``calendar.walk_forward_buckets`` and the state panel and
returns one row per evaluated (panel, origin, target) with the forecast state columns. All chunks of
all panels are fitted in one job: training sums are formed per bucket, each row read once, and a
cumulative window turns them into the sums of everything before a chunk.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.ssvi import LATENT_COLUMNS
from volpanel.operators.calendar import PRIOR_BUCKET, gather_states
from volpanel.operators.features import with_history
from volpanel.operators.keys import PANEL_KEY
from volpanel.operators.skew import parallelism

ROW_KEY = ("quote_date", "target_date", "chunk_id")


class Forecaster(Protocol):
    """Plug-in interface of a state model."""

    model_name: str

    def fit_predict(self, bucketed: DataFrame, states: DataFrame) -> DataFrame: ...


def evaluated(bucketed: DataFrame) -> DataFrame:
    return bucketed.where(F.col("chunk_id") != PRIOR_BUCKET)


def as_forecasts(rows: DataFrame, model_name: str, columns: tuple[str, ...], by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    return rows.select(
        F.lit(model_name).alias("model_name"),
        *by,
        F.col("quote_date").alias("forecast_origin"),
        "target_date",
        "chunk_id",
        *columns,
    )


class StateLast:
    """Persistence: tomorrow's state is today's."""

    model_name = "state_last"

    def __init__(self, columns: tuple[str, ...] = LATENT_COLUMNS, by: tuple[str, ...] = PANEL_KEY):
        self.columns, self.by = columns, by

    def fit_predict(self, bucketed: DataFrame, states: DataFrame) -> DataFrame:
        rows = gather_states(evaluated(bucketed), states, self.columns, by=self.by)
        return as_forecasts(rows, self.model_name, self.columns, self.by)


# --- vector autoregression --------------------------------------------------------------------

def outer_products(left: Column, right: Column) -> Column:
    """Products of two vectors, flattened row by row."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: a * b)))


def expanding_sums(rows: DataFrame, vector: str, by: tuple[str, ...], bucket: str = "chunk_id") -> DataFrame:
    """Element-wise sums of ``vector`` over all smaller buckets, as one array per (panel, bucket).

    The sums are formed per (panel, bucket, element) with map-side combination; the running window
    sees one row per bucket and element.
    """
    long = rows.select(*by, bucket, F.posexplode(vector).alias("_at", "_v"))
    sums = long.groupBy(*by, bucket, "_at").agg(F.sum("_v").alias("_v"))
    before = Window.partitionBy(*by, "_at").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("_total", F.sum("_v").over(before)).where(F.col("_total").isNotNull())
    packed = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_total"))), lambda e: e["_total"])
    return running.groupBy(*by, bucket).agg(packed.alias("moments"))


def _regression_solver(size: int):
    def solve(moments: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for values in moments:
            sums = np.asarray(values, dtype=float).reshape(size + 1, 2 * size + 1)
            n = sums[0, 0]
            if n < 2:
                raise ValueError("a vector autoregression needs at least two training rows")
            mean_x, mean_y = sums[0, 1 : size + 1] / n, sums[0, size + 1 :] / n
            xx = sums[1:, 1 : size + 1] - n * np.outer(mean_x, mean_x)
            xy = sums[1:, size + 1 :] - n * np.outer(mean_x, mean_y)
            slope = np.linalg.lstsq(xx, xy, rcond=1e-11)[0]
            intercept = mean_y - mean_x @ slope
            out.append(np.vstack([intercept, slope]).T.ravel().tolist())
        return pd.Series(out)

    return F.pandas_udf(solve, "array<double>")


def linear_prediction(design: Column, coefficients: Column, size: int, outputs: int) -> list[Column]:
    """Dot products of the design vector with each output's coefficients (stored output by output)."""
    return [
        F.aggregate(
            F.zip_with(design, F.slice(coefficients, 1 + j * size, size), lambda a, b: a * b),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
        for j in range(outputs)
    ]


class StateVar1:
    """First-order vector autoregression with intercept by least squares.

    The solver sees one row of (d+1)(2d+1) sums per panel and chunk, inside executors.
    """

    model_name = "state_var1"

    def __init__(self, columns: tuple[str, ...] = LATENT_COLUMNS, by: tuple[str, ...] = PANEL_KEY):
        self.columns, self.by = columns, by

    def sums(self, bucketed: DataFrame, states: DataFrame) -> DataFrame:
        """(panel, chunk) with the sums of products over all rows before the chunk."""
        rows = gather_states(bucketed, states, self.columns, by=self.by)
        rows = gather_states(rows, states, self.columns, "target_state_row_index", "_y_", self.by)
        x = F.array(F.lit(1.0), *[F.col(c) for c in self.columns])
        xy = F.array(F.lit(1.0), *[F.col(c) for c in self.columns], *[F.col(f"_y_{c}") for c in self.columns])
        products = rows.select(*self.by, "chunk_id", outer_products(x, xy).alias("_products"))
        return expanding_sums(products, "_products", self.by)

    def coefficients(self, bucketed: DataFrame, states: DataFrame) -> DataFrame:
        sums = self.sums(bucketed, states)
        solver = _regression_solver(len(self.columns))
        return sums.select(*self.by, "chunk_id", solver(F.col("moments")).alias("coefficients"))

    def fit_predict(self, bucketed: DataFrame, states: DataFrame) -> DataFrame:
        fitted = self.coefficients(bucketed, states)
        rows = gather_states(evaluated(bucketed), states, self.columns, by=self.by)
        design = F.array(F.lit(1.0), *[F.col(c) for c in self.columns])
        size = len(self.columns) + 1
        joined = rows.join(fitted, [*self.by, "chunk_id"]).withColumn("_design", design)
        predicted = linear_prediction(F.col("_design"), F.col("coefficients"), size, len(self.columns))
        named = joined.select(
            *self.by, *ROW_KEY, *[p.alias(c) for p, c in zip(predicted, self.columns)]
        )
        return as_forecasts(named, self.model_name, self.columns, self.by)


# --- direct forecaster on history windows -----------------------------------------------------

#: Fewest training rows of a refit; the last tenth of them, at least one, choose the penalty.
MIN_TRAINING = 6
HELD_SHARE = 10
STD_FLOOR = 1e-6


def _block_moments():
    def moments(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = np.stack(frame["_x"].to_numpy())
        design = np.hstack([np.ones((len(x), 1)), x])
        y = np.stack(frame["_y"].to_numpy())
        head = frame.iloc[[0]].drop(columns=["_x", "_y"])
        return head.assign(
            xx=[(design.T @ design).ravel().tolist()],
            xy=[(design.T @ y).ravel().tolist()],
            yy=[(y * y).sum(axis=0).tolist()],
        )

    return moments


def refit_cuts(bucketed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per panel: ``chunks`` (chunk, training rows, rows before the holdout) and ``cuts``, all these row counts in order.

    A refit trains on the first rows of its panel by date; its holdout is the last tenth of them. A chunk with nothing before it
    has no refit, and so no forecasts (``calendar.chronology_violations`` reports it).
    """
    counts = bucketed.groupBy(*by, "chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.withColumn("rows", F.coalesce(F.sum("_n").over(before), F.lit(0))).where((F.col("chunk_id") != PRIOR_BUCKET) & (F.col("rows") > 0))
    enough = F.when(F.col("rows") >= MIN_TRAINING, F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit(f"a refit needs {MIN_TRAINING} training rows, found "), F.col("rows").cast("string"))).cast("bigint")
    )
    sized = sized.withColumn("rows", enough)
    sized = sized.withColumn("fit_rows", F.col("rows") - F.greatest(F.lit(1), F.floor(F.col("rows") / HELD_SHARE)))
    chunks = F.array_sort(F.collect_list(F.struct("chunk_id", "rows", "fit_rows")))
    packed = sized.groupBy(*by).agg(chunks.alias("chunks"))
    every = F.flatten(F.transform("chunks", lambda c: F.array(c["rows"], c["fit_rows"])))
    return packed.withColumn("cuts", F.array_sort(F.array_distinct(every)))


def segment_of(position: Column) -> Column:
    """Number of cuts at or before a row's position: rows of one segment belong to the same refits."""
    return F.size(F.filter("cuts", lambda c: c <= position))


class DirectHistory:
    """Ridge regression of the next state on the flattened window of the last ``history_days`` features.

    Every refit normalizes with the statistics of its own training rows before the holdout, chooses the penalty on its
    holdout, the last tenth of its rows by date, and is fitted on all of them. Still each row is read once: normalizing is
    linear, so sums of products of raw windows serve all refits. Rows are cut where a refit or its holdout begins; sums of the
    segments (split further into blocks of ``block_rows``) run up to the sums of every refit, and each (panel, refit, penalty) is a
    solve of its own, dealt over the tasks. Windows are taken relative to the panel's mean state, which keeps the sums small.
    """

    model_name = "direct_history"

    def __init__(
        self,
        feature_columns: tuple[str, ...],
        state_columns: tuple[str, ...] = LATENT_COLUMNS,
        history_days: int = 10,
        penalties: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0),
        by: tuple[str, ...] = PANEL_KEY,
        block_rows: int = 64,
    ):
        self.feature_columns, self.state_columns = feature_columns, state_columns
        self.history_days, self.penalties, self.by, self.block_rows = history_days, penalties, by, block_rows
        self.size = history_days * len(feature_columns) + 1

    def design_rows(self, bucketed: DataFrame, states: DataFrame) -> DataFrame:
        """Feature rows with the flattened window ``_x``, relative to the panel's mean, and the target state ``_y``."""
        by = self.by
        mean = states.groupBy(*by).agg(F.array(*[F.avg(c) for c in self.feature_columns]).alias("_mean"))
        windows = with_history(states, self.feature_columns, self.history_days, by).join(mean, list(by))
        moved = F.transform("history", lambda day: F.zip_with(day, F.col("_mean"), lambda v, m: v - m))
        windows = windows.select(*by, F.col("state_row_index").alias("history_end_index"), F.flatten(moved).alias("_x"))
        targets = states.select(
            *by,
            F.col("state_row_index").alias("target_state_row_index"),
            F.array(*[F.col(c).cast("double") for c in self.state_columns]).alias("_y"),
        )
        rows = bucketed.join(windows, [*by, "history_end_index"]).join(targets, [*by, "target_state_row_index"])
        return rows.select(*by, *ROW_KEY, "history_end_index", "_x", "_y")

    def segment_sums(self, placed: DataFrame) -> DataFrame:
        """Sums of products per panel, segment and block of training rows."""
        by = self.by
        block = F.floor(F.col("position") / self.block_rows).cast("int")
        trained = placed.where(F.col("segment") < F.size("cuts")).withColumn("block_no", block)
        columns = trained.select(*by, "segment", "block_no", "_x", "_y")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema if f.name in by)
        return columns.groupBy(*by, "segment", "block_no").applyInPandas(
            _block_moments(), f"{schema}, segment int, block_no int, xx array<double>, xy array<double>, yy array<double>"
        )

    def segment_stats(self, placed: DataFrame, states: DataFrame) -> DataFrame:
        """Count, mean and squared deviations, per segment, of the states that its rows' windows are the first to use."""
        by = self.by
        ends = placed.select(*by, F.col("history_end_index").alias("state_row_index"), "position", "segment")
        ahead = Window.partitionBy(*by).orderBy("state_row_index").rowsBetween(0, self.history_days - 1)
        entry = F.when(F.col("position").isNotNull(), F.struct("position", "segment"))
        marked = states.join(ends, [*by, "state_row_index"], "left").withColumn("_first", F.min(entry).over(ahead))
        used = marked.where(F.col("_first").isNotNull()).withColumn("segment", F.col("_first.segment"))
        columns = [F.col(c).cast("double") for c in self.feature_columns]
        return used.groupBy(*by, "segment").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(c) for c in columns]).alias("mean"),
            F.array(*[F.var_pop(c) for c in columns]).alias("variance"),
        )

    def refit_sums(self, bucketed: DataFrame, states: DataFrame, design: DataFrame) -> DataFrame:
        """Per (panel, chunk): sums over its training rows and over those before the holdout, and normalization statistics.

        Running sums over segments; a panel's task sees one matrix per segment, never rows, and solves nothing.
        """
        by, size = list(self.by), self.size
        cuts = refit_cuts(bucketed, self.by)
        position = F.row_number().over(Window.partitionBy(*by).orderBy("quote_date")) - 1
        placed = design.withColumn("position", position).join(cuts.select(*by, "cuts"), by)
        placed = placed.withColumn("segment", segment_of(F.col("position")))
        stats = self.segment_stats(placed, states).join(cuts, by)

        def running(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            columns = [*by, "chunk_id", "fit", "whole", "mean", "std"]
            if not len(blocks) or not len(found):
                return pd.DataFrame(columns=columns)
            cut_list = list(found["cuts"].iloc[0])
            width = len(blocks["xx"].iloc[0]) + len(blocks["xy"].iloc[0]) + len(blocks["yy"].iloc[0])
            sums = np.zeros((len(cut_list), width))
            for at, *parts in blocks.sort_values(["segment", "block_no"])[["segment", "xx", "xy", "yy"]].itertuples(index=False):
                sums[at] += np.concatenate(parts)
            upto = np.cumsum(sums, axis=0)
            stat = {int(s): (n, np.asarray(m), np.asarray(v) * n) for s, n, m, v in found[["segment", "n", "mean", "variance"]].itertuples(index=False)}
            merged, held = [], (0, np.zeros(1), np.zeros(1))
            for at in range(len(cut_list)):
                if at in stat:
                    (n, m, q), (k, mk, qk) = held, stat[at]
                    shift = mk - m
                    held = (n + k, m + shift * (k / (n + k)), q + qk + shift * shift * (n * k / (n + k)))
                merged.append(held)
            head = blocks[by].iloc[0].tolist()
            out = []
            for chunk in found["chunks"].iloc[0]:
                fit, whole = cut_list.index(chunk["fit_rows"]), cut_list.index(chunk["rows"])
                n, mean, squares = merged[fit]
                std = np.sqrt(squares / n)
                std = np.where(std < STD_FLOOR, 1.0, std)
                out.append((*head, int(chunk["chunk_id"]), upto[fit].tolist(), upto[whole].tolist(), mean.tolist(), std.tolist()))
            return pd.DataFrame(out, columns=columns)

        sums = self.segment_sums(placed)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in by)
        kinds = "chunk_id int, fit array<double>, whole array<double>, mean array<double>, std array<double>"
        refits = sums.groupBy(*by).cogroup(stats.groupBy(*by)).applyInPandas(running, f"{schema}, {kinds}")
        offset = states.groupBy(*by).agg(F.array(*[F.avg(c) for c in self.feature_columns]).alias("offset"))
        return refits.join(offset, by)

    def _solver(self):
        size, outputs, days = self.size, len(self.state_columns), self.history_days

        def solve(fit: pd.Series, whole: pd.Series, mean: pd.Series, std: pd.Series, offset: pd.Series, penalty: pd.Series) -> pd.DataFrame:
            import numpy as np

            def parts(values, turn):
                values = np.asarray(values, dtype=float)
                xx, xy = values[: size * size].reshape(size, size), values[size * size : size * (size + outputs)].reshape(size, outputs)
                return turn @ xx @ turn.T, turn @ xy, values[size * (size + outputs) :]

            rows = []
            for fit_, whole_, mean_, std_, offset_, penalty_ in zip(fit, whole, mean, std, offset, penalty):
                # Rows of the turn give a normalized column as a combination of the raw ones.
                centre = np.tile(np.asarray(mean_) - np.asarray(offset_), days)
                spread = np.tile(np.asarray(std_), days)
                turn = np.zeros((size, size))
                turn[0, 0] = 1.0
                turn[1:, 0] = -centre / spread
                turn[np.arange(1, size), np.arange(1, size)] = 1.0 / spread
                weights = np.full(size, penalty_)
                weights[0] = 1e-9
                (xx, xy, yy), (xx_all, xy_all, yy_all) = parts(fit_, turn), parts(whole_, turn)
                b = np.linalg.solve(xx + np.diag(weights), xy)
                xx_held, xy_held = xx_all - xx, xy_all - xy
                error = (yy_all - yy) - 2.0 * (b * xy_held).sum(axis=0) + (b * (xx_held @ b)).sum(axis=0)
                final = turn.T @ np.linalg.solve(xx_all + np.diag(weights), xy_all)
                rows.append((float(error.sum()), final.T.ravel().tolist()))
            return pd.DataFrame(rows, columns=["error", "coefficients"])

        return F.pandas_udf(solve, "error double, coefficients array<double>")

    def coefficients(self, bucketed: DataFrame, states: DataFrame, design: DataFrame) -> DataFrame:
        """(panel, chunk): the chosen penalty and its coefficients for ``_x``, output by output."""
        keys = [*self.by, "chunk_id"]
        options = F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(float(p)).alias("penalty")) for i, p in enumerate(self.penalties)])
        tried = self.refit_sums(bucketed, states, design).select("*", F.inline(options))
        tried = tried.repartition(parallelism(tried), *keys, "_at")
        solved = tried.select(*keys, "_at", "penalty", self._solver()("fit", "whole", "mean", "std", "offset", "penalty").alias("s"))
        best = F.min_by(F.struct("penalty", "s.coefficients"), F.struct("s.error", "_at"))
        return solved.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.penalty", "b.coefficients")

    def fit_predict(self, bucketed: DataFrame, states: DataFrame) -> DataFrame:
        design = self.design_rows(bucketed, states)
        fitted = self.coefficients(bucketed, states, design)
        rows = evaluated(design).join(fitted, [*self.by, "chunk_id"])
        rows = rows.withColumn("_design", F.concat(F.array(F.lit(1.0)), F.col("_x")))
        predicted = linear_prediction(F.col("_design"), F.col("coefficients"), self.size, len(self.state_columns))
        named = rows.select(*self.by, *ROW_KEY, *[p.alias(c) for p, c in zip(predicted, self.state_columns)])
        return as_forecasts(named, self.model_name, self.state_columns, self.by)


# --- walk-forward panels ----------------------------------------------------------------------

def forecast_panel(models: list[Forecaster], bucketed: DataFrame, states: DataFrame) -> DataFrame:
    """Forecasts of all models, long by model."""
    parts = [m.fit_predict(bucketed, states) for m in models]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def state_losses(forecasts: DataFrame, states: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """Root mean squared and mean absolute error of the forecast state per model and target date."""
    actual = states.select(*by, F.col("quote_date").alias("target_date"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    joined = forecasts.join(actual, [*by, "target_date"])
    errors = [F.col(c) - F.col(f"_a_{c}") for c in columns]
    squared = sum((e * e for e in errors[1:]), errors[0] * errors[0])
    absolute = sum((F.abs(e) for e in errors[1:]), F.abs(errors[0]))
    return joined.select(
        "model_name", *by, "forecast_origin", "target_date", "chunk_id",
        F.sqrt(squared / len(columns)).alias("rmse"), (absolute / len(columns)).alias("mae"),
    )


def choose_candidate(losses: DataFrame, candidate: str = "model_name", by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """Candidate with the smallest mean RMSE per panel, ties by MAE, then by name."""
    means = losses.groupBy(*by, candidate).agg(F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"))
    order = F.struct("mean_rmse", "mean_mae", candidate)
    best = means.groupBy(*by).agg(F.min_by(F.struct(candidate, "mean_rmse", "mean_mae"), order).alias("b"))
    return best.select(*by, "b.*")
