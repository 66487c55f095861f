"""Candidates of a model family: fitted together on the validation window, the winner of each panel on the test window.

A family adds a candidate dimension to the chunked fits of ``forecast``: training sums don't depend on a penalty, so
they are formed once and solved for every candidate; candidates with another design are further branches of
the same plan. Scoring is the caller's, as it may need nodes; it hands back one winner per (panel, family). Only
winners are predicted on the test window.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions.ssvi import LATENT_COLUMNS
from volpanel.operators import forecast
from volpanel.operators.calendar import gather_states
from volpanel.operators.keys import PANEL_KEY

SEPARATOR = "/"


class Family:
    """Forecasters of their own design, one per candidate id."""

    def __init__(self, name: str, candidates: dict[str, forecast.Forecaster], by: tuple[str, ...] = PANEL_KEY):
        self.name, self.candidates, self.by = name, candidates, by

    def candidate_ids(self) -> list[str]:
        return list(self.candidates)

    def forecasts(self, bucketed: DataFrame, states: DataFrame, winners: DataFrame | None = None) -> DataFrame:
        """Forecasts of all candidates, or of each panel's winner, with ``candidate_id``.

        A candidate that did not win a panel is not fitted for it.
        """
        parts = []
        for candidate, model in self.candidates.items():
            rows = bucketed
            if winners is not None:
                rows = bucketed.join(winners.where(F.col("candidate_id") == candidate).select(*self.by), list(self.by), "left_semi")
            parts.append(model.fit_predict(rows, states).withColumn("candidate_id", F.lit(candidate)))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result.withColumn("model_name", F.lit(self.name))


def _ridge_solver(size: int, penalties: Sequence[float]):
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
            fits = []
            for penalty in penalties:
                slope = np.linalg.lstsq(xx + penalty * np.eye(size), xy, rcond=1e-11)[0]
                fits.append(np.vstack([mean_y - mean_x @ slope, slope]).T.ravel().tolist())
            out.append(fits)
        return pd.Series(out)

    return F.pandas_udf(solve, "array<array<double>>")


class RidgeVar:
    """First-order vector autoregressions with the given penalties on their centred slopes.

    One pass over the rows serves all candidates: the sums of a chunk are solved once per penalty.
    """

    def __init__(
        self,
        penalties: Sequence[float] = (0.0, 0.01, 1.0),
        columns: tuple[str, ...] = LATENT_COLUMNS,
        name: str = "state_var1",
        by: tuple[str, ...] = PANEL_KEY,
    ):
        self.penalties, self.columns, self.name, self.by = tuple(float(p) for p in penalties), columns, name, by

    def candidate_ids(self) -> list[str]:
        return [f"penalty={p:g}" for p in self.penalties]

    def coefficients(self, bucketed: DataFrame, states: DataFrame) -> DataFrame:
        """(panel, chunk, candidate) with the coefficients, output by output."""
        sums = forecast.StateVar1(self.columns, self.by).sums(bucketed, states)
        solver = _ridge_solver(len(self.columns), self.penalties)
        solved = sums.select(*self.by, "chunk_id", F.posexplode(solver(F.col("moments"))).alias("_at", "coefficients"))
        names = F.array(*[F.lit(c) for c in self.candidate_ids()])
        return solved.withColumn("candidate_id", names[F.col("_at")]).drop("_at")

    def forecasts(self, bucketed: DataFrame, states: DataFrame, winners: DataFrame | None = None) -> DataFrame:
        fitted = self.coefficients(bucketed, states)
        if winners is not None:
            fitted = fitted.join(winners.select(*self.by, "candidate_id"), [*self.by, "candidate_id"], "left_semi")
        rows = gather_states(forecast.evaluated(bucketed), states, self.columns, by=self.by)
        design = F.array(F.lit(1.0), *[F.col(c) for c in self.columns])
        size = len(self.columns) + 1
        met = rows.join(fitted, [*self.by, "chunk_id"]).withColumn("_design", design)
        predicted = forecast.linear_prediction(F.col("_design"), F.col("coefficients"), size, len(self.columns))
        named = met.select(
            *self.by, *forecast.ROW_KEY, "candidate_id", *[p.alias(c) for p, c in zip(predicted, self.columns)]
        )
        return forecast.as_forecasts(named, self.name, (*self.columns, "candidate_id"), self.by)


def single(model: forecast.Forecaster) -> Family:
    """A family of one candidate, which needs no choice."""
    return Family(model.model_name, {"only": model})


def candidate_panel(families: Sequence, bucketed: DataFrame, states: DataFrame) -> DataFrame:
    """Forecasts of every candidate of every family that has a choice, as one plan; ``model_name`` is family/candidate."""
    parts = [f.forecasts(bucketed, states) for f in families if len(f.candidate_ids()) > 1]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    named = F.concat_ws(SEPARATOR, "model_name", "candidate_id")
    return result.withColumn("model_name", named).drop("candidate_id")


def split_name(name: str | Column = "model_name") -> dict[str, Column]:
    """Family and candidate of a candidate panel's ``model_name``."""
    name = F.col(name) if isinstance(name, str) else name
    return {"family": F.substring_index(name, SEPARATOR, 1), "candidate_id": F.substring(name, F.instr(name, SEPARATOR) + 1, F.length(name))}


def only_candidates(families: Sequence, panels: DataFrame, by: tuple[str, ...] = PANEL_KEY) -> DataFrame:
    """(panel, family, candidate_id) of the families without a choice."""
    entries = [F.struct(F.lit(f.name).alias("family"), F.lit(f.candidate_ids()[0]).alias("candidate_id")) for f in families if len(f.candidate_ids()) == 1]
    empty = F.array().cast("array<struct<family:string,candidate_id:string>>")
    return panels.select(*by).distinct().select(*by, F.inline(F.array(*entries) if entries else empty))


def winner_panel(families: Sequence, winners: DataFrame, bucketed: DataFrame, states: DataFrame) -> DataFrame:
    """Test-window forecasts of each panel's winner (panel, family, candidate_id), one model per family."""
    parts = []
    for family in families:
        won = winners.where(F.col("family") == family.name)
        parts.append(family.forecasts(bucketed, states, None if len(family.candidate_ids()) == 1 else won))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def tuned_states(
    families: Sequence, validation: DataFrame, test: DataFrame, states: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = PANEL_KEY
) -> DataFrame:
    """Both steps with losses of the states themselves: the candidate with the smallest mean RMSE forecasts the test window."""
    losses = forecast.state_losses(candidate_panel(families, validation, states), states, columns, by).withColumns(split_name())
    best = forecast.choose_candidate(losses, "candidate_id", (*by, "family")).select(*by, "family", "candidate_id")
    winners = best.unionByName(only_candidates(families, test, by))
    return winner_panel(families, winners, test, states)
