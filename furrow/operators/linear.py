"""Linear models and their grid search from co-moments: the rows are read once, whatever the grid.

The settings mean what they mean for MLlib: features and target are scaled by their standard deviations, the
penalty is ``regParam`` over the target's, shared between absolute and squared coefficients.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.comoments import Moments
from furrow.operators.ml import GRIDS
from furrow.operators.moments import collected, comoment_states

SWEEPS, SETTLED = 10_000, 1e-12


@dataclass(frozen=True)
class Line:
    """``intercept + coefficients . x``."""

    coefficients: np.ndarray
    intercept: float

    def column(self, features: str = "features"):
        """Prediction for an array column, inside the JVM."""
        weights = F.array(*[F.lit(float(x)) for x in self.coefficients])
        terms = F.zip_with(F.col(features), weights, lambda x, w: x * w)
        return F.aggregate(terms, F.lit(float(self.intercept)), lambda t, x: t + x)


def fit(state: Moments, reg: float = 0.0, elastic: float = 0.0) -> Line:
    """The model of the last column on all others; a constant column gets no weight."""
    rows = max(state.n[-1, -1], 1)
    mean, bend = np.diag(state.mean), state.cross / rows
    scale = np.sqrt(np.maximum(np.diag(bend), 0))
    used = np.flatnonzero(scale[:-1] > 1e-12 * np.maximum(np.abs(mean[:-1]), 1e-300))
    weights = np.zeros(len(mean) - 1)
    if len(used) and scale[-1] > 0:
        gram = bend[np.ix_(used, used)] / np.outer(scale[used], scale[used])
        aim = bend[used, -1] / (scale[used] * scale[-1])
        penalty = reg / scale[-1]
        flat, round_ = penalty * elastic, penalty * (1 - elastic)
        if flat == 0:
            found = np.linalg.lstsq(gram + round_ * np.eye(len(used)), aim, rcond=1e-12)[0]
        else:
            found = _descend(gram, aim, flat, round_)
        weights[used] = found * scale[-1] / scale[used]
    return Line(weights, float(mean[-1] - mean[:-1] @ weights))


def _descend(gram: np.ndarray, aim: np.ndarray, flat: float, round_: float) -> np.ndarray:
    """Coordinate descent: each weight in turn takes its best value given the others."""
    found = np.zeros(len(aim))
    rest = aim.copy()
    for _ in range(SWEEPS):
        most = 0.0
        for i in range(len(aim)):
            own = rest[i] + gram[i, i] * found[i]
            new = np.sign(own) * max(abs(own) - flat, 0.0) / (gram[i, i] + round_)
            step = new - found[i]
            if step:
                rest -= gram[:, i] * step
                found[i] = new
                most = max(most, abs(step))
        if most < SETTLED:
            break
    return found


def judged(state: Moments, line: Line) -> dict[str, float]:
    """r2 and rmse of a model on the rows of a state, without reading them; r2 is NaN for a constant target."""
    rows = max(state.n[-1, -1], 1)
    mean = np.diag(state.mean)
    signs = np.append(-line.coefficients, 1.0)
    off = mean[-1] - mean[:-1] @ line.coefficients - line.intercept
    error = max(float(signs @ state.cross @ signs), 0.0) + rows * off * off
    spread = float(state.cross[-1, -1])
    return {"r2": 1 - error / spread if spread > 0 else float("nan"), "rmse": float(np.sqrt(error / rows))}


@dataclass(frozen=True)
class Search:
    """Settings with their mean r2 over the folds, the best one first in the grid's order, and its model on all rows."""

    rows: list[dict]
    best: dict
    line: Line
    train: dict[str, float]

    def board(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(r["regParam"], r["elasticNetParam"], r["r2"], r is self.best) for r in self.rows],
            "regParam double, elasticNetParam double, r2 double, best boolean",
        )


def search(states: Mapping[object, Moments], grid: Mapping[str, Sequence[float]] | None = None) -> Search:
    """Cross-validation from one state per fold: each fold is judged by the model of all others."""
    grid = grid or GRIDS["LinearRegression"]
    if len(states) < 2:
        raise ValueError("cross-validation takes at least two folds with rows")
    folds = list(states.values())
    others = [Moments.total(s for j, s in enumerate(folds) if j != i) for i in range(len(folds))]
    rows = []
    for reg, elastic in product(grid.get("regParam", [0.0]), grid.get("elasticNetParam", [0.0])):
        scores = [judged(fold, fit(other, reg, elastic))["r2"] for fold, other in zip(folds, others)]
        rows.append({"regParam": float(reg), "elasticNetParam": float(elastic), "r2": float(np.mean(scores))})
    best = max(rows, key=lambda r: r["r2"])
    whole = Moments.total(folds)
    line = fit(whole, best["regParam"], best["elasticNetParam"])
    return Search(rows, best, line, judged(whole, line))


def fold_states(df: DataFrame, features: Sequence[str] | str, target: str, fold: str) -> dict:
    """One state per value of ``fold``; ``features`` are columns or one array column. Rows without a target are left out."""
    rows = df.where(F.col(target).isNotNull())
    if isinstance(features, str):
        both = F.concat(F.col(features), F.array(F.col(target).cast("double"))).alias("_values")
        return collected(comoment_states(rows.select(fold, both), ["_values"], fold))
    return collected(comoment_states(rows, [*features, target], fold))


def assembled(df: DataFrame, stages: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``features`` of fitted feature stages as an array."""
    return stages.transform(df).select(*keep, vector_to_array("features").alias("features"))
