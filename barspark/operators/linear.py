"""Linear classifiers as in the usual single-node libraries: squared hinge or logistic loss, an L2 penalty that the intercept shares.

The objective is (|w|^2 + b^2) / 2 + C * sum of c_i * loss(y_i * (w x_i + b)), with labels y of -1 and 1, row weights c and
loss max(0, 1 - m)^2 or log(1 + exp(-m)). It is strictly convex, and Newton's method finds its minimum: a round is one
pass in which tasks add up value, gradient and Hessian over Arrow batches (for p features p * (p + 3) / 2 + 1 numbers a
task), Spark adds the tasks' sums, and the driver solves a system of p equations. A step that does not lower the
objective enough is shortened by one more pass that tries many lengths at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.boosting import feature_array
from barspark.session import stages

_STEPS = 0.5 ** np.arange(1, 30)


def _losses(margin: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, first and second derivative of the loss at each margin."""
    if kind == "squared_hinge":
        gap = np.maximum(0.0, 1 - margin)
        return gap * gap, -2 * gap, np.where(gap > 0, 2.0, 0.0)
    p = np.exp(-np.logaddexp(0.0, margin))  # 1 / (1 + exp(m)), without overflow
    return np.logaddexp(0.0, -margin), -p, p * (1 - p)


class LinearModel:
    """``loss``: squared_hinge or logistic. ``fit`` takes features (vector or array, without nulls), label (0 or 1) and weight; ``transform`` adds score, prediction and (logistic) probability_1."""

    def __init__(self, loss: str = "squared_hinge", C: float = 1.0, rounds: int = 100, tol: float = 1e-9) -> None:
        if loss not in ("squared_hinge", "logistic") or C <= 0:
            raise ValueError("the loss is squared_hinge or logistic, C above 0")
        self.loss, self.C, self.rounds, self.tol = loss, C, rounds, tol

    def fit(self, data: DataFrame) -> LinearModel:
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) if "weight" in data.columns else F.lit(1.0)
        rows = data.where("label IS NOT NULL").select(F.concat(feature_array(data), F.array(F.lit(1.0))).alias("x"), F.when(F.col("label") > 0, 1.0).otherwise(-1.0).alias("y"), weight.alias("c"))
        with stages(data.sparkSession) as keep:
            rows = keep(rows)
            width = rows.agg(F.max(F.size("x"))).first()[0] or 1
            at, self.passes = np.zeros(width), 0
            value, slope, bend = self._sums(rows, at)
            start = max(1.0, np.abs(slope).max())
            for _ in range(self.rounds):
                if np.abs(slope).max() <= self.tol * start:
                    break
                way = -np.linalg.solve(bend, slope)
                gain, old = float(slope @ way), value
                found = self._sums(rows, at + way)
                if found[0] > old + 1e-4 * gain:
                    values = self._values(rows, at, way)
                    good = np.flatnonzero(values <= old + 1e-4 * _STEPS * gain)
                    if not len(good):
                        break  # no digit is left to gain
                    way = _STEPS[good[0]] * way
                    found = self._sums(rows, at + way)
                at, (value, slope, bend) = at + way, found
        self.coefficients, self.intercept, self.objective = at[:-1], float(at[-1]), value
        return self

    def _total(self, rows: DataFrame, run, size: int) -> np.ndarray:
        """The sum of the tasks' arrays of ``size`` numbers."""
        self.passes += 1
        got = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect()
        out = np.zeros(size)
        for r in got:
            out[r[0]] = r[1]
        return out

    def _sums(self, rows: DataFrame, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and Hessian of the objective."""
        p, kind = len(at), self.loss
        upper = np.triu_indices(p)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, slope, bend = 0.0, np.zeros(p), np.zeros((p, p))
            for x, y, c in _batches(batches, p):
                loss, first, second = _losses(y * (x @ at), kind)
                value += float(c @ loss)
                slope += x.T @ (c * y * first)
                bend += (x * (c * second)[:, None]).T @ x
            yield _numbers(np.concatenate([[value], slope, bend[upper]]))

        total = self._total(rows, run, 1 + p + len(upper[0]))
        bend = np.zeros((p, p))
        bend[upper] = total[1 + p :]
        bend = np.triu(bend) + np.triu(bend, 1).T
        return float(at @ at) / 2 + self.C * total[0], at + self.C * total[1 : 1 + p], np.eye(p) + self.C * bend

    def _values(self, rows: DataFrame, at: np.ndarray, way: np.ndarray) -> np.ndarray:
        """The objective along ``way`` at all of the step lengths."""
        p, kind = len(at), self.loss

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(_STEPS))
            for x, y, c in _batches(batches, p):
                here, along = y * (x @ at), y * (x @ way)
                out += [float(c @ _losses(here + t * along, kind)[0]) for t in _STEPS]
            yield _numbers(out)

        there = at[None, :] + _STEPS[:, None] * way[None, :]
        return (there * there).sum(axis=1) / 2 + self.C * self._total(rows, run, len(_STEPS))

    def transform(self, data: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        dot = F.aggregate(F.zip_with(feature_array(data), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        out = data.withColumn("score", dot + F.lit(self.intercept)).withColumn("prediction", (F.col("score") > 0).cast("double"))
        return out.withColumn("probability_1", 1 / (1 + F.exp(-F.col("score")))) if self.loss == "logistic" else out


def _batches(batches: Iterable[pa.RecordBatch], p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, p)
            yield x, batch.column("y").to_numpy(), batch.column("c").to_numpy()


def _numbers(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "v"])


def threshold_grid(train: DataFrame, parts: dict[str, DataFrame], grid: Sequence[tuple[float, bool]], thresholds: Sequence[float], sweep, loss: str = "logistic", strict: bool = False) -> DataFrame:
    """One row per (C, balanced, threshold) with the figures of each of ``parts`` (name -> rows) as columns name_figure, the best first.

    A model is fitted for each pair of ``grid`` on ``train`` (features, label), with balanced class weights or none; the
    logistic loss is cut at probabilities, the other at scores, by ``>=`` unless ``strict``. ``sweep`` maps (y, score),
    thresholds and strict to figures per threshold, as ``metrics.threshold_sweep`` does; the order is that of the first
    part's profit, precision and number of trades.
    """
    from functools import reduce

    from barspark.operators.splits import balanced_weights

    plain = train.drop("weight")
    balanced = balanced_weights(plain, "label")
    rows: list[DataFrame] = []
    for c, even in grid:
        model = LinearModel(loss, c).fit(balanced if even else plain)
        tables = []
        for name, part in parts.items():
            scored = model.transform(part).select(F.col("label").alias("y"), F.col("probability_1" if loss == "logistic" else "score").alias("score"))
            figures = sweep(scored, list(thresholds), strict)
            tables.append(figures.select("threshold", *[F.col(f).alias(f"{name}_{f}") for f in figures.columns if f != "threshold"]))
        joined = reduce(lambda a, b: a.join(F.broadcast(b), "threshold"), tables)  # a row per threshold
        rows.append(joined.select(F.lit(float(c)).alias("C"), F.lit(bool(even)).alias("balanced"), *joined.columns))
    first = next(iter(parts))
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc(f"{first}_profit"), F.desc(f"{first}_precision"), f"{first}_n_trades", "C", "balanced", "threshold")


def build(loss: str):
    """A builder for ``ml.grid_search``: parameters C, max_iter and tol."""

    def make(p: dict[str, Any], data: DataFrame) -> LinearModel:
        return LinearModel(loss, p.get("C", 1.0), p.get("max_iter", 100), p.get("tol", 1e-9))

    return make
