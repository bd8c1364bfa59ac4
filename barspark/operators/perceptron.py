"""A multilayer perceptron for binary labels: relu, tanh or logistic units, L2 penalty, Adam, early stopping.

Training is synchronous and data parallel. Rows are dealt once, by a hash, into the minibatches of an epoch, and a tenth
of them is held out; the table is written by minibatch, so a step reads its own rows alone. A step sends the
parameters with its tasks, which add up the gradient of their rows over Arrow batches (as many numbers as there are
parameters, from each task); Spark adds the tasks' sums and the driver makes the step. After each epoch one pass over
the held-out rows gives the accuracy that early stopping looks at.

A minibatch is a share of the table and not a number of rows: a cluster makes ``steps`` passes over its share of the
rows for an epoch, however many rows there are.
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

_ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(np.float64)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a)),
}

Layers = list[tuple[np.ndarray, np.ndarray]]


def forward(layers: Layers, x: np.ndarray, activation: str) -> list[np.ndarray]:
    """The values of each layer, the input first; the last is the score before the logistic link."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else _ACTIVATIONS[activation][0](z))
    return out


def gradients(layers: Layers, x: np.ndarray, y: np.ndarray, activation: str) -> tuple[float, Layers]:
    """Sum of the log loss over the rows, and of its gradients."""
    values = forward(layers, x, activation)
    score = values[-1][:, 0]
    loss = float(np.logaddexp(0.0, np.where(y > 0, -score, score)).sum())
    delta, out = (1 / (1 + np.exp(-score)) - y)[:, None], []
    for i in reversed(range(len(layers))):
        out.append((values[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = delta @ layers[i][0].T * _ACTIVATIONS[activation][1](values[i])
    return loss, out[::-1]


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for pair in layers for part in pair])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


class Perceptron:
    """``fit`` takes features (vector or array, scaled and without nulls) and label; ``transform`` adds score, probability_1 and prediction.

    ``alpha`` is the L2 penalty, ``rate`` Adam's first rate, ``steps`` the minibatches of an epoch. Training ends after
    ``epochs`` or, with ``early``, when the accuracy on the held-out share has not gained ``tol`` for ``patience``
    epochs; the best epoch's parameters stay.
    """

    def __init__(self, hidden: Sequence[int] = (100,), activation: str = "relu", alpha: float = 1e-4, rate: float = 1e-3, epochs: int = 500, steps: int = 8, early: bool = True, held_out: float = 0.1, patience: int = 10, tol: float = 1e-4, seed: int = 42) -> None:
        if activation not in _ACTIVATIONS or steps < 1 or not 0 < held_out < 1 or any(n < 1 for n in hidden):
            raise ValueError(f"the activation is one of {sorted(_ACTIVATIONS)}, steps are 1 at least, the held-out share lies between 0 and 1")
        self.hidden, self.activation, self.alpha, self.rate, self.epochs, self.steps = tuple(hidden), activation, alpha, rate, epochs, steps
        self.early, self.held_out, self.patience, self.tol, self.seed = early, held_out, patience, tol, seed

    def initial(self, width: int) -> Layers:
        rng, sizes = np.random.default_rng(self.seed), [width, *self.hidden, 1]
        top = 2.0 if self.activation == "logistic" else 6.0
        out = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            bound = np.sqrt(top / (a + b))
            out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
        return out

    def dealt(self, data: DataFrame) -> DataFrame:
        """(x, y, part): part -1 is held out, the others are minibatches; by a hash of the row, so that equal rows stay together."""
        rows = data.where("label IS NOT NULL").select(feature_array(data).alias("x"), (F.col("label") > 0).cast("double").alias("y"))
        draw = F.pmod(F.xxhash64("x", "y", F.lit(self.seed)), F.lit(1 << 20)) / float(1 << 20)
        batch = F.pmod(F.xxhash64("x", "y", F.lit(self.seed + 1)), F.lit(self.steps)).cast("int")
        return rows.withColumn("part", F.when(draw < (self.held_out if self.early else 0.0), -1).otherwise(batch))

    def fit(self, data: DataFrame) -> Perceptron:
        with stages(data.sparkSession) as keep:
            rows = keep(self.dealt(data), ["part"])
            sizes = {r["part"]: (r["n"], r["width"]) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).collect()}
            width = max((w for _, w in sizes.values()), default=0)
            self.layers, self.scores, self.losses = self.initial(max(width, 1)), [], []
            best, waited = (-np.inf, self.layers), 0
            first, second, t = np.zeros(_flat(self.layers).size), np.zeros(_flat(self.layers).size), 0
            for _ in range(self.epochs if any(p >= 0 for p in sizes) else 0):
                total = 0.0
                for part in sorted(p for p in sizes if p >= 0):
                    n = sizes[part][0]
                    loss, grad = self._step(rows.where(F.col("part") == part))
                    decay = _flat([(w, np.zeros_like(b)) for w, b in self.layers])
                    total += loss + self.alpha / 2 * float(decay @ decay)
                    grad, t = (grad + self.alpha * decay) / n, t + 1
                    first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
                    rate = self.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                    self.layers = _shaped(_flat(self.layers) - rate * first / (np.sqrt(second) + 1e-8), self.layers)
                self.losses.append(total / sum(n for p, (n, _) in sizes.items() if p >= 0))
                if self.early and -1 in sizes:
                    self.scores.append(self._right(rows.where("part = -1")) / sizes[-1][0])
                    now = self.scores[-1]
                else:
                    now = -self.losses[-1]
                waited = waited + 1 if now < best[0] + self.tol else 0
                if now > best[0]:
                    best = (now, self.layers)
                if waited >= self.patience:
                    break
            if self.early and self.scores:
                self.layers = best[1]
        return self

    def _step(self, rows: DataFrame) -> tuple[float, np.ndarray]:
        """Sums of loss and gradient of a minibatch."""
        layers, activation = self.layers, self.activation

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + _flat(layers).size)
            for x, y in _batches(batches, len(layers[0][0])):
                loss, grad = gradients(layers, x, y, activation)
                total += np.concatenate([[loss], _flat(grad)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "v"])

        out = np.zeros(1 + _flat(layers).size)
        for r in rows.select("x", "y").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
            out[r[0]] = r[1]
        return float(out[0]), out[1:]

    def _right(self, rows: DataFrame) -> int:
        layers, activation = self.layers, self.activation

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for x, y in _batches(batches, len(layers[0][0])):
                n += int(((forward(layers, x, activation)[-1][:, 0] > 0) == (y > 0)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return rows.select("x", "y").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def transform(self, data: DataFrame) -> DataFrame:
        layers, activation = self.layers, self.activation

        @F.pandas_udf("double")
        def score(x):
            import pandas as pd

            rows = np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1)
            return pd.Series(forward(layers, rows, activation)[-1][:, 0] if len(rows) else np.zeros(0))

        scored = data.withColumn("score", score(feature_array(data)))
        return scored.withColumns({"probability_1": 1 / (1 + F.exp(-F.col("score"))), "prediction": (F.col("score") > 0).cast("double")})


def _batches(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width), batch.column("y").to_numpy()


def build(p: dict[str, Any], data: DataFrame) -> Perceptron:
    """For ``ml.grid_search``, with the usual names of the parameters."""
    names = {"hidden_layer_sizes": "hidden", "activation": "activation", "alpha": "alpha", "learning_rate_init": "rate", "max_iter": "epochs", "early_stopping": "early", "validation_fraction": "held_out", "n_iter_no_change": "patience", "tol": "tol", "random_state": "seed", "steps": "steps"}
    unknown = set(p) - set(names)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return Perceptron(**{names[k]: v for k, v in p.items()})
