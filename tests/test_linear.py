"""Newton linear models against a dense solver, and the threshold grid against a loop."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from barspark.operators import metrics, ml
from barspark.operators.linear import LinearModel, build, threshold_grid

SCHEMA = "features array<double>, label double, weight double"


def table(n: int, seed: int, spread: float = 1.0):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.gauss(0, spread), rng.gauss(1, 2), rng.gauss(-3, 0.5)]
        rows.append((x, float(x[0] - 0.5 * x[1] + rng.gauss(0, 1) > 0.2), rng.choice([0.5, 1.0, 3.0])))
    return rows


def objective(rows, c, kind, at):
    total = sum(v * v for v in at) / 2
    for x, label, w in rows:
        m = (1 if label else -1) * (sum(a * b for a, b in zip(x, at, strict=False)) + at[-1])
        total += c * w * (max(0.0, 1 - m) ** 2 if kind == "squared_hinge" else math.log1p(math.exp(-m)) if m > -500 else -m)
    return total


def dense(rows, c, kind):
    """Gradient descent with halved steps and numeric checks left out: the objective at its minimum, slowly but surely."""
    x = np.array([[*r[0], 1.0] for r in rows])
    y, w = np.array([1.0 if r[1] else -1.0 for r in rows]), np.array([r[2] for r in rows])
    at = np.zeros(4)
    smooth = 1 + c * (2 if kind == "squared_hinge" else 0.25) * np.linalg.eigvalsh((x * w[:, None]).T @ x).max()
    momentum, last = at.copy(), at.copy()
    for k in range(60_000):
        m = y * (x @ momentum)
        d = -2 * np.maximum(0, 1 - m) if kind == "squared_hinge" else -1 / (1 + np.exp(np.clip(m, -500, 500)))
        at = momentum - (momentum + c * x.T @ (w * y * d)) / smooth
        momentum, last = at + k / (k + 3) * (at - last) if k % 500 else at.copy(), at
    return objective(rows, c, kind, at)


@pytest.mark.parametrize("kind", ["squared_hinge", "logistic"])
@pytest.mark.parametrize("c", [0.01, 10.0])
def test_the_objective_is_that_of_a_dense_solver(spark, kind, c):
    rows = table(150, 3)
    model = LinearModel(kind, c).fit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    at = [*model.coefficients, model.intercept]
    mine = objective(rows, c, kind, at)
    assert math.isclose(mine, model.objective, rel_tol=1e-9) and abs(mine - dense(rows, c, kind)) < 1e-6 * mine
    got = model.transform(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [round(r["score"], 9) for r in got] == [round(sum(a * b for a, b in zip(x, at, strict=False)) + at[-1], 9) for x, _, _ in rows]
    assert all(r["prediction"] == float(r["score"] > 0) for r in got)
    assert model.passes < 25


def test_steps_are_shortened(spark):
    """Separable rows far from the origin with a high C: a full logistic step overshoots, yet the minimum is found."""
    rows = [([50.0 + i, -40.0, 3.0], float(i % 2), 1.0) for i in range(20)] + [([5.0, 900.0 * i, 1.0], 1.0, 1.0) for i in range(5)]
    model = LinearModel("logistic", 1e4).fit(spark.createDataFrame(rows, SCHEMA))
    base = objective(rows, 1e4, "logistic", [0.0] * 4)
    at = [*model.coefficients, model.intercept]
    rng = np.random.default_rng(1)
    assert model.objective < base and all(objective(rows, 1e4, "logistic", list(np.array(at) + rng.normal(0, 1e-4, 4))) >= model.objective * (1 - 1e-9) for _ in range(20))


def test_edges(spark):
    df = spark.createDataFrame(table(40, 1), SCHEMA)
    none = LinearModel().fit(df.where("false"))
    assert none.transform(df.where("false")).count() == 0 and none.intercept == 0
    gaps = df.unionByName(spark.createDataFrame([([1.0, 2.0, 3.0], None, 1.0)], SCHEMA))
    assert LinearModel().fit(gaps).objective == pytest.approx(LinearModel().fit(df).objective)
    one = LinearModel("logistic").fit(df.withColumn("label", df["label"] * 0))
    assert {r["prediction"] for r in one.transform(df).collect()} == {0.0}
    for bad in ({"loss": "hinge"}, {"C": 0.0}):
        with pytest.raises(ValueError):
            LinearModel(**bad)


def test_grid_search_and_threshold_grid(spark):
    train, val, test = (spark.createDataFrame(table(n, n), SCHEMA).drop("weight") for n in (120, 60, 61))
    model, best, f1 = ml.grid_search(build("logistic"), {"C": [0.01, 1.0]}, train, val)
    assert best["C"] in (0.01, 1.0) and 0 < f1 <= 1 and model.loss == "logistic"
    sweep = lambda scored, at, strict: metrics.threshold_sweep(scored, at, 0.03, 0.02, 0.004, strict=strict).select("threshold", "tp", "fp", "n_trades", "precision", "profit")
    grid = [(0.1, False), (0.1, True)]
    got = threshold_grid(train, {"val": val, "test": test}, grid, [0.3, 0.6], sweep).collect()
    assert [(-r["val_profit"], -r["val_precision"], r["val_n_trades"]) for r in got] == sorted((-r["val_profit"], -r["val_precision"], r["val_n_trades"]) for r in got) and len(got) == 4
    for c, even in grid:
        fitted = LinearModel("logistic", c).fit(ml.balanced_weights(train, "label") if even else train)
        for name, part in (("val", val), ("test", test)):
            rows = fitted.transform(part).collect()
            for t in (0.3, 0.6):
                r = next(r for r in got if (r["C"], r["balanced"], r["threshold"]) == (c, even, t))
                assert r[f"{name}_n_trades"] == sum(x["probability_1"] >= t for x in rows)
                assert r[f"{name}_tp"] == sum(x["probability_1"] >= t and x["label"] == 1 for x in rows)
