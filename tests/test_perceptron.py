"""The perceptron against a run on one table in numpy, and its early stop."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barspark.operators import ml
from barspark.operators.perceptron import Perceptron, build, forward, gradients

SCHEMA = "features array<double>, label double"


def table(n: int, seed: int):
    rng = random.Random(seed)
    points = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(n)]
    return [(x, float(x[0] * x[1] > 0.1)) for x in points]


@pytest.mark.parametrize("activation", ["relu", "tanh", "logistic"])
def test_gradients_are_those_of_differences(activation):
    rng = np.random.default_rng(1)
    layers = Perceptron((4, 3), activation).initial(3)
    x, y = rng.normal(size=(20, 3)), (rng.random(20) > 0.4).astype(float)
    loss, grad = gradients(layers, x, y, activation)
    for k in range(3):
        for part in (0, 1):
            at = tuple(rng.integers(0, n) for n in layers[k][part].shape)
            before = layers[k][part][at]
            layers[k][part][at] = before + 1e-6
            higher = gradients(layers, x, y, activation)[0]
            layers[k][part][at] = before
            assert abs((higher - loss) / 1e-6 - grad[k][part][at]) < 1e-3


@pytest.mark.parametrize("activation,early", [("relu", True), ("tanh", False)])
def test_training_is_that_of_one_table(spark, activation, early):
    df = spark.createDataFrame(table(200, 2), SCHEMA).repartition(3)
    model = Perceptron((5,), activation, alpha=0.5, rate=0.05, epochs=3, steps=2, early=early, held_out=0.2).fit(df)
    rows = model.dealt(df).collect()
    parts = sorted({r["part"] for r in rows})
    assert (parts == [-1, 0, 1]) == early
    w1, b1 = model.initial(3)[0]
    w2, b2 = model.initial(3)[1]
    theta, m, v, t, scores = [w1, b1, w2, b2], [0.0] * 4, [0.0] * 4, 0, []
    act = {"relu": lambda z: np.maximum(z, 0), "tanh": np.tanh}[activation]
    slope = {"relu": lambda a: (a > 0) * 1.0, "tanh": lambda a: 1 - a**2}[activation]
    kept = []
    for _ in range(3):
        for part in (0, 1):
            x, y = (np.array([r[c] for r in rows if r["part"] == part]) for c in ("x", "y"))
            h = act(x @ theta[0] + theta[1])
            d = 1 / (1 + np.exp(-(h @ theta[2] + theta[3])[:, 0])) - y
            back = d[:, None] @ theta[2].T * slope(h)
            grad = [x.T @ back + 0.5 * theta[0], back.sum(axis=0), h.T @ d[:, None] + 0.5 * theta[2], d.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grad):
                g = g / len(y)
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
        kept.append([a.copy() for a in theta])
        if early:
            x, y = (np.array([r[c] for r in rows if r["part"] == -1]) for c in ("x", "y"))
            scores.append((((act(x @ theta[0] + theta[1]) @ theta[2] + theta[3])[:, 0] > 0) == (y > 0)).mean())
    want = kept[int(np.argmax(scores))] if early else theta
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip([p for pair in model.layers for p in pair], want, strict=True))
    assert np.allclose(model.scores, scores) and len(model.losses) == 3
    got = model.transform(df).collect()
    assert np.allclose([r["score"] for r in got], forward(model.layers, np.array([r["features"] for r in got]), activation)[-1][:, 0])


def test_it_stops_early(spark):
    df = spark.createDataFrame(table(120, 5), SCHEMA).coalesce(1)
    model = Perceptron((2,), rate=1e-9, epochs=50, steps=1, patience=2).fit(df)  # nothing is learned
    assert len(model.scores) == 3 and model.scores[0] == model.scores[-1]


def test_edges_and_grid_search(spark):
    df = spark.createDataFrame(table(90, 7), SCHEMA)
    assert Perceptron((2,), epochs=2).fit(df.where("false")).losses == []
    for bad in ({"activation": "sine"}, {"steps": 0}, {"held_out": 1.0}, {"hidden": (0,)}):
        with pytest.raises(ValueError):
            Perceptron(**bad)
    with pytest.raises(ValueError):
        build({"solver": "sgd"}, df)
    grid = {"hidden_layer_sizes": [(3,)], "alpha": [1e-4, 1e-3], "max_iter": [1], "steps": [1], "early_stopping": [False]}
    model, best, f1 = ml.grid_search(build, grid, df, df)
    assert best["alpha"] in (1e-4, 1e-3) and len(model.losses) == 1 and 0 <= f1 <= 1
