"""Nystroem features against the exact kernel."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barspark.operators import ml
from barspark.operators.kernels import KernelMachine, Nystroem, build, rbf, scale_gamma

SCHEMA = "features array<double>, label double"


def ring(n: int, seed: int):
    """Points inside and outside a circle: no line parts them."""
    rng = random.Random(seed)
    points = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(n)]
    return [(x, float(x[0] ** 2 + x[1] ** 2 > 1.4)) for x in points]


def test_the_error_falls_to_nothing(spark):
    rows = ring(300, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    x = np.array([r[0] for r in rows])
    gamma = scale_gamma(df)
    assert gamma == pytest.approx(1 / (2 * x.var()))
    exact, errors = rbf(x, x, gamma), []
    for m in (10, 40, 120, 300):
        kernel = Nystroem.fit(df, m)
        f = kernel.features(x)
        errors.append(np.abs(f @ f.T - exact).mean())
        assert len(kernel.landmarks) == m
    assert errors == sorted(errors, reverse=True) and all(e < most for e, most in zip(errors, (0.1, 0.002, 1e-4, 1e-8), strict=True))
    got = {tuple(r["was"]): r["features"] for r in Nystroem.fit(df, 40).transform(df.withColumn("was", df["features"])).collect()}
    f = Nystroem.fit(df.repartition(7), 40).features(x)
    assert all(np.allclose(got[tuple(p)], v) for p, v in zip(x.tolist(), f, strict=True))


def test_it_parts_what_no_line_parts(spark):
    train, test = (spark.createDataFrame(ring(n, n), SCHEMA) for n in (250, 120))
    right = lambda model: np.mean([r["prediction"] == r["label"] for r in model.transform(test).collect()])
    machine = KernelMachine(C=10.0, landmarks=60).fit(ml.balanced_weights(train, "label"))
    assert right(machine) > 0.93 and machine.transform(test).columns == [*test.columns, "score", "prediction"]
    model, best, f1 = ml.grid_search(build, {"C": [1.0], "gamma": ["scale", 1e-6], "landmarks": [30]}, train, test)
    assert best["gamma"] == "scale" and f1 > 0.9


def test_edges(spark):
    same = spark.createDataFrame([([1.0, 2.0], 1.0)] * 5 + [([1.0, 3.0], 0.0)] * 5, SCHEMA)
    assert len(Nystroem.fit(same, 50).landmarks) == 2 and scale_gamma(same.where("label = 5")) == 1.0
    for bad in ({"landmarks": 0}, {"gamma": 0}, {"gamma": "auto"}):
        with pytest.raises(ValueError):
            Nystroem.fit(same, **bad)
