"""Pivot-pruned nearest neighbours against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barspark.operators import ml
from barspark.operators.neighbours import Cells, PivotIndex, distances, k_nearest

TRAIN, ASKED = "x array<double>, y long, t string", "key int, q array<double>"


def clustered(n: int, seed: int, spread: float = 0.05, centres: int = 25):
    rng = random.Random(seed)
    middle = [[rng.uniform(-10, 10) for _ in range(3)] for _ in range(centres)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(middle)] for _ in range(n)]


def brute(train, q, k, p):
    gap = lambda x: sum(abs(a - b) if p == 1 else (a - b) * (a - b) for a, b in zip(x, q, strict=True))
    return sorted((gap(x), t) for x, _, t in train)[:k]


@pytest.mark.parametrize("p,k,block,pivots", [(2, 5, 40, 16), (1, 3, 4096, 7), (2, 300, 64, 9)])
def test_same_as_all_pairs(spark, p, k, block, pivots):
    points = clustered(240, 1) + [[1.0, 1.0, 1.0]] * 40  # a hot point: ties by t
    train = [(x, i % 2, f"{i:04}") for i, x in enumerate(points)]
    asked = [(i, x) for i, x in enumerate(clustered(60, 1) + [[1.0, 1.0, 1.0], [50.0, 0.0, 0.0]])]
    got = {r["key"]: [(n["d"], n["t"]) for n in r["near"]] for r in k_nearest(spark.createDataFrame(train, TRAIN).repartition(3), spark.createDataFrame(asked, ASKED), 3, k, p, pivots, block).collect()}
    for i, q in asked:
        want = brute(train, q, k, p)
        assert [t for _, t in got[i]] == [t for _, t in want] and np.allclose([d for d, _ in got[i]], [d for d, _ in want])


def test_cells_rule_out_most_pairs(spark):
    """On clustered data, both passes together compare less than a tenth of all pairs."""
    train = spark.createDataFrame([(x, 0, str(i)) for i, x in enumerate(clustered(3000, 5, centres=60))], TRAIN)
    asked = spark.createDataFrame(list(enumerate(clustered(400, 5, centres=60))), ASKED)
    index = PivotIndex(train, 3, pivots=256)
    size = {c: int(n) for c, n in enumerate(index.cells.counts)}
    assert sum(size.values()) == 3000
    first = index.compare(index.visits(asked, 5, False), 5)
    bounded = asked.join(first.selectExpr("key", "sqrt(near[4].d) AS bound"), "key")
    pairs = sum(size[r["cell"]] for k in (False, True) for r in index.visits(bounded, 5, k).collect())
    assert pairs < 0.1 * 3000 * 400


def test_bounds_never_rule_out_a_neighbour():
    rng = np.random.default_rng(0)
    for p in (1, 2):
        x, pivots = rng.normal(size=(300, 4)), rng.normal(size=(11, 4))
        d = distances(x, pivots, p) if p == 1 else np.sqrt(distances(x, pivots, p))
        cell = d.argmin(axis=1)
        r = d[np.arange(300), cell]
        ring = lambda f, c: f(r[cell == c]) if (cell == c).any() else 0.0
        cells = Cells(pivots, np.bincount(cell, minlength=11), np.array([ring(np.min, c) for c in range(11)]), np.array([ring(np.max, c) for c in range(11)]), p)
        q = rng.normal(size=(50, 4))
        away = distances(q, x, p) if p == 1 else np.sqrt(distances(q, x, p))
        bound = np.sort(away, axis=1)[:, 6]
        seen = cells.within(q, bound)
        row, point = np.nonzero(away <= bound[:, None])
        assert seen[row, cell[point]].all()
        home = cells.home(q, 20)
        assert ((home * cells.counts).sum(axis=1) >= 20).all()


def test_edges(spark):
    few = spark.createDataFrame([([0.0, 0.0], 1, "a"), ([1.0, 0.0], 0, "b"), ([None, 1.0], 1, "c"), ([float("nan"), 1.0], 1, "d"), (None, 1, "e"), ([0.0], 1, "f")], TRAIN)
    asked = spark.createDataFrame([(1, [0.1, 0.0]), (2, [None, 0.0]), (3, None)], ASKED)
    got = k_nearest(few, asked, 2, 5).collect()
    assert [(r["key"], [n["t"] for n in r["near"]]) for r in got] == [(1, ["a", "b"])]
    assert k_nearest(few.where("false"), asked, 2, 5).count() == k_nearest(few, asked.where("false"), 2, 5).count() == 0
    with pytest.raises(ValueError):
        k_nearest(few, asked, 2, 0)


def test_votes(spark):
    rows = spark.createDataFrame([(1, 0.0, 1), (2, 0.1, 1), (3, 5.0, 0), (4, 5.1, 0), (5, 5.2, 1)], "k int, a double, target int")
    got = {r["k"]: (r["votes"], r["pred"]) for r in ml.knn(rows, rows, ["a"], ["k"], k=3).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (1, 0), 4: (1, 0), 5: (1, 0)}
    weighted = {r["k"]: r["pred"] for r in ml.knn(rows, rows, ["a"], ["k"], k=3, weighted=True).collect()}
    assert weighted == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}  # the row itself outweighs the others
