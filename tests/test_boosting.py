"""Boosted trees against a booster written out on lists."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import ml
from barspark.operators.boosting import LEAST, BoostedTrees, Tree

SCHEMA = "features array<double>, label double, weight double"


def table(n: int, width: int = 4, missing: float = 0.1, seed: int = 7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [round(rng.gauss(0, 1), 1) for _ in range(width - 1)]
        x.append(x[0])  # a feature twice: ties
        y = float(x[0] + 0.5 * x[1] * x[2] + rng.gauss(0, 0.5) > 0.3)
        rows.append(([None if rng.random() < missing else v for v in x], y, rng.choice([1.0, 2.5])))
    return rows


def plain_booster(rows, cuts, rounds, depth, rate, l2, gamma, min_child, start=0.0):
    """[(splits, leaves)] by nested loops over every split of every node."""
    margin, out = [start] * len(rows), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [w * (q - y) for q, (_, y, w) in zip(p, rows, strict=True)]
        h = [w * q * (1 - q) for q, (_, _, w) in zip(p, rows, strict=True)]
        nodes, splits, leaves = {1: list(range(len(rows)))}, {}, {}
        worth = lambda own: sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + l2)
        for node in range(1, 2 ** (depth + 1)):
            if node not in nodes:
                continue
            own, best = nodes[node], None
            for f, cut in ((f, c) for f in range(len(cuts)) for c in [*cuts[f], math.inf]):
                if node >= 2**depth:
                    break
                for missing_left in (False, True):
                    left = [i for i in own if (missing_left if rows[i][0][f] is None else rows[i][0][f] < cut)]
                    right = sorted(set(own) - set(left))
                    if not left or not right or min(sum(h[i] for i in left), sum(h[i] for i in right)) < min_child:
                        continue
                    gain = worth(left) + worth(right) - worth(own)
                    if gain > LEAST and gain >= gamma and (best is None or gain > best[0] + 1e-7):
                        best = gain, f, cut, missing_left, left, right
            if best:
                splits[node] = best[1:4]
                nodes[2 * node], nodes[2 * node + 1] = best[4:]
            else:
                leaves[node] = -rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + l2)
                for i in own:
                    margin[i] += leaves[node]
        out.append((splits, leaves))
    return out, margin


@pytest.mark.parametrize("kw", [{"cut": 1}, {"gamma": 2.0, "min_child": 15.0, "l2": 0.5, "rate": 1.0}])
def test_trees_are_those_of_a_plain_booster(spark, kw):
    rows = table(500)
    p = {"rounds": 2, "depth": 3, "rate": 0.3, "l2": 1.0, "gamma": 0.0, "min_child": 1.0} | kw
    model = BoostedTrees(**p, bins=12).fit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want, margin = plain_booster(rows, [c.tolist() for c in model.cuts], *[p[k] for k in ("rounds", "depth", "rate", "l2", "gamma", "min_child")])
    for tree, (splits, leaves) in zip(model.trees, want, strict=True):
        # where no value is missing the sides of missing values tie, and cuts between which no row lies tie too
        assert set(tree.splits) == set(splits) and {n: s[0] for n, s in tree.splits.items()} == {n: s[0] for n, s in splits.items()}
        assert {n: round(v, 7) for n, v in tree.leaves.items()} == {n: round(v, 7) for n, v in leaves.items()}
    got = model.transform(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {SCHEMA}")).orderBy("i").collect()
    assert np.allclose([r["score"] for r in got], margin, atol=1e-6)
    assert all(r["prediction"] == float(m > 0) and abs(r["probability_1"] - 1 / (1 + math.exp(-m))) < 1e-6 for r, m in zip(got, margin, strict=True) if abs(m) > 1e-6)


def test_fits_do_not_depend_on_partitions_or_passes(spark, monkeypatch):
    from barspark.operators import boosting

    rows = spark.createDataFrame(table(300, 6), SCHEMA)
    kw = {"rounds": 2, "depth": 3, "bins": 16, "subsample": 0.7, "columns": 0.5, "min_child": 0.1}
    first = BoostedTrees(**kw).fit(rows.repartition(7)).table()
    assert first == BoostedTrees(**kw, cut=1).fit(rows.coalesce(1).orderBy(F.rand(3))).table()
    monkeypatch.setattr(boosting, "CELLS", 120)  # two nodes a pass
    assert first == BoostedTrees(**kw).fit(rows.repartition(3)).table()
    assert first != BoostedTrees(**kw | {"seed": 1}).fit(rows).table()


def model_gain(model):
    return sum(model.importance().values())


def test_edges(spark):
    rows = table(60)
    df = spark.createDataFrame(rows, SCHEMA)
    empty = BoostedTrees(rounds=2).fit(df.where("false"))
    assert empty.trees == [] and {r["score"] for r in empty.transform(df).collect()} == {0.0}
    flat = BoostedTrees(rounds=2, depth=0, base=0.3).fit(df)
    assert all(t.splits == {} and list(t.leaves) == [1] for t in flat.trees) and len({r["score"] for r in flat.transform(df).collect()}) == 1
    same = BoostedTrees(rounds=2).fit(df.withColumn("features", F.array(F.lit(1.0), F.lit(None).cast("double"))))
    assert all(t.splits == {} for t in same.trees)
    assert model_gain(flat) == 0.0
    with_gaps = df.unionByName(spark.createDataFrame([([1.0] * 4, None, 1.0)], SCHEMA))
    small = {"rounds": 1, "depth": 1}
    assert BoostedTrees(**small).fit(with_gaps).table() == BoostedTrees(**small).fit(df).table()
    for bad in ({"base": 1.0}, {"bins": 1}, {"subsample": 0.0}, {"columns": 1.5}, {"rounds": -1}):
        with pytest.raises(ValueError):
            BoostedTrees(**bad)
    with pytest.raises(ValueError):
        ml.extreme_boosting({"max_leaves": 3}, df)


def test_tree_walks_bins_and_values_alike():
    tree = Tree(splits={1: (0, 1, 2.0, True), 3: (1, 0, 5.0, False)}, leaves={2: -1.0, 6: 0.5, 7: 2.0})
    x = np.array([[1.0, 9.0], [2.0, 4.0], [2.0, 5.0], [np.nan, 5.0], [3.0, np.nan]])
    bins = np.array([[1, 1], [2, 0], [2, 1], [-1, 1], [2, -1]], dtype=np.int16)
    assert tree.values(x).tolist() == tree.values_of_bins(bins).tolist() == [-1.0, 0.5, 2.0, -1.0, 2.0]


def test_as_a_candidate_of_grid_search(spark):
    """Positives weigh n0 / n1 of the rows that are fitted; the usual names are taken; a model finds what the labels follow."""
    rows = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(table(600, missing=0.0))], "i int, features array<double>, label double")
    train, val = rows.where("i < 400"), rows.where("i >= 400")
    grid = {"n_estimators": [2], "max_depth": [1, 2], "learning_rate": [0.5]}
    model, best, f1 = ml.grid_search(ml.extreme_boosting, grid, train, val)
    assert f1 > 0.6 and best["n_estimators"] == 2 and len(model.trees) == 2 and model_gain(model) > 0
    ratio = rows.where("label = 0").count() / rows.where("label = 1").count()
    direct = ml.extreme_boosting(best | {"scale_pos_weight": ratio}, rows).fit(rows)
    assert direct.table() == model.table()
