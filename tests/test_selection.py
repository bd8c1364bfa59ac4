"""Quantiles and quota samples by digits."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import selection, splits


def test_bits_follow_the_order_of_doubles():
    x = np.array([-math.inf, -1e300, -2.5, -1e-310, 0.0, 1e-310, 1.0, np.nextafter(1.0, 2), 7e200, math.inf, math.nan])
    bits = selection.ordered_bits(x)
    assert (bits[1:] > bits[:-1]).all() and np.array_equal(selection.doubles(bits), x, equal_nan=True)
    assert selection.ordered_bits(np.array([-0.0]))[0] == selection.ordered_bits(np.array([0.0]))[0]
    assert selection.ordered_bits(-np.array([math.nan]))[0] == bits[-1]


@pytest.mark.parametrize("few", [10_000, 3, 0])
def test_quantiles(spark, few):
    rng = random.Random(few)
    values = [rng.choice([rng.gauss(0, 1e-3), rng.gauss(5, 1), 2.5, -1e9, None]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    known = sorted(v for v in values if v is not None)
    shares = [0.0, 0.25, 0.5, 1.0]
    assert np.allclose(selection.exact_quantiles(df, "v", shares, few), np.quantile(known, shares), rtol=1e-15, atol=0)
    one = spark.createDataFrame([(4,), (None,)], "v int")
    assert selection.exact_median(one, "v") == 4.0 and selection.exact_median(one.where("v IS NULL"), "v") is None
    with pytest.raises(ValueError):
        selection.exact_quantiles(df, "v", [1.5])


def test_equal_values_and_nan(spark):
    same = spark.range(300).select(F.when(F.col("id") < 290, 1.25).otherwise(float("nan")).alias("v"))
    assert selection.exact_quantiles(same, "v", [0.1, 0.5], 5) == [1.25, 1.25] and math.isnan(selection.exact_quantiles(same, "v", [1.0], 5)[0])


@pytest.mark.parametrize("few,width", [(10_000, 3), (5, 1), (0, 2)])
def test_smallest_digests(spark, few, width):
    df = spark.range(400).select("id", (F.col("id") % 3 == 0).alias("ok"))
    digest = F.md5(F.col("id").cast("string"))
    rows = sorted((r["h"], r["id"]) for r in df.where("ok").select(digest.alias("h"), "id").collect())
    for keep in (0, 1, 50, 134, 200):
        got = selection.with_smallest(df, digest, keep, F.col("ok"), ["id"], few, width)
        assert got.count() == 400 and {r["id"] for r in got.where("_in").collect()} == {i for _, i in rows[:keep]}


def test_repeated_keys_are_cut_too(spark):
    df = spark.createDataFrame([(1, 0)] * 30 + [(2, 1)] * 10, "k int, y int")
    got = splits.downsample(df, "y", ["k"])
    assert sorted((r["k"], r["count"]) for r in got.groupBy("k").count().collect()) == [(1, 10), (2, 10)]
