"""Affine scans by blocks, what stands on them, and the average-cost mark, against loops."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import backtest, cross
from barspark.operators.recursive import recursive_features
from barspark.operators.clean import forward_propagate
from barspark.operators.scans import affine_scan, block_places, composed, nearest_known


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_composed():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        a, b, fresh = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), rng.random(n) < 0.2
        got_a, got_b = composed(a, b, fresh)
        pa, pb = np.ones(3), np.zeros(3)
        for i in range(n):
            pa, pb = (a[i], b[i]) if fresh[i] else (a[i] * pa, a[i] * pb + b[i])
            assert np.allclose(got_a[i], pa) and np.allclose(got_b[i], pb)


def history(symbols, n, seed=4, nan_at=None):
    """Irregular times over several days, unsorted."""
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        t = datetime(2025, 1, 1)
        for i in range(n):
            t += timedelta(minutes=rng.choice([1, 7, 300, 2000]))
            rows.append((s, t, rng.uniform(-1.2, 1.1), math.nan if (s, i) == nan_at else rng.gauss(0, 1)))
    rng.shuffle(rows)
    return rows


def test_affine_scan(spark, small_batches):
    rows = history(["A", "B", None], 60, nan_at=("B", 31))
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, a double, b double")
    got = affine_scan(df, {"x": (F.col("a"), F.col("b")), "n": (F.lit(1), F.lit(1))}, ["s"], ["t"], F.to_date("t"), before={"x": "was"}).collect()
    assert len(got) == len(rows)
    for s in ("A", "B", None):
        x = 0.0
        for i, (_, t, a, b) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1])):
            r = next(r for r in got if r["s"] == s and r["t"] == t)
            old, x = x, a * x + b
            assert r["n"] == i + 1
            assert (math.isnan(x) and math.isnan(r["x"])) or math.isclose(r["x"], x, abs_tol=1e-9)
            assert (math.isnan(old) and math.isnan(r["was"])) or math.isclose(r["was"], old, abs_tol=1e-9)
    assert affine_scan(df.where("false"), {"x": (F.col("a"), F.col("b"))}, ["s"], ["t"], F.to_date("t")).count() == 0


def test_block_places(spark):
    rows = history(["A", None], 40)
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, a double, b double")
    got = {(r["s"], r["t"]): (r["k"], r["last"]) for r in block_places(df, ["s"], ["t"], F.to_date("t"), {"last": F.col("a")}, "k").collect()}
    for s in ("A", None):
        old = None
        for i, (_, t, a, _) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1])):
            assert got[s, t] == (i, old)
            old = a


def plain_wilder(x, p):
    out = [0.0] * len(x)
    for i in range(len(x)):
        if i == p - 1:
            out[i] = sum(x[:p]) / p
        elif i >= p:
            out[i] = (out[i - 1] * (p - 1) + x[i]) / p
    return out


def test_recursive_features_are_those_of_a_loop(spark, small_batches):
    rng = random.Random(6)
    rows, price = [], 100.0
    for i in range(90):
        price *= 1 + rng.gauss(0, 0.02)
        rows.append(("A", datetime(2025, 1, 1) + timedelta(hours=5 * i), price * (1 + rng.random() / 50), price * (1 - rng.random() / 50), price))
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, high double, low double, close double").orderBy(F.rand(1))
    got = recursive_features(df, atr=[1, 7], adx=[5], rsi=[4], ema=[6], flat=100.0).orderBy("timestamp").collect()
    high, low, close = ([r[i] for r in rows] for i in (2, 3, 4))
    tr = [h - x if i == 0 else max(h - x, abs(h - close[i - 1]), abs(x - close[i - 1])) for i, (h, x) in enumerate(zip(high, low, strict=True))]
    up = [0.0] + [high[i] - high[i - 1] for i in range(1, 90)]
    down = [0.0] + [low[i - 1] - low[i] for i in range(1, 90)]
    plus = plain_wilder([u if u > d and u > 0 else 0.0 for u, d in zip(up, down, strict=True)], 5)
    minus = plain_wilder([d if d > u and d > 0 else 0.0 for u, d in zip(up, down, strict=True)], 5)
    t5 = plain_wilder(tr, 5)
    di = [(100 * a / t, 100 * b / t) if t else (0.0, 0.0) for a, b, t in zip(plus, minus, t5, strict=True)]
    adx = plain_wilder([100 * abs(a - b) / (a + b) if a + b else 0.0 for a, b in di], 5)
    change = [close[i] - close[i - 1] for i in range(1, 90)]
    gain, loss = (plain_wilder([max(s * c, 0.0) for c in change], 4) for s in (1, -1))
    rsi = [0.0] * 4 + [100 - 100 / (1 + g / s) if s else 100.0 for g, s in zip(gain[3:], loss[3:], strict=True)]
    e, ema = close[0], []
    for i, c in enumerate(close):
        e += 2 / 7 * (c - e)
        ema.append((c - e) / e if i >= 5 else 0.0)
    want = {"atr_1": tr, "atr_7": plain_wilder(tr, 7), "plus_di_5": [d[0] for d in di], "minus_di_5": [d[1] for d in di], "adx_5": adx, "rsi_4": rsi, "close_ema_6_pct_diff": ema}
    for name, values in want.items():
        assert np.allclose([r[name] for r in got], values, atol=1e-9), name


def test_a_missing_price_and_other_names(spark):
    rows = [("A", datetime(2025, 1, 1 + i), 2.0 + i, 1.0, None if i == 5 else 1.5 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, high double, low double, close double")
    got = recursive_features(df, atr=[2], rsi=[3], name="f_{}_{}".format).orderBy("timestamp").collect()
    assert not any(math.isnan(r["f_atr_2"]) for r in got[:6]) and all(math.isnan(r["f_atr_2"]) and math.isnan(r["f_rsi_3"]) for r in got[6:])
    assert cross.close_vs_reference(df, df, ["A"], "vs_{}".format).columns[-1] == "vs_A"
    assert cross.reference_rsi(df, df, ["A"], 3, name="r_{}_{}".format).columns[-1] == "r_A_3"


def test_a_history_spreads_over_tasks(spark):
    """One symbol, many days: the rows are dealt by day, and no window runs over the symbol's rows."""
    df = spark.range(2000).selectExpr("'A' AS symbol", "timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, id) AS timestamp", "101D + id % 3 AS high", "99D AS low", "100D + id % 2 AS close")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [n for n in recursive_features(df, atr=[14]).rdd.glom().map(len).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 2000 and max(sizes) < 1200 and len(sizes) > 1


FILLS = "symbol string, side string, qty int, filled timestamp_ntz, price double, fee double, seq int"


def replay(fills, bars, cash):
    """Equity at each bar time and the basis after each fill, by the portfolio that keeps a dictionary."""
    book, curve, basis = backtest.Portfolio(cash), {}, {}
    todo = sorted(fills, key=lambda f: (f[3], f[6]))
    for t in sorted({b[1] for b in bars}):
        while todo and todo[0][3] <= t:
            s, side, qty, _, price, fee, seq = todo.pop(0)
            book.apply(s, side, qty, price, fee)
            basis[seq] = (book.position(s).quantity, book.position(s).cost_basis)
        curve[t] = book.equity({b[0]: b[2] for b in bars if b[1] == t})
    return curve, basis


def test_equity_marks_at_cost_without_a_bar(spark):
    at = [datetime(2025, 1, 2, 15, m) for m in range(3)]
    fills = [("B", "buy", 10, at[0], 40.0, 0.0, 0)]
    bars = [("A", at[0], 7.0), ("B", at[0], 50.0), ("A", at[1], 8.0), ("A", at[2], 9.0), ("B", at[2], 60.0)]
    got = backtest.equity_curve(spark.createDataFrame(fills, FILLS), spark.createDataFrame(bars, "symbol string, timestamp timestamp_ntz, close double"), 1000.0)
    assert [r["equity"] for r in got.orderBy("timestamp").collect()] == [1100.0, 1000.0, 1200.0] == list(replay(fills, bars, 1000.0)[0].values())


def test_equity_and_basis_are_those_of_a_replay(spark, small_batches):
    rng = random.Random(8)
    times = [datetime(2025, 1, 1) + timedelta(hours=9 * i) for i in range(60)]
    bars = [(s, t, round(rng.uniform(90, 110), 2)) for t in times for s in "ABC" if rng.random() < 0.7]
    held, fills = dict.fromkeys("ABC", 0), []
    for i, t in enumerate(sorted(rng.choices([b[1] for b in bars], k=150))):
        s = rng.choice("ABC")
        side = "sell" if held[s] and rng.random() < 0.5 else "buy"
        qty = rng.randint(1, held[s]) if side == "sell" and rng.random() < 0.7 else held[s] if side == "sell" else rng.randint(1, 9)
        held[s] += qty if side == "buy" else -qty
        fills.append((s, side, qty, t, rng.uniform(90, 110), rng.choice([0.0, 0.01]), i))
    curve, basis = replay(fills, bars, 5000.0)
    df = spark.createDataFrame(fills, FILLS)
    got = {r["timestamp"]: r["equity"] for r in backtest.equity_curve(df, spark.createDataFrame(bars, "symbol string, timestamp timestamp_ntz, close double"), 5000.0).collect()}
    assert set(got) == set(curve) and all(math.isclose(got[t], curve[t], abs_tol=1e-6) for t in curve)
    rows = backtest.cost_basis(df).collect()
    assert len(rows) == 150 and all(r["position"] == basis[r["seq"]][0] and math.isclose(r["basis"], basis[r["seq"]][1], abs_tol=1e-6) for r in rows)


def test_nearest_known(spark):
    rng = random.Random(3)
    rows = [(s, t, rng.choice([None, None, None, i]), rng.choice([None, f"v{i}"])) for i, (s, t, _, _) in enumerate(history(["A", None], 70))]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, a int, b string")
    got = nearest_known(df, ["s"], ["t"], F.to_date("t"), {"last_a": "a", "last_b": "b"}, {"next_a": "a"}).collect()
    assert len(got) == len(rows)
    for s in ("A", None):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for i, r in enumerate(own):
            mine = next(g for g in got if g["s"] == s and g["t"] == r[1])
            assert mine["last_a"] == next((x[2] for x in reversed(own[: i + 1]) if x[2] is not None), None)
            assert mine["last_b"] == next((x[3] for x in reversed(own[: i + 1]) if x[3] is not None), None)
            assert mine["next_a"] == next((x[2] for x in own[i:] if x[2] is not None), None)


def test_fills_and_gaps_have_no_window_over_a_symbol(spark):
    """Orders find the next bar days later; a gap of days is filled; what is sorted per symbol is a row a day."""
    at = datetime(2025, 1, 6, 10)
    bars = spark.createDataFrame([("A", at, 1.0, 5), ("A", at + timedelta(days=3, hours=1), 2.0, 7)], "symbol string, timestamp timestamp_ntz, close double, volume long")
    orders = spark.createDataFrame([("A", "buy", 1, "market", at + timedelta(minutes=1), 0), ("A", "buy", 1, "market", at, 1), ("A", "buy", 1, "market", at + timedelta(days=9), 2), ("B", "buy", 1, "market", at, 3)], "symbol string, side string, qty int, type string, submitted timestamp_ntz, seq int")
    fills = backtest.market_fills(orders, bars)
    assert sorted((r["seq"], r["price"], r["filled"]) for r in fills.collect()) == [(0, 2.0, at + timedelta(days=3, hours=1)), (1, 1.0, at)]
    whole = forward_propagate(bars, "1 hour")
    got = whole.orderBy("timestamp").collect()
    assert [r["close"] for r in got] == [1.0] * 73 + [2.0] and [r["volume"] for r in got] == [5] + [0] * 72 + [7]
    for df in (fills, whole):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x]
        assert windows and all("_scan_block" in x for x in windows)
