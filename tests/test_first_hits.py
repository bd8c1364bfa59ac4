"""First hits by range extremes against a loop, and on one long session."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest

from barspark.operators import labels

BARS = "symbol string, timestamp timestamp_ntz, high double, low double, close double"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 500])
def test_first_reach(n):
    rng = random.Random(n)
    values = np.array([rng.choice([rng.randint(0, 20), math.nan]) for _ in range(n)], dtype=float)
    start = np.arange(n) + 2
    for horizon in (1, 2, 3, 17, n):
        end = np.maximum(np.minimum(n, start + horizon), start)
        level = np.array([rng.randint(5, 22) for _ in range(n)], dtype=float)
        got = labels.first_reach(labels.range_maxima(values, max(1, min(horizon, n))), start, end, level)
        want = [next((j for j in range(s, e) if values[j] >= v), e) for s, e, v in zip(start, end, level, strict=True)]
        assert got.tolist() == want


def test_memory_is_n_log_n():
    n = 100_000
    rng = np.random.default_rng(1)
    high = 100 + np.cumsum(rng.normal(0, 0.05, n))
    tracemalloc.start()
    start, end = np.arange(n) + 2, np.maximum(np.full(n, n), np.arange(n) + 2)
    got = labels.first_reach(labels.range_maxima(high, n), start, end, high * 1.02)
    assert tracemalloc.get_traced_memory()[1] < 8 * n * (math.log2(n) + 12)
    tracemalloc.stop()
    for i in rng.integers(0, n - 3, 200):
        hit = np.flatnonzero(high[i + 2 :] >= high[i] * 1.02)
        assert got[i] == (i + 2 + hit[0] if len(hit) else n)


def loop(rows, tp, sl, horizon):
    """(label, exit kind, gross return) of each bar of one session."""
    out, n = [], len(rows)
    for i in range(n):
        end = n if horizon is None else min(n, i + 2 + horizon)
        if i >= n - 3 or rows[i + 1][0] <= 0:
            out.append((0, -1, None))
            continue
        e = rows[i + 1][0]
        up = next((j for j in range(i + 2, end) if rows[j][0] >= e * (1 + tp)), None)
        down = next((j for j in range(i + 2, end) if rows[j][1] <= e * (1 - sl)), None)
        label = int(up is not None and (down is None or up < down))
        if down is not None and (up is None or down <= up):
            out.append((label, 1, e * (1 - sl) / e - 1))
        elif up is not None:
            out.append((label, 0, e * (1 + tp) / e - 1))
        else:
            out.append((label, 2, rows[end - 1][1] / e - 1))
    return out


@pytest.mark.parametrize("horizon", [None, 1, 4])
def test_labels_of_many_sessions(spark, horizon, monkeypatch):
    monkeypatch.setattr(labels, "_TOGETHER", 30)  # sessions cross batches
    rng = random.Random(3)
    days, rows = {}, []
    for symbol in ("A", "B", None):
        for day in range(1, 8):
            n, price, own = rng.choice([1, 2, 3, 4, 5, 40]), 100.0, []
            for m in range(n):
                price *= 1 + rng.gauss(0, 0.02)
                own.append((round(price * 1.01, 4), round(price * 0.99, 4)))
                rows.append((symbol, f"2025-01-0{day} 10:{m:02}:00", *own[-1], price))
            days[symbol, day] = own
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, BARS.replace("timestamp timestamp_ntz", "timestamp string")).withColumn("timestamp", labels.F.col("timestamp").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = labels.gross_return(labels.tp_before_sl(df, 0.02, 0.015, horizon), 0.02, 0.015, horizon).orderBy("timestamp").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for (symbol, day), own in days.items():
        mine = [r for r in got if r["symbol"] == symbol and r["timestamp"].day == day]
        want = loop(own, 0.02, 0.015, horizon)
        assert [(r["target"], r["exit_kind"]) for r in mine] == [w[:2] for w in want]
        assert all((r["gross_return"] is None) == (w[2] is None) and (w[2] is None or abs(r["gross_return"] - w[2]) < 1e-12) for r, w in zip(mine, want, strict=True))


def test_a_session_of_100_000_bars(spark):
    n = 100_000
    bars = spark.range(n).selectExpr("'A' AS symbol", "timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.5) AS timestamp", "100 + sin(id / 1000) + id % 7 / 100 AS high", "99 + sin(id / 1000) - id % 5 / 100 AS low", "100D AS close")
    r = labels.tp_before_sl(bars, 0.005, 0.02).agg(labels.F.sum("target"), labels.F.count("*")).first()
    assert r[1] == n and 0 < r[0] < n
    assert "_highs" not in labels.tp_before_sl(bars, 0.005, 0.02)._jdf.queryExecution().toString()
