"""Hand-computed micro frames for the bar engine."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barspark.functions import scalars
from barspark.operators import backtest, calendar, clean, cross, features, labels, metrics, ml, splits, validate
from barspark.operators.recursive import recursive_features
from barspark.sources import bars as source
from barspark.sources import rest
from barspark.streaming.live_bars import live_bars

NTZ = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume bigint, trade_count bigint, vwap double"


def frame(spark, rows, start="2025-01-02 09:31", symbol="AAPL"):
    """rows: (high, low, close[, volume]) a minute apart; a str starts a new day."""
    out, at = [], datetime.fromisoformat(start)
    for r in rows:
        if isinstance(r, str):
            at = datetime.fromisoformat(r)
            continue
        h, lo, c, *v = (float(x) for x in r)
        n = int(v[0]) if v else 100
        out.append((symbol, at, c, h, lo, c, n, n, c))
        at += timedelta(minutes=1)
    return spark.createDataFrame(out, NTZ)


def values(df, name):
    return [r[name] for r in df.orderBy("symbol", "timestamp").collect()]


def closes(spark, cs, **kw):
    return frame(spark, [c if isinstance(c, str) else (c, c, c) for c in cs], **kw)


def volumes(spark, vs):
    return frame(spark, [v if isinstance(v, str) else (1, 1, 1, v) for v in vs])


def hl(spark, highs, lows):
    return frame(spark, [(h, lo, (h + lo) / 2) for h, lo in zip(highs, lows, strict=True)])


@pytest.mark.parametrize(
    ("highs", "lows", "horizon", "want"),
    [
        ((100.5, 102, 103.1, 103), (99.5, 99.5, 101, 102), None, [1, 0, 0, 0]),
        ((100.5, 100, 100.5, 100.5), (99.5, 99.5, 98, 99), None, [0, 0, 0, 0]),
        ((100.5,) * 4, (99.5,) * 4, None, [0, 0, 0, 0]),
        ((100.5, 102, 103.1, 103), (99.5, 99, 100, 101), None, [0, 0, 0, 0]),
        ((100.5, 100.5, 101, 101.5, 102.02), (99.5, 99.5, 100, 100.5, 101), None, [1, 1, 0, 0, 0]),
        ((100.5, 100.5, 101, 101.5, 102.02), (99.5, 99.5, 100, 100.5, 101), 2, None),
        ((1, 0, 1, 1), (0, 0, 0, 0), None, [0, 0, 0, 0]),
        ((100.5, 102, 103.02, 104, 104), (99.5, 99.5, 101, 103, 103), None, [1, 0, 0, 0, 0]),
    ],
)
def test_tp_before_sl(spark, highs, lows, horizon, want):
    got = values(labels.tp_before_sl(hl(spark, highs, lows), 0.01, 0.01, horizon), "target")
    assert got == want if want else got[0] == 0


def test_labels_stay_in_their_session(spark):
    df = frame(spark, [(100, 99, 99.5), "2025-01-03 09:31", (100.5, 99.5, 100), (102, 99.5, 101), (103.1, 101, 102), (103, 102, 103)], "2025-01-02 15:59")
    assert values(labels.tp_before_sl(df, 0.01, 0.01), "target") == [0, 1, 0, 0, 0]
    far = frame(spark, [(101, 99, 100), "2025-01-03 09:31", (110, 99, 100)], "2025-01-02 16:00")
    assert values(labels.absolute_move(far, 0.05, 10), "move_target") == [0, 0]


def test_moves(spark):
    up, down = [(101, 99, 100), (105, 99, 102)], [(101, 99, 100), (101, 94, 98)]
    assert values(labels.absolute_move(frame(spark, up), 0.03, 5), "move_target") == [1, 0]
    assert values(labels.absolute_move(frame(spark, down), 0.03, 5), "move_target")[0] == 1
    for rows, thr, want in ((up, 0.03, (1, 1)), (down, 0.03, (1, 0)), ([(101, 99, 100)] * 2, 0.05, (0, None)), ([(101, 99, 100), (110, 99, 105), (102, 88, 95)], 0.03, (1, 1))):
        r = labels.direction(frame(spark, rows), thr, 5).orderBy("timestamp").first()
        assert (r["move_eligible"], r["move_direction"]) == want
    df = hl(spark, (100.5, 102, 103.1, 103, 104), (99.5, 99.5, 101, 102, 97))
    assert values(labels.touched(df, 0.01, 0.01), "range_target")[0] == 1
    r = labels.gross_return(df, 0.01, 0.01).orderBy("timestamp").first()
    assert r["exit_kind"] == 0 and math.isclose(r["gross_return"], 0.01)
    low = labels.gross_return(df, 0.01, 0.01, entry="low").orderBy("timestamp").first()
    assert low["exit_kind"] == 0
    with pytest.raises(ValueError):
        labels.gross_return(df, 0.01, 0.01, 0)


def test_session_features(spark):
    four = closes(spark, [1, 2, 3, 4])
    assert values(features.bars_until_close(four), "bars_until_close") == [3, 2, 1, 0]
    assert values(features.bars_since_open(four), "bars_since_open") == [0, 1, 2, 3]
    p = features.pct_change(closes(spark, [100, 102, 101]), [1])
    assert values(p, "pct_change_1") == pytest.approx([0, 0.02, -1 / 102])
    assert values(features.pct_change(closes(spark, [100, "2025-01-03 09:31", 200, 202]), [1]), "pct_change_1") == pytest.approx([0, 0, 0.01])
    z = features.rolling_zscore(volumes(spark, [100, 100, 100, 1000]), ["volume", "trade_count"], 3)
    assert values(z, "volume_zscore_3") == pytest.approx([0, 0, 0, 1.41421356]) and values(z, "trade_count_zscore_3")[3] == pytest.approx(1.41421356)
    assert values(features.rolling_zscore(volumes(spark, [1, 2, "2025-01-03 09:31", 10, 20]), ["volume"], 2), "volume_zscore_2")[2:] == pytest.approx([0, 1])
    assert values(features.volume_roll_mean(volumes(spark, [10, 30, 50]), [2]), "volume_roll_mean_2") == [0, 20, 40]
    with pytest.raises(ValueError):
        features.rolling_zscore(four, ["volume"], 0)


def test_history_features(spark):
    assert values(features.close_sma(closes(spark, [100, 100, 110]), [2, 1]), "close_sma_2_pct_diff") == pytest.approx([0, 0, 5 / 105])
    assert values(features.close_sma(closes(spark, [100, 105]), [1]), "close_sma_1_pct_diff") == [0, 0]
    v = closes(spark, [101, 99, 100]).withColumn("vwap", F.when(F.col("close") == 100, 0.0).otherwise(100.0))
    assert values(features.close_bar_vwap(v), "close_vwap_pct_diff") == pytest.approx([0.01, -0.01, 0])
    assert values(features.day_of_week(closes(spark, [1], start="2025-01-06 10:00")), "day_of_week") == [1]
    assert values(features.day_of_week(closes(spark, [1], start="2025-01-05 10:00")), "day_of_week") == [7]
    utc = closes(spark, [1], start="2025-01-06 04:00").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert values(features.day_of_week(utc), "day_of_week") == [7]
    assert scalars.std_tag(1.0) == "1std" and scalars.std_tag(1.5) == "1p5std"


def test_recursive_features(spark):
    df = frame(spark, [(101, 99, 100), (100.5, 99.5, 100), (102, 99, 101)])
    assert values(features.true_range(df), "true_range") == [2, 1, 3]
    assert values(recursive_features(df, atr=[3]), "atr_3") == [0, 0, 2]
    assert values(recursive_features(df, atr=[2]), "atr_2") == [0, 1.5, 2.25]
    assert values(recursive_features(frame(spark, [(101, 99, 100), "2025-01-03 09:31", (105, 98, 102)]), atr=[1]), "atr_1") == [2, 7]
    assert values(recursive_features(closes(spark, [100, 101, 102]), rsi=[2]), "rsi_2") == [0, 0, 100]
    assert values(recursive_features(closes(spark, [100, 101]), rsi=[14]), "rsi_14") == [0, 0]
    flat = closes(spark, [100, 100, 100])
    assert values(recursive_features(flat, rsi=[2]), "rsi_2")[2] == 50 and values(recursive_features(flat, rsi=[2], flat=100.0), "rsi_2")[2] == 100
    assert values(recursive_features(closes(spark, [100, 110]), ema=[1]), "close_ema_1_pct_diff") == [0, 0]
    with pytest.raises(ValueError):
        recursive_features(flat, rsi=[1])


def test_reference_symbols(spark):
    main, spy, qqq = closes(spark, [100, 101]), closes(spark, [200, 202], symbol="SPY"), closes(spark, [300, 303], symbol="QQQ")
    got = cross.close_vs_reference(main, spy.union(qqq), ["SPY", "QQQ"])
    assert values(got, "close_SPY_pct_diff") == pytest.approx([-0.5, -0.5]) and values(got, "close_QQQ_pct_diff")[1] == pytest.approx((101 - 303) / 303)
    assert values(cross.close_vs_reference(main, spy.limit(1), ["SPY"]), "close_SPY_pct_diff") == pytest.approx([-0.5, 0])
    assert cross.close_vs_reference(main, spy, []).columns == main.columns


def day(spark, first=date(2024, 1, 1), last=date(2024, 1, 8)):
    return calendar.nyse_sessions(spark, first, last)


def bars_at(spark, *times, close=100.0):
    return spark.createDataFrame([("A", datetime.fromisoformat(t), close + i, close + i, close + i, close + i, 5, 5, close + i) for i, t in enumerate(times)], NTZ)


def test_calendar(spark):
    s = calendar.nyse_sessions(spark, date(2022, 1, 1), date(2025, 12, 30))
    assert s.count() == 1002 and s.where("early").count() == 9 and calendar.rth_grid(s).count() == 390162
    assert calendar.rth_grid(day(spark), clip=("2024-01-02 14:35:00", "2024-01-02 14:39:00")).count() == 5
    assert scalars.timeframe(3, "Month") == timedelta(days=90)
    with pytest.raises(ValueError):
        scalars.timeframe(1, "Year")


def test_cleaning(spark):
    kept = clean.remove_closed_market_rows(bars_at(spark, "2024-01-02 14:30", "2024-01-02 22:00", "2024-01-06 14:30", "2024-01-02 14:30:15", "2024-01-02 21:00"), day(spark))
    assert sorted(r["timestamp"].hour for r in kept.collect()) == [14, 21]
    gap = clean.forward_propagate(bars_at(spark, "2024-01-02 14:30", "2024-01-02 14:32"), "1 minute", day(spark))
    assert values(gap, "close") == [100, 100, 101] and values(gap, "volume") == [5, 0, 5] and values(gap, "imputed") == [False, True, False]
    closed = clean.forward_propagate(bars_at(spark, "2024-01-06 14:30"), "1 minute", day(spark))
    assert values(closed, "imputed") == [False]


def test_validation(spark):
    good = bars_at(spark, "2024-01-02 14:30", "2024-01-02 14:31")
    validate.assert_clean(good)
    for bad, message in (
        (good.withColumn("open", F.lit(None).cast("double")), "open"), (good.withColumn("low", F.lit(500.0)), "low > high"), (good.drop("vwap"), "vwap"),
        (bars_at(spark, "2024-01-02 14:30", "2024-01-02 14:32"), "Missing bar"), (bars_at(spark, "2024-01-02 14:30", "2024-01-02 14:30:30"), "closer than"),
    ):
        with pytest.raises(validate.InvalidDataException, match=message):
            validate.assert_clean(bad)
        assert not validate.check(bad)
    assert validate.check(bars_at(spark, "2024-01-02 21:00", "2024-01-03 14:30"), sessions=day(spark))
    assert not validate.check(bars_at(spark, "2024-01-02 14:30", "2024-01-02 14:32"), sessions=day(spark))
    assert validate.check(good.limit(0)) and validate.schema_errors(good, require_instant=True)
    with pytest.raises(ValueError, match="nope"):
        validate.require_columns(good, ["open", "nope"])


def test_splits_and_scaling(spark):
    df = spark.createDataFrame([("X", datetime(2025, 1, 2) + timedelta(minutes=i), float(i), i % 4 == 0) for i in range(100)], "symbol string, timestamp timestamp_ntz, a double, t boolean").withColumn("target", F.col("t").cast("int"))
    got = splits.chrono_split(df, 0.15, 0.2)
    assert {r[0]: (r[1], r[2]) for r in got.groupBy("split").agg(F.count("*"), F.min("a")).collect()} == {"train": (65, 0.0), "val": (15, 65.0), "test": (20, 80.0)}
    with pytest.raises(ValueError):
        splits.chrono_split(df.limit(10), 0.5, 0.5)
    z = splits.zscore_splits(got, ["a"]).where("split = 'train'").agg(F.avg("a"), F.stddev_pop("a")).first()
    assert z[0] == pytest.approx(0) and z[1] == pytest.approx(1)
    down = splits.downsample(df, "target", ["symbol", "timestamp"])
    assert down.where("target = 0").count() == down.where("target = 1").count() == 25
    assert splits.class_ratio(spark.createDataFrame([(1,), (1,), (0,), (0,), (0,)], "y int"), "y").first()["ratio"] == 1.5
    assert splits.class_ratio(spark.createDataFrame([(0,)], "y int"), "y").first()["ratio"] == 1.0
    assert metrics.confusion(df.select(F.lit(1).alias("y"), F.lit(1).alias("pred"))).first()["tp"] == 100
    assert scalars.min_win_rate(0.04, 0.02, 0.004) == pytest.approx(0.4) and scalars.min_win_rate(0.03, 0.02, 0.004) == pytest.approx(0.48)


def test_fees_and_ledger(spark):
    one = spark.range(1)
    up = lambda x: one.select(scalars.round_up_cent(F.lit(x))).first()[0]
    assert (up(0.001), up(1.101), up(0.011), up(1.10)) == (0.01, 1.11, 0.02, 1.11)
    fee = lambda side, n: one.select(scalars.regulatory_fee(F.lit(side), F.lit(n))).first()[0]
    assert (fee("buy", 10), fee("sell", 10)) == (0.01, 0.02) and 11.30 <= fee("sell", 100_000) <= 11.31
    b = bars_at(spark, "2025-01-02 14:30", "2025-01-02 14:31", "2025-01-02 14:32")
    o = spark.createDataFrame([("A", "buy", 10, "market", datetime(2025, 1, 2, 14, 30), 0), ("A", "sell", 5, "market", datetime(2025, 1, 2, 14, 30, 30), 1), ("A", "buy", 1, "limit", datetime(2025, 1, 2, 14, 30), 2)], "symbol string, side string, qty int, type string, submitted timestamp_ntz, seq int")
    free = lambda side, qty, price: F.lit(0.0)
    fills = backtest.market_fills(o, b, fee=free)
    book = {r["seq"]: (r["price"], r["cash"], r["position"]) for r in backtest.ledger(fills, 10_000.0).collect()}
    assert book == {0: (100.0, 9_000.0, 10), 1: (101.0, 9_505.0, 5)}
    r = backtest.average_cost(fills).first()
    assert (r["qty"], r["basis"], r["avg_price"]) == (5, 500, 100)
    assert [round(x["equity"], 6) for x in backtest.equity_curve(fills, b, 10_000.0).orderBy("timestamp").collect()] == [10_000, 10_010, 10_015]
    assert {r["seq"] for r in backtest.market_fills(o, b, 10.0).where("price > 100.09 AND price < 100.11").collect()} == {0}
    assert backtest.order_violations(o).count() == 1
    p = backtest.Portfolio(1_000)
    p.apply("A", "buy", 10, 100, 0)
    assert p.equity() == 1_000 and p.equity({"A": 120}) == 1_200
    with pytest.raises(ValueError, match="Cannot sell"):
        p.apply("A", "sell", 11, 110, 0)
    p.apply("A", "sell", 10, 110, 0)
    assert p.cash == 1_100 and not p.positions
    with pytest.raises(ValueError):
        backtest.Portfolio(-1)


def test_sources(spark, tmp_path):
    b = bars_at(spark, "2024-01-02 14:30", "2024-01-02 14:31")
    calls = []
    fetch = lambda: calls.append(1) or b
    for _ in range(2):
        assert source.read_through(spark, str(tmp_path / "cache"), fetch, lambda x: x).count() == 2
    assert len(calls) == 1
    source.write_csv(b, str(tmp_path / "csv"))
    assert source.read_csv(spark, str(tmp_path / "csv"), NTZ).count() == 2
    merged = source.merge_upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k int, v string"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c"), (3, None)]
    (tmp_path / "keys.json").write_text('{"api_key": "a", "api_secret": "b"}')
    assert rest.load_keys(str(tmp_path / "keys.json")) == ("a", "b") and rest.parse_day("2024-01-02") == datetime(2024, 1, 2)
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(ValueError):
        rest.load_keys(str(tmp_path / "none.json"))


def test_stream_and_batch_bars_agree(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 2, 14, 30, s), s, 100.0 + s, 1) for s in range(0, 60, 7)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq int, price double, size int")
    ticks.write.parquet(str(tmp_path / "ticks"))
    q = live_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").collect() == live_bars(ticks).collect()


def test_models(spark):
    rows = [(f"k{i}", float(i % 7), float(i % 5), int(i % 7 + i % 5 > 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, f1 double, f2 double, target int")
    data = ml.assemble(df, ["f1", "f2"]).cache()
    one = ml.grid_search(ml.decision_tree, {"max_depth": [1, 3]}, data, data)
    two = ml.grid_search(ml.decision_tree, {"max_depth": [1, 3]}, data, data, n_jobs=2)
    assert one[1:] == two[1:] and one[1] == {"max_depth": 3}
    with pytest.raises(ValueError):
        ml.grid_search(ml.decision_tree, {}, data, data)
    near = ml.knn(df, df, ["f1", "f2"], ["k"], k=1, block=16).join(df, "k")
    assert near.where("pred <> target").count() == 0
    for p, w in ((1, False), (2, True)):
        assert ml.knn(df, df, ["f1", "f2"], ["k"], k=3, p=p, weighted=w).count() == 80
