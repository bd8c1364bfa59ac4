"""Models against plain numpy, and the rules of weights, rows and workers."""

from __future__ import annotations

import json
import math
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barspark.functions import scalars
from barspark.operators import analysis, backtest, clean, cross, labels, ml, splits, validate
from barspark.sources import bars as source
from barspark.sources import rest
from barspark.plans.catalog import QUERIES
from tests.compare import SF


def points(n: int = 240, seed: int = 0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n // 3, 2)) for c, s in ((0, 0.5), (4, 1.0), (9, 0.3))])
    return x, (x[:, 0] > 3).astype(int)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = points()
    df = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, target int")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).withColumn("label", F.col("target").cast("double"))


def test_kmeans_distances(spark, frame):
    got = ml.kmeans_distances(frame.select("features"), frame, 3).orderBy("k").collect()
    x, _ = points()
    d = np.array([[r[f"dist_{i}"] for i in range(3)] for r in got])
    own = d.argmin(axis=1)
    centres = np.array([x[own == i].mean(axis=0) for i in range(3)])  # a centre is the mean of the points nearest to it
    assert np.allclose(d, np.linalg.norm(x[:, None] - centres[None], axis=2), atol=1e-6)


def test_spherical_mixture(spark, frame):
    x, _ = points()
    model = ml.SphericalMixture(3, rounds=40, tol=1e-9).fit(frame)
    # The same EM in numpy, from where the fit ended: one more round hardly moves it, and it found the three groups.
    logs = np.log(model.weights) - np.log(2 * math.pi * model.variances) - ((x[:, None] - model.means[None]) ** 2).sum(axis=2) / (2 * model.variances)
    r = np.exp(logs - logs.max(axis=1, keepdims=True))
    r /= r.sum(axis=1, keepdims=True)
    mass = r.sum(axis=0)
    means = r.T @ x / mass[:, None]
    variances = (r * ((x[:, None] - means[None]) ** 2).sum(axis=2)).sum(axis=0) / (2 * mass)
    assert np.allclose(means, model.means, atol=1e-3) and np.allclose(variances, model.variances, atol=1e-3) and np.allclose(mass / len(x), model.weights, atol=1e-3)
    assert np.allclose(sorted(np.sqrt(model.variances)), [0.3, 0.5, 1.0], atol=0.15)
    got = ml.gmm_probabilities(frame, frame, mixture=model).orderBy("k").collect()
    assert np.allclose([[g[f"gmm_{i}"] for i in range(3)] for g in got], r, atol=1e-9)


def test_boosting_keeps_its_weights(spark, frame):
    noisy = frame.withColumn("label", F.when(F.col("k") % 11 == 0, 1 - F.col("label")).otherwise(F.col("label"))).withColumn("weight", F.lit(1.0))
    model = ml.Boosted(rounds=5, depth=1, cut=2).fit(noisy)
    rows = noisy.select("k", "features", "label").cache()
    w = np.ones(rows.count())
    y = np.array([r["label"] for r in rows.orderBy("k").collect()])
    votes = np.zeros(len(y))
    for alpha, tree in model.trees:
        p = np.array([r["prediction"] for r in tree.transform(rows).orderBy("k").collect()])
        err = w[p != y].sum() / w.sum()
        assert math.isclose(alpha, math.log((1 - err) / err), rel_tol=1e-6)
        w *= np.exp(alpha * (p != y))
        votes += alpha * (2 * p - 1)
    assert len(model.trees) == 5
    assert np.allclose([r["score"] for r in model.transform(rows).orderBy("k").collect()], votes)


def test_weights_are_those_of_the_fitted_rows(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,), (None,)], "label double")
    got = sorted(((r["label"], r["weight"]) for r in splits.balanced_weights(df, "label").collect()), key=str)
    assert got == sorted([(0.0, 4 / 6), (0.0, 4 / 6), (0.0, 4 / 6), (1.0, 2.0), (None, None)], key=str)
    train, both = df.where("label IS NOT NULL"), df.where("label IS NOT NULL").unionByName(spark.createDataFrame([(1.0,)], "label double"))
    assert {r["weight"] for r in ml.weighed(ml.gradient_boosting, train).where("label = 1").collect()} == {3.0}
    assert {r["weight"] for r in ml.weighed(ml.gradient_boosting, both).where("label = 1").collect()} == {1.5}
    assert {r["weight"] for r in ml.weighed(ml.gradient_boosting, both).where("label = 0").collect()} == {1.0}
    assert [ml.workers(n, 8, 100) for n in (0, 1, 3, -1, -2, -20)] == [1, 1, 3, 8, 7, 1] and ml.workers(5, 8, 2) == 2


def test_naive_bayes_keeps_repeated_rows(spark, frame):
    x, y = points()
    rows = frame.select("a", "b").where("k < 3").unionAll(frame.select("a", "b").where("k < 1"))
    assert ml.gaussian_nb(frame, rows, ["a", "b"]).count() == 4
    got = {r["k"]: r["pred"] for r in ml.gaussian_nb(frame, frame.select("k", "a", "b"), ["a", "b"]).collect()}
    for i, p in enumerate(x):
        ll = [math.log((y == c).mean()) - 0.5 * sum(math.log(2 * math.pi * x[y == c, j].var()) + (p[j] - x[y == c, j].mean()) ** 2 / x[y == c, j].var() for j in range(2)) for c in (0, 1)]
        assert got[i] == int(ll[1] > ll[0])


def test_neighbours_in_blocks(spark, frame):
    x, y = points()
    got = {r["k"]: r["votes"] for r in ml.knn(frame, frame, ["a", "b"], ["k"], k=5, block=50).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(len(x)):
        assert got[i] == y[np.argsort(d[i], kind="stable")[:5]].sum()


def test_running_sums_have_no_one_task_window(spark):
    rows = [(i, datetime(2024, 1, 1 + i % 9, i % 24), float(i % 7), "x" if i % 2 else "y") for i in range(200)]
    fills = spark.createDataFrame([(s, "buy" if i % 3 else "sell", 1, t, p, 0.0, f"{i:05d}") for i, t, p, s in rows], "symbol string, side string, qty int, filled timestamp_ntz, price double, fee double, seq string")
    book = backtest.ledger(fills, 100.0)
    total = 100.0
    for r in sorted(book.collect(), key=lambda r: (r["filled"], r["seq"])):
        total += -r["price"] if r["side"] == "buy" else r["price"]
        assert math.isclose(r["cash"], total, abs_tol=1e-9)
    ids = backtest.with_ids(fills.select("seq"))
    assert {r["seq"]: r["order_id"] for r in ids.collect()} == {f"{i:05d}": f"sim-{i}" for i in range(200)}
    bars = spark.createDataFrame([("x", datetime(2024, 1, d, 5), 1.0 * d) for d in range(1, 9)], "symbol string, timestamp timestamp_ntz, close double")
    for df in (book, ids, backtest.equity_curve(fills, bars, 0.0)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # Windows over all rows stand on sums by block alone.
        assert plan.count("Exchange SinglePartition") <= 1


def test_small_rules(spark, tmp_path):
    assert [scalars.std_tag(k) for k in (1.0, 1.5, 2, 0.1 + 0.2)] == ["1std", "1p5std", "2std", "0p3std"]
    with pytest.raises(ValueError):
        scalars.std_tag(0)
    b = spark.createDataFrame([("A", datetime(2024, 1, 2, 14, 30), 1.0, 2.0, 0.5, 1.5, 1, 1, 1.2), ("A", datetime(2024, 1, 2, 14, 31), 1.0, 2.0, 0.5, 1.5, 1, 1, 1.2)], "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume bigint, trade_count bigint, vwap double")
    assert analysis.longest_session(b).first()[0] == 2 and analysis.longest_session(b, 0).first()[0] == 1 and analysis.longest_session(b, 390).first()[0] == 390
    assert clean.point_in_time(b, "2024-01-02 14:31:00", "A").count() == 1 and clean.point_in_time(b, "2024-01-02 14:31:00", "B").count() == 0
    utc = clean.to_utc(b, "America/New_York")
    assert dict(utc.dtypes)["timestamp"] == "timestamp" and utc.select(F.min(F.unix_micros("timestamp"))).first()[0] == 1704223800 * 10**6
    assert clean.to_utc(utc).schema == utc.schema
    with pytest.raises(ValueError):
        cross.close_vs_symbol(b, b, "B")
    moved = labels.eligible_rows(labels.direction(b, 0.1, 1))
    assert dict(moved.dtypes)["move_direction"] == "bigint" and "move_eligible" not in moved.columns
    assert labels.reachable_rows(b, 0.1, 0.1).columns == [*b.columns, "trade_date"]
    # Raw and clean pair: cleaned once, checked whenever it is read.
    source.write_csv(b, str(tmp_path / "raw"))
    calls = []
    keep = lambda x: calls.append(1) or x
    check = lambda x: validate.assert_clean(x)
    ntz = ", ".join(f"{c} {t}" for c, t in b.dtypes)
    for _ in range(2):
        assert source.validated_pair(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), keep, check, ntz).count() == 2
    assert calls == [1]
    source.write_csv(b.withColumn("low", F.lit(9.0)), str(tmp_path / "bad"))
    with pytest.raises(validate.InvalidDataException):
        source.validated_pair(spark, str(tmp_path / "bad"), str(tmp_path / "bad_clean"), keep, check, ntz)
    assert source.cache_path("root/", "p", "2024-01-01", "2024-02-01") == "root/p_2024-01-01_2024-02-01_clean"


class _Service(BaseHTTPRequestHandler):
    """Two pages of bars for a symbol; an overview where a function is asked for."""

    def do_GET(self):
        from urllib.parse import parse_qs, urlparse

        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        bar = lambda minute: {"t": f"2024-01-02T14:{minute}:00+00:00", "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10, "n": 2, "vw": 1.2}
        if "function" in q:
            out = {"Symbol": q["symbol"], "PERatio": "None", "Key": q.get("apikey"), "Deep": {"a": 1}}
        elif "page_token" in q:
            out = {"bars": [bar(32)]}
        else:
            out = {"bars": [bar(30), bar(31)], "next_page_token": "more"}
        body = json.dumps(out).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_rest_sources(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/bars"
        (tmp_path / "keys.json").write_text('{"key": "k", "secret": "s"}')
        for kind in (rest.RestBars, rest.RestQuotes):
            spark.dataSource.register(kind)
        bars = spark.read.format("rest_bars").options(url=url, symbols="A, B", start="2024-01-01", end="2024-02-01", key_file=str(tmp_path / "keys.json")).load()
        assert bars.groupBy("symbol").count().orderBy("symbol").collect() == [("A", 3), ("B", 3)]
        assert bars.agg(F.max("timestamp")).first()[0] == datetime(2024, 1, 2, 14, 32)
        quotes = spark.read.format("rest_quotes").options(url=url, symbols="A", function="OVERVIEW", key_file=str(tmp_path / "keys.json")).load()
        assert {r["field"]: r["value"] for r in quotes.collect()} == {"Symbol": "A", "PERatio": "None", "Key": "k", "Deep": '{"a": 1}'}
    finally:
        server.shutdown()


@pytest.mark.parametrize("name", ["gmm_proba_features", "kmeans_distance_features"])
def test_fitted_features_do_not_read_the_ticks_again(spark, name):
    got = QUERIES[name](spark, SF)
    assert not got.inputFiles() and got.count() == QUERIES["chrono_split"](spark, SF).where("split = 'test'").count()


def test_a_round_of_the_mixture_has_no_task_for_each_small_part(spark, frame):
    model = ml.SphericalMixture(3, rounds=2)
    asked, status = frame.repartition(100).cache(), spark.sparkContext.statusTracker()
    asked.count()
    spark.sparkContext.setJobGroup("mixture", "")
    model.fit(asked)
    stages = [s for j in status.getJobIdsForGroup("mixture") for s in status.getJobInfo(j).stageIds]
    tasks = [info.numTasks for s in sorted(stages) if (info := status.getStageInfo(s))]
    asked.unpersist()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < max(tasks[-2:]) <= 2 * spark.sparkContext.defaultParallelism
