"""Models: exact ones with SQL, fitted ones on Spark ML (rows only)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators import metrics, ml, splits
from barspark.plans import desk_queries as dq
from barspark.plans.bar_queries import rounded
from barspark.session import checkpointed

FEATURES = dq._FEATURES
QUERIES: dict = {}
ORACLE: dict = {}


@contextmanager
def tables(s: SparkSession, d: str) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """Scaled train, val and test rows with a features vector, cached while models are fitted.

    The training table is cached as well, since splitting and scaling read it five times, and it reads all ticks.
    """
    table = dq.fq.training_table(s, d).cache()
    data = None
    try:
        scaled = splits.zscore_splits(dq.split_rows(table), FEATURES).withColumnRenamed("move_target", "target")
        data = ml.assemble(scaled, FEATURES, weights=False).cache()
        yield tuple(data.where(F.col("split") == x) for x in ("train", "val", "test"))
    finally:
        if data is not None:
            data.unpersist()
        table.unpersist()


def fitted(build, params: dict, train: DataFrame):
    """The model of ``train`` with the weights of just these rows."""
    rows = ml.weighed(build, train)
    return build(params, rows).fit(rows)


def now(report: DataFrame) -> DataFrame:
    """A report of a few rows, evaluated here, while what it stands on is cached."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def _report(preds: DataFrame) -> DataFrame:
    return rounded(metrics.rates(metrics.confusion(preds.select(F.col("label").alias("y"), F.col("prediction").alias("pred")))), *dq._RATES)


def _fitted(build, **params):
    def query(s: SparkSession, d: str) -> DataFrame:
        with tables(s, d) as (train, _, test):
            return now(_report(fitted(build, params, train).transform(test)))

    return query


def fourier_svm(s: SparkSession, d: str) -> DataFrame:
    with tables(s, d) as splits_:
        train, _, test = (ml.fourier_features(t, len(FEATURES)) for t in splits_)
        return now(_report(fitted(ml.linear_svc, {"C": 0.1}, train).transform(test)))


def _sweep(build, thresholds: list[float]):
    def query(s: SparkSession, d: str) -> DataFrame:
        with tables(s, d) as (train, val, _):
            scored = ml.positive_scores(fitted(build, {"C": 0.1}, train).transform(val)).select(F.col("label").alias("y"), "score")
            return now(rounded(metrics.threshold_sweep(scored, thresholds, dq.TP, dq.SL, dq.COST, 20), *dq._RATES, *dq._PNL))

    return query


def grid_search_refit(s: SparkSession, d: str) -> DataFrame:
    with tables(s, d) as (train, val, test):
        model, best, value = ml.grid_search(ml.decision_tree, {"max_depth": [2, 4], "min_samples_leaf": [1, 20]}, train, val, n_jobs=2)
        report = now(_report(model.transform(test)))
    return report.withColumn("max_depth", F.lit(best["max_depth"])).withColumn("val_score", F.lit(round(value, 6)))


def ensemble(s: SparkSession, d: str) -> DataFrame:
    with tables(s, d) as (train, _, test):
        models = [fitted(b, {}, train) for b in (ml.decision_tree, ml.logistic_regression, ml.gradient_boosting)]
        return now(rounded(metrics.consensus_report(ml.vote(test.select("features", F.col("label").cast("int").alias("y")), models)), *dq._SHARES, *dq._RATES))


def kmeans(s: SparkSession, d: str) -> DataFrame:
    with tables(s, d) as (train, _, test):
        return checkpointed(ml.kmeans_distances(train.select("features"), test.select("symbol", "timestamp", "features")).drop("features"))


def gmm(s: SparkSession, d: str) -> DataFrame:
    with tables(s, d) as (train, _, test):
        return checkpointed(ml.gmm_probabilities(train.select("features"), test.select("symbol", "timestamp", "features")).drop("features"))


def _plain(s: SparkSession, d: str) -> DataFrame:
    """Raw features cut to 6 digits, so that both engines start from the same doubles."""
    return rounded(dq.split_table(s, d), *FEATURES).withColumnRenamed("move_target", "target")


_ROWS = f"SELECT symbol, timestamp, split, move_target AS target, {', '.join(f'{dq.r6(f)} AS {f}' for f in FEATURES)} FROM ({dq._SPLIT})"


def gnb(s: SparkSession, d: str) -> DataFrame:
    t = _plain(s, d)
    return ml.gaussian_nb(t.where("split = 'train'"), t.where("split = 'test'").select("symbol", "timestamp", *FEATURES), FEATURES).select("symbol", "timestamp", "pred")


_LL = "ln(c.n / c.total)" + "".join(f" - 0.5 * ln(2 * pi() * (v_{f} + 1e-9 * top)) - (r.{f} - m_{f}) * (r.{f} - m_{f}) / (2 * (v_{f} + 1e-9 * top))" for f in FEATURES)
_GNB = f"""WITH r AS ({_ROWS}), g AS (SELECT count(*) AS total, greatest({', '.join(f'var_pop({f})' for f in FEATURES)}) AS top FROM r WHERE split = 'train'),
c AS (SELECT target, count(*) AS n, {', '.join(f'avg({f}) AS m_{f}, var_pop({f}) AS v_{f}' for f in FEATURES)}, any_value(total) AS total, any_value(top) AS top FROM r, g WHERE split = 'train' GROUP BY target),
l AS (SELECT r.symbol, r.timestamp, c.target, {_LL} AS ll FROM r, c WHERE split = 'test')
SELECT symbol, timestamp, arg_max(target, ll) AS pred FROM l GROUP BY ALL"""


SMOOTHINGS = [1e-9, 0.1, 1.0]


def grid_search_nb(s: SparkSession, d: str) -> DataFrame:
    """Grid search over an exact model: the winner on val, refitted on train and val, reported on test."""
    t = _plain(s, d).withColumn("label", F.col("target").cast("double")).cache()
    train, val, test = (t.where(F.col("split") == x) for x in ("train", "val", "test"))
    build = lambda p, data: ml.NaiveBayes(FEATURES, p["smoothing"])
    try:
        model, best, value = ml.grid_search(build, {"smoothing": SMOOTHINGS}, train, val)
        report = now(_report(model.transform(test)))
    finally:
        t.unpersist()
    return report.withColumn("smoothing", F.lit(best["smoothing"])).withColumn("val_score", F.lit(round(value, 6)))


def _nb_classes(name: str, where: str) -> str:
    return f"""g{name} AS (SELECT count(*) AS total, greatest({', '.join(f'var_pop({f})' for f in FEATURES)}) AS top FROM r WHERE {where}),
c{name} AS (SELECT target, count(*) AS n, {', '.join(f'avg({f}) AS m_{f}, var_pop({f}) AS v_{f}' for f in FEATURES)}, any_value(total) AS total, any_value(top) AS top FROM r, g{name} WHERE {where} GROUP BY target)"""


def _nb_preds(classes: str, where: str, candidates: str) -> str:
    return f"SELECT symbol, timestamp, y, smoothing, o, arg_max(target, ll) AS pred FROM (SELECT r.symbol, r.timestamp, r.target AS y, smoothing, o, c.target, {_LL.replace('1e-9', 'smoothing')} AS ll FROM r, {classes} c, {candidates} WHERE {where}) GROUP BY ALL"


_CANDIDATES = ", ".join(f"(CAST({x} AS DOUBLE), {i})" for i, x in enumerate(SMOOTHINGS))
_GRID_NB = f"""WITH r AS ({_ROWS}), k AS (SELECT * FROM (VALUES {_CANDIDATES}) AS v(smoothing, o)),
{_nb_classes('t', "split = 'train'")}, {_nb_classes('b', "split IN ('train', 'val')")},
w AS (SELECT smoothing, {dq._RATES['f1']} AS f1 FROM (SELECT smoothing, o, {dq._CONF} FROM ({_nb_preds('ct', "split = 'val'", 'k')}) GROUP BY ALL) ORDER BY f1 DESC, o LIMIT 1)
SELECT tp, fp, fn, tn, {dq._cols(dq._RATES)}, smoothing, round(f1, 6) AS val_score FROM (SELECT {dq._CONF} FROM ({_nb_preds('cb', "split = 'test'", '(SELECT smoothing, 0 AS o FROM w)')})), w"""


def knn(s: SparkSession, d: str) -> DataFrame:
    t = _plain(s, d).cache()
    try:
        return ml.knn(t.where("split = 'train'"), t.where("split = 'test'"), FEATURES, ["symbol", "timestamp"], 5)
    finally:
        t.unpersist()


_DIST = " + ".join(f"(q.{f} - r.{f}) * (q.{f} - r.{f})" for f in FEATURES)
_KNN = f"""WITH r AS ({_ROWS}), p AS (SELECT q.symbol, q.timestamp, r.target, row_number() OVER (PARTITION BY q.symbol, q.timestamp ORDER BY {_DIST}, concat_ws('|', r.symbol, strftime(r.timestamp, '%Y-%m-%d %H:%M:%S'))) AS k FROM r q, r WHERE q.split = 'test' AND r.split = 'train')
SELECT symbol, timestamp, CAST(sum(target) AS BIGINT) AS votes, CAST(sum(target) / 5 > 0.5 AS INTEGER) AS pred FROM p WHERE k <= 5 GROUP BY ALL"""

QUERIES |= {
    "gnb_predict": gnb,
    "knn_predict": knn,
    "grid_search_nb": grid_search_nb,
    "decision_tree": _fitted(ml.decision_tree, max_depth=4),
    "random_forest": _fitted(ml.random_forest, n_estimators=10),
    "gbt": _fitted(ml.gradient_boosting),
    "adaboost_samme": _fitted(ml.adaboost),
    "mlp": _fitted(ml.perceptron, hidden=(8,), max_iter=30),
    "logreg_sweep": _sweep(ml.logistic_regression, [0.3, 0.5, 0.7]),
    "linear_svc_sweep": _sweep(ml.linear_svc, [-0.5, 0.0, 0.5]),
    "rff_svm": fourier_svm,
    "kmeans_distance_features": kmeans,
    "gmm_proba_features": gmm,
    "grid_search_refit": grid_search_refit,
    "unanimous_ensemble": ensemble,
}
ORACLE |= {"gnb_predict": _GNB, "knn_predict": _KNN, "grid_search_nb": _GRID_NB}
