"""Classifiers and feature transformers on Spark ML, grid search on a fixed validation split, and exact SQL models.

Where Spark ML lacks an option of the usual single-node libraries the nearest one is taken: gradient boosting for
extreme gradient boosting, hinge loss for squared hinge, random Fourier features for a kernel, no L2 term in the
perceptron. Class weights are those of the rows that are fitted: see :func:`weighed`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.metrics import confusion, rates
from barspark.operators.neighbours import neighbour_votes as knn  # noqa: F401  one of the models
from barspark.operators.splits import balanced_weights, positive_weights
from barspark.operators.boosting import BoostedTrees
from barspark.session import stages

SEED = 42


def assemble(frame: DataFrame, features: Sequence[str], label: str = "target", weights: bool = True) -> DataFrame:
    """(keys..., label, features vector[, balanced weight])."""
    out = VectorAssembler(inputCols=list(features), outputCol="features").transform(frame).withColumn("label", F.col(label).cast("double"))
    return balanced_weights(out, "label") if weights else out


def weighed(build: Callable, data: DataFrame) -> DataFrame:
    """``data`` with the weights that ``build`` wants for a fit on just these rows: balanced ones, or its ``weigh``."""
    return getattr(build, "weigh", balanced_weights)(data.drop("weight"), "label")


def decision_tree(p: dict[str, Any], data: DataFrame) -> Estimator:
    return DecisionTreeClassifier(maxDepth=min(p.get("max_depth", 5), 30), minInstancesPerNode=p.get("min_samples_leaf", 1), weightCol="weight", seed=SEED)


def random_forest(p: dict[str, Any], data: DataFrame) -> Estimator:
    return RandomForestClassifier(numTrees=p.get("n_estimators", 20), maxDepth=min(p.get("max_depth", 5), 30), weightCol="weight", seed=SEED)


def gradient_boosting(p: dict[str, Any], data: DataFrame) -> Estimator:
    return GBTClassifier(maxIter=p.get("n_estimators", 10), maxDepth=p.get("max_depth", 3), stepSize=p.get("learning_rate", 0.1), subsamplingRate=p.get("subsample", 1.0), weightCol="weight", seed=SEED)


gradient_boosting.weigh = positive_weights


def extreme_boosting(p: dict[str, Any], data: DataFrame) -> BoostedTrees:
    """Parameters and defaults as usual for extreme gradient boosting; without ``scale_pos_weight`` positives weigh n0 / n1 of the fitted rows."""
    names = {"n_estimators": "rounds", "max_depth": "depth", "learning_rate": "rate", "reg_lambda": "l2", "gamma": "gamma", "min_child_weight": "min_child", "max_bin": "bins", "base_score": "base", "subsample": "subsample", "colsample_bytree": "columns", "scale_pos_weight": "positive"}
    unknown = set(p) - set(names)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return BoostedTrees(**{names[k]: v for k, v in p.items()}, seed=SEED)


extreme_boosting.weigh = positive_weights


def perceptron(p: dict[str, Any], data: DataFrame) -> Estimator:
    width = data.select(F.size(vector_to_array("features"))).first()[0]
    return MultilayerPerceptronClassifier(layers=[width, *p.get("hidden", (16,)), 2], maxIter=p.get("max_iter", 100), stepSize=p.get("learning_rate", 0.03), seed=SEED)


def logistic_regression(p: dict[str, Any], data: DataFrame) -> Estimator:
    """``C`` as usual: the penalty is 1 / (C * n)."""
    return LogisticRegression(regParam=1 / (p.get("C", 1.0) * max(data.count(), 1)), maxIter=p.get("max_iter", 100), weightCol="weight")


def linear_svc(p: dict[str, Any], data: DataFrame) -> Estimator:
    return LinearSVC(regParam=1 / (p.get("C", 1.0) * max(data.count(), 1)), maxIter=p.get("max_iter", 15), tol=p.get("tol", 1e-3), weightCol="weight")


class Boosted:
    """AdaBoost (SAMME for two classes) over weighted trees: one tree per round, weights as a column.

    A round's weights are built on the round before; every ``cut`` rounds they are written to the shared folder, so that no round
    scores more than ``cut`` trees.
    """

    def __init__(self, rounds: int = 10, depth: int = 3, rate: float = 1.0, cut: int = 3) -> None:
        self.rounds, self.depth, self.rate, self.cut = rounds, depth, rate, cut

    def fit(self, data: DataFrame) -> Boosted:
        self.trees: list[tuple[float, Model]] = []
        rows = data.select("features", "label", F.col("weight").alias("w"))
        with stages(data.sparkSession) as keep:
            for k in range(self.rounds):
                tree = DecisionTreeClassifier(maxDepth=self.depth, weightCol="w", seed=SEED + k).fit(rows)
                wrong = tree.transform(rows).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
                err = wrong.agg(F.sum(F.col("miss") * F.col("w")) / F.sum("w")).first()[0]
                if err >= 0.5:
                    break
                alpha = self.rate * math.log((1 - err) / max(err, 1e-10))
                self.trees.append((alpha, tree))
                if err <= 0:
                    break
                rows = wrong.select("features", "label", (F.col("w") * F.exp(F.lit(alpha) * F.col("miss"))).alias("w"))
                if (k + 1) % self.cut == 0:
                    rows = keep(rows)
        return self

    def transform(self, data: DataFrame) -> DataFrame:
        out = data.withColumn("_vote", F.lit(0.0))
        for alpha, tree in self.trees:
            keep = out.columns
            out = tree.transform(out).select(*[c for c in keep if c != "_vote"], (F.col("_vote") + F.lit(alpha) * (2 * F.col("prediction") - 1)).alias("_vote"))
        return out.withColumn("prediction", (F.col("_vote") > 0).cast("double")).withColumnRenamed("_vote", "score")


def adaboost(p: dict[str, Any], data: DataFrame) -> Boosted:
    return Boosted(p.get("n_estimators", 5), 3, p.get("learning_rate", 1.0))


def score(preds: DataFrame, scoring: str) -> float:
    """f1 (0 where undefined) or roc_auc (0.0 with one class)."""
    if scoring == "f1":
        return float(rates(confusion(preds.select(F.col("label").alias("y"), F.col("prediction").alias("pred")))).first()["f1"])
    if scoring == "roc_auc":
        if preds.select("label").distinct().count() < 2:
            return 0.0
        return float(BinaryClassificationEvaluator(rawPredictionCol="rawPrediction" if "rawPrediction" in preds.columns else "score").evaluate(preds))
    raise ValueError(f"unknown scoring {scoring}")


def grid_search(build: Callable[[dict, DataFrame], Any], grid: dict[str, Sequence[Any]], train: DataFrame, val: DataFrame, scoring: str = "f1", n_jobs: int = 1) -> tuple[Any, dict, float]:
    """(model refitted on train and val, best parameters, its validation score); the first of equal scores wins.

    Candidates are independent Spark jobs; ``n_jobs`` of them are submitted at a time: 0 is one, -1 as many as the
    session has cores, -2 one less and so on.
    """
    combos = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    if not grid or not combos:
        raise ValueError("the parameter grid is empty")
    if scoring not in ("f1", "roc_auc"):
        raise ValueError(f"unknown scoring {scoring}")
    fitted = weighed(build, train)
    run = lambda p: score(build(p, fitted).fit(fitted).transform(val), scoring)
    with ThreadPoolExecutor(workers(n_jobs, train.sparkSession.sparkContext.defaultParallelism, len(combos))) as pool:
        found = list(pool.map(run, combos))
    best = max(range(len(found)), key=lambda i: (found[i], -i))
    both = weighed(build, train.drop("weight").unionByName(val.drop("weight")))
    return build(combos[best], both).fit(both), combos[best], found[best]


def workers(n_jobs: int, cores: int, tasks: int) -> int:
    """Jobs to submit at a time."""
    return max(1, min(n_jobs if n_jobs >= 0 else cores + 1 + n_jobs, tasks))


def class_figures(train: DataFrame, features: Sequence[str], label: str = "target") -> DataFrame:
    """Per class its number of rows, means and population variances, with the number of all rows and their largest variance: one row per class, computed here."""
    per = train.groupBy(label).agg(F.count("*").alias("_n"), *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.var_pop(f).alias(f"_v_{f}") for f in features])
    whole = train.agg(F.count("*").alias("_all"), (F.greatest(*[F.var_pop(f) for f in features]) if len(features) > 1 else F.var_pop(features[0])).alias("_top"))
    found = per.join(F.broadcast(whole)).withColumnRenamed(label, "_class")
    return train.sparkSession.createDataFrame(found.collect(), found.schema)


def gaussian_nb(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "target", smoothing: float = 1e-9, figures: DataFrame | None = None) -> DataFrame:
    """``rows`` with pred, by class means and population variances plus ``smoothing`` times the largest variance.

    The classes' figures (:func:`class_figures` of ``train``, unless given) are one broadcast row, and each row scores
    all classes by itself, so rows stay as they are, repeated ones too. Of equal scores the smaller class wins.
    """
    per = class_figures(train, features, label) if figures is None else figures

    def scored(c: Column) -> Column:
        ll = F.log(c["_n"] / c["_all"])
        for f in features:
            v, gap = c[f"_v_{f}"] + F.lit(smoothing) * c["_top"], F.col(f) - c[f"_m_{f}"]
            ll = ll - 0.5 * F.log(F.lit(2 * math.pi) * v) - gap * gap / (2 * v)
        return F.struct(ll.alias("ll"), (-c["_class"]).alias("o"))

    classes = per.agg(F.collect_list(F.struct("*")).alias("_classes"))
    best = F.array_max(F.transform("_classes", scored))
    return rows.join(F.broadcast(classes)).select(*rows.columns, (-best["o"]).cast("int").alias("pred"))


class NaiveBayes:
    """:func:`gaussian_nb` as a model for :func:`grid_search`: its parameters are the class figures of the fitted rows."""

    def __init__(self, features: Sequence[str], smoothing: float = 1e-9) -> None:
        self.features, self.smoothing = list(features), smoothing

    def fit(self, data: DataFrame) -> NaiveBayes:
        self.figures = class_figures(data.select("label", *self.features), self.features, "label")
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return gaussian_nb(rows, rows, self.features, "label", self.smoothing, self.figures).withColumn("prediction", F.col("pred").cast("double"))


def kmeans_distances(train: DataFrame, rows: DataFrame, k: int = 8) -> DataFrame:
    """``rows`` with the distance to each of k centres appended as columns dist_0.."""
    centers = KMeans(k=k, seed=SEED).fit(train).clusterCenters()
    x = vector_to_array("features")
    dist = lambda c: F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return rows.withColumns({f"dist_{i}": dist(c) for i, c in enumerate(centers)})


class SphericalMixture:
    """A mixture of k Gaussians, each with one variance for all directions, by EM from k-means centres.

    A round is one aggregation of 1 + width + 1 sums per component, of which a task sends its own; the components are no
    part of a plan, so that its code is made once and not for each round. ``floor`` is added to the variances. It ends when
    the mean log likelihood gains less than ``tol``.
    """

    def __init__(self, k: int = 8, rounds: int = 25, tol: float = 1e-3, floor: float = 1e-6) -> None:
        self.k, self.rounds, self.tol, self.floor = k, rounds, tol, floor

    def _logs(self) -> Column:
        """The log of weight times density of each component, for the array column _x."""
        parts = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in m]).alias("m"), F.lit(float(1 / (2 * s))).alias("h"), F.lit(float(math.log(max(w, 1e-300)) - len(m) / 2 * math.log(2 * math.pi * s))).alias("c")) for w, m, s in zip(self.weights, self.means, self.variances, strict=True)])
        gap = lambda p: F.aggregate(F.zip_with("_x", p["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d)
        return F.transform(parts, lambda p: p["c"] - p["h"] * gap(p))

    def _sums(self) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of the arrays _x of a task: log likelihood, rows, and each component's mass, squares and sums of coordinates."""
        parts = [(m, 1 / (2 * s), math.log(max(w, 1e-300)) - len(m) / 2 * math.log(2 * math.pi * s)) for w, m, s in zip(self.weights, self.means, self.variances, strict=True)]
        k, d = self.means.shape

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + 2 * k + k * d)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, d)
                g = np.column_stack([c - h * ((x - m) ** 2).sum(axis=1) for m, h, c in parts])
                top = g.max(axis=1)
                log = top + np.log(np.exp(g - top[:, None]).sum(axis=1))
                r = np.exp(g - log[:, None])
                total += np.concatenate([[log.sum(), len(x)], r.sum(axis=0), r.T @ (x * x).sum(axis=1), (r.T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

        return run

    def responsibilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (features) with arrays _x and _r and the log likelihood _l."""
        out = rows.withColumn("_x", vector_to_array("features")).withColumn("_g", self._logs()).withColumn("_m", F.array_max("_g"))
        out = out.withColumn("_l", F.col("_m") + F.log(F.aggregate("_g", F.lit(0.0), lambda t, g: t + F.exp(g - F.col("_m")))))
        return out.withColumn("_r", F.transform("_g", lambda g: F.exp(g - F.col("_l")))).drop("_g", "_m")

    def fit(self, data: DataFrame) -> SphericalMixture:
        rows = data.select("features")
        self.means = np.array(KMeans(k=self.k, seed=SEED).fit(rows).clusterCenters())
        k, d = self.means.shape
        tasks = data.sparkSession.sparkContext.defaultParallelism
        x = rows.select(vector_to_array("features").alias("_x"))
        spread = x.agg(*[F.var_pop(F.get("_x", F.lit(j))) for j in range(d)]).first()
        self.weights, self.variances = np.full(k, 1 / k), np.full(k, np.mean(spread) + self.floor)
        last = -math.inf
        for _ in range(self.rounds):
            got = x.coalesce(2 * tasks).mapInArrow(self._sums(), "s array<double>").agg(*[F.sum(F.get("s", F.lit(j))) for j in range(2 + 2 * k + k * d)]).first()
            mass, squares, sums = np.maximum(got[2 : 2 + k], 1e-12), np.array(got[2 + k : 2 + 2 * k]), np.array(got[2 + 2 * k :]).reshape(k, d)
            self.weights, self.means, likelihood = mass / got[1], sums / mass[:, None], got[0] / got[1]
            self.variances = np.maximum(squares / mass - (self.means**2).sum(axis=1), 0) / d + self.floor
            self.likelihood = likelihood
            if likelihood - last < self.tol:
                break
            last = likelihood
        return self


def gmm_probabilities(train: DataFrame, rows: DataFrame, k: int = 8, mixture: SphericalMixture | None = None) -> DataFrame:
    """``rows`` with the responsibilities of k spherical components as columns gmm_0.."""
    out = (mixture or SphericalMixture(k).fit(train)).responsibilities(rows)
    return out.select(*rows.columns, *[F.get("_r", F.lit(i)).alias(f"gmm_{i}") for i in range(k)])


def fourier_features(rows: DataFrame, width: int, n: int = 64, gamma: float = 0.1, seed: int = SEED) -> DataFrame:
    """``features`` mapped to n random Fourier features of an RBF kernel, for a linear classifier on top."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (n, width)), rng.uniform(0, 2 * math.pi, n)
    planes = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w[i]]).alias("w"), F.lit(float(b[i])).alias("b")) for i in range(n)])
    dot = lambda p: F.aggregate(F.zip_with(vector_to_array("features"), p["w"], lambda a, c: a * c), p["b"], lambda s, v: s + v)
    return rows.withColumn("features", array_to_vector(F.transform(planes, lambda p: F.lit(math.sqrt(2 / n)) * F.cos(dot(p)))))


def positive_scores(preds: DataFrame) -> DataFrame:
    """Adds score: the raw score (or probability) of class 1."""
    col = "probability" if "probability" in preds.columns else "rawPrediction"
    return preds.withColumn("score", F.get(vector_to_array(col), F.lit(1)))


def vote(preds: DataFrame, models: Sequence[Any], name: str = "votes") -> DataFrame:
    """``preds`` with an array of the models' 0/1 predictions."""
    out = preds.withColumn(name, F.array().cast("array<int>"))
    for m in models:
        keep = out.columns
        out = m.transform(out).select(*[c for c in keep if c != name], F.array_append(name, F.col("prediction").cast("int")).alias(name))
    return out


