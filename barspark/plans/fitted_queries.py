"""Fitted models whose whole fit is repeated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators import features, kernels, linear, metrics, ml, perceptron, splits
from barspark.operators.windows import session
from barspark.plans import desk_queries as dq
from barspark.plans import model_queries as mq
from barspark.plans.bar_queries import rounded
from barspark.plans.sqlbars import HOURLY, bars, r6

QUERIES: dict = {}
ORACLE: dict = {}
FEATURES = ["pct_change_1", "pct_change_2", "bars_since_open", "spread"]
KEYS = ["symbol", "timestamp"]


def next_up(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars with a two-sided target (does the next close of the session lie higher), four features cut to 6 digits and the split."""
    frame = features.pct_change(features.bars_since_open(dq.hourly(s, d)), (1, 2)).withColumns({"next_close": F.lead("close").over(session()), "spread": (F.col("high") - F.col("low")) / F.col("close")})
    rows = frame.where("next_close IS NOT NULL AND bars_since_open >= 2").select(*KEYS, (F.col("next_close") > F.col("close")).cast("int").alias("target"), *[F.col(f).cast("double").alias(f) for f in FEATURES])
    return splits.chrono_split(rounded(rows, *FEATURES), 0.15, 0.2)


ROWS = f"""{bars(HOURLY, 'lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2, lead(close) OVER w AS nc')},
o AS (SELECT *, row_number() OVER (ORDER BY timestamp, symbol) - 1 AS o, count(*) OVER () AS c FROM x WHERE nc IS NOT NULL AND i >= 2)
SELECT symbol, timestamp, CAST(nc > close AS INTEGER) AS target, {r6('CASE WHEN c1 <> 0 THEN (close - c1) / c1 ELSE 0.0 END')} AS pct_change_1, {r6('CASE WHEN c2 <> 0 THEN (close - c2) / c2 ELSE 0.0 END')} AS pct_change_2,
CAST(i AS DOUBLE) AS bars_since_open, {r6('(high - low) / close')} AS spread,
CASE WHEN o < c - CAST(floor(c * 0.2) AS BIGINT) - CAST(floor(c * 0.15) AS BIGINT) THEN 'train' WHEN o < c - CAST(floor(c * 0.2) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM o"""


def labelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: keys, label, features."""
    rows = next_up(s, d).select(*KEYS, "split", F.col("target").cast("double").alias("label"), F.array(*FEATURES).alias("features"))
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


# --- boosted trees -------------------------------------------------------------------------------------------------
BOOST = {"n_estimators": 2, "max_depth": 3, "max_bin": 16, "learning_rate": 0.3, "reg_lambda": 1.0, "gamma": 0.01, "min_child_weight": 2.0}


def xgb_boosted(s: SparkSession, d: str) -> DataFrame:
    train, test = labelled(s, d)
    rows = ml.weighed(ml.extreme_boosting, train)
    model = ml.extreme_boosting(BOOST, rows).fit(rows)
    return rounded(model.transform(test).select(*KEYS, "score"), "score").withColumn("pred", (F.col("score") > 0).cast("int"))


def _boost_sql() -> str:
    """Every round and level as a few CTEs; a row's node is in heap order, gradients add up as whole numbers."""
    p, scale = BOOST, 2**34
    shares = ", ".join(str(i / p["max_bin"]) for i in range(1, p["max_bin"]))
    worth = lambda g, h: f"({g} * {g} / ({h} + {p['reg_lambda']}))"
    ctes = [
        f"r AS MATERIALIZED ({ROWS})",
        "z AS (SELECT coalesce(count(*) FILTER (WHERE target = 0) / nullif(count(*) FILTER (WHERE target = 1), 0), 1.0) AS ratio FROM r WHERE split = 'train')",
        "t AS MATERIALIZED (SELECT symbol, timestamp, split, target AS y, CASE WHEN target = 1 THEN ratio ELSE 1.0 END AS w FROM r, z)",
        "x AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT symbol, timestamp, split, {i} AS f, {c} AS v FROM r" for i, c in enumerate(FEATURES)) + ")",
        f"q AS MATERIALIZED (SELECT f, list_distinct(quantile_disc(v, [{shares}])) AS cuts FROM x WHERE split = 'train' GROUP BY f)",
        "b AS MATERIALIZED (SELECT symbol, timestamp, split, f, len(list_filter(cuts, lambda c: c <= v)) AS bin FROM x JOIN q USING (f))",
        "m0 AS (SELECT symbol, timestamp, split, y, w, 0.0 AS margin FROM t)",
    ]
    for k in range(p["n_estimators"]):
        prob = "(1 / (1 + exp(-margin)))"
        ctes.append(
            f"g{k} AS MATERIALIZED (SELECT *, CAST(round({scale} * w * ({prob} - y)) AS HUGEINT) AS g, CAST(round({scale} * w * greatest({prob} * (1 - {prob}), 1e-16)) AS HUGEINT) AS h FROM m{k}), "
            f"n{k}_0 AS (SELECT symbol, timestamp, split, 1 AS node FROM t)"
        )
        for level in range(p["max_depth"]):
            name = f"{k}_{level}"
            ctes.append(
                f"h{name} AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h FROM n{name} JOIN g{k} USING (symbol, timestamp, split) JOIN b USING (symbol, timestamp, split) WHERE split = 'train' AND node >= {2**level} GROUP BY ALL), "
                f"c{name} AS (SELECT node, f, bin, CAST(sum(g) OVER a AS DOUBLE) / {scale} AS ag, CAST(sum(h) OVER a AS DOUBLE) / {scale} AS ah, CAST(sum(g) OVER u AS DOUBLE) / {scale} AS lg, CAST(sum(h) OVER u AS DOUBLE) / {scale} AS lh, "
                f"CAST(sum(g) OVER a - sum(g) OVER u AS DOUBLE) / {scale} AS rg, CAST(sum(h) OVER a - sum(h) OVER u AS DOUBLE) / {scale} AS rh FROM h{name} WINDOW a AS (PARTITION BY node, f), u AS (PARTITION BY node, f ORDER BY bin)), "
                f"s{name} AS MATERIALIZED (SELECT node, arg_max(struct_pack(f := f, bin := bin), (gain, -f, -bin)) AS cut FROM (SELECT *, {worth('lg', 'lh')} + {worth('rg', 'rh')} - {worth('ag', 'ah')} AS gain FROM c{name}) "
                f"WHERE lh >= {p['min_child_weight']} AND rh >= {p['min_child_weight']} AND gain > 1e-6 AND gain >= {p['gamma']} GROUP BY node), "
                f"n{k}_{level + 1} AS MATERIALIZED (SELECT n.symbol, n.timestamp, n.split, CASE WHEN s.node IS NULL THEN n.node WHEN b.bin <= s.cut.bin THEN 2 * n.node ELSE 2 * n.node + 1 END AS node "
                f"FROM n{name} n LEFT JOIN s{name} s ON s.node = n.node LEFT JOIN b ON b.symbol = n.symbol AND b.timestamp = n.timestamp AND b.split = n.split AND b.f = s.cut.f)"
            )
        last = f"n{k}_{p['max_depth']}"
        ctes.append(
            f"l{k} AS (SELECT node, -{p['learning_rate']} * (CAST(sum(g) AS DOUBLE) / {scale}) / (CAST(sum(h) AS DOUBLE) / {scale} + {p['reg_lambda']}) AS leaf FROM {last} JOIN g{k} USING (symbol, timestamp, split) WHERE split = 'train' GROUP BY node), "
            f"m{k + 1} AS MATERIALIZED (SELECT symbol, timestamp, split, y, w, margin + leaf AS margin FROM m{k} JOIN {last} USING (symbol, timestamp, split) JOIN l{k} USING (node))"
        )
    return f"WITH {', '.join(ctes)} SELECT symbol, timestamp, {r6('margin')} AS score, CAST({r6('margin')} > 0 AS INTEGER) AS pred FROM m{p['n_estimators']} WHERE split = 'test'"


QUERIES["xgb_boosted"], ORACLE["xgb_boosted"] = xgb_boosted, _boost_sql()


# --- linear models --------------------------------------------------------------------------------------------------
def scaled(s: SparkSession, d: str) -> DataFrame:
    """The rows of all splits, features scaled by the train split's mean and deviation."""
    rows = splits.zscore_splits(next_up(s, d), FEATURES)
    return rows.select(*KEYS, "split", F.col("target").cast("double").alias("label"), F.array(*FEATURES).alias("features"))


_SCALED = f"""r AS MATERIALIZED ({ROWS}), u AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in FEATURES)} FROM r WHERE split = 'train'),
z AS MATERIALIZED (SELECT symbol, timestamp, split, target, {', '.join(f'({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END AS x{i}' for i, f in enumerate(FEATURES))}, 1.0 AS x{len(FEATURES)},
  CASE WHEN target = 1 THEN 1.0 ELSE -1.0 END AS y, count(*) OVER (PARTITION BY split) / (2.0 * count(*) OVER (PARTITION BY split, target)) AS even FROM r, u)"""


def newton_sql(name: str, loss: str, c: float, weight: str, rounds: int = 14) -> str:
    """CTEs that end in ``name``: one row with the coefficients w0, w1, ... (the last is the intercept) of plain Newton rounds from 0, each with an elimination."""
    n = len(FEATURES) + 1
    w = [f"w{i}" for i in range(n)]
    ctes = [f"{name}_0 AS (SELECT {', '.join(f'0.0::DOUBLE AS {x}' for x in w)})"]
    for k in range(rounds):
        dot = " + ".join(f"w{i} * x{i}" for i in range(n))
        if loss == "squared_hinge":
            first, second = "-2 * greatest(0, 1 - m)", "CASE WHEN m < 1 THEN 2.0 ELSE 0.0 END"
        else:
            first, second = "-1 / (1 + exp(m))", "(1 / (1 + exp(m))) * (1 - 1 / (1 + exp(m)))"
        sums = [f"{int(i == j)} + {c} * sum(c * d2 * x{i} * x{j}) AS h{i}{j}" for i in range(n) for j in range(n)]
        sums += [f"any_value(w{i}) + {c} * sum(c * y * d1 * x{i}) AS g{i}" for i in range(n)]
        at = f"SELECT {', '.join([*sums, *[f'any_value({x}) AS {x}' for x in w]])} FROM (SELECT *, {first} AS d1, {second} AS d2 FROM (SELECT *, {weight} AS c, y * ({dot}) AS m FROM z, {name}_{k} WHERE split = 'train'))"
        for p in range(n):
            cells = [f"h{i}{j} - h{i}{p} / h{p}{p} * h{p}{j} AS h{i}{j}" if i > p else f"h{i}{j}" for i in range(n) for j in range(n)]
            right = [f"g{i} - h{i}{p} / h{p}{p} * g{p} AS g{i}" if i > p else f"g{i}" for i in range(n)]
            at = f"SELECT {', '.join([*cells, *right, *w])} FROM ({at})"
        for p in reversed(range(n)):
            rest = " - ".join([f"g{p}", *[f"h{p}{j} * s{j}" for j in range(p + 1, n)]])
            at = f"SELECT *, ({rest}) / h{p}{p} AS s{p} FROM ({at})"
        ctes.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i} - s{i} AS w{i}' for i in range(n))} FROM ({at}))")
    return ", ".join(ctes) + f", {name} AS (SELECT * FROM {name}_{rounds})"


_DOT = " + ".join(f"w{i} * x{i}" for i in range(len(FEATURES) + 1))


def linear_svc_squared(s: SparkSession, d: str) -> DataFrame:
    rows = scaled(s, d)
    train = ml.weighed(linear.build("squared_hinge"), rows.where("split = 'train'"))
    model = linear.LinearModel("squared_hinge", 0.1).fit(train)
    return rounded(model.transform(rows.where("split = 'test'")).select(*KEYS, "score"), "score")


QUERIES["linear_svc_squared"] = linear_svc_squared
ORACLE["linear_svc_squared"] = f"WITH {_SCALED}, {newton_sql('k', 'squared_hinge', 0.1, 'even')} SELECT symbol, timestamp, {r6(_DOT)} AS score FROM z, k WHERE split = 'test'"

GRID = [(0.01, False), (0.01, True), (1.0, False), (1.0, True)]
THRESHOLDS = [0.3, 0.4, 0.5, 0.6]
FIGURES = ["tp", "fp", "fn", "tn", "n_trades", "accuracy", "precision", "recall", "profit"]


def logreg_threshold_grid(s: SparkSession, d: str) -> DataFrame:
    """(C, class weight, threshold) with the figures on val and test side by side."""
    rows = scaled(s, d).cache()
    try:
        part = lambda x: rows.where(F.col("split") == x)
        # Scores are cut to 6 digits, so that both engines cut at the same values.
        sweep = lambda scored, at, strict: metrics.threshold_sweep(rounded(scored, "score"), at, dq.TP, dq.SL, dq.COST, strict=strict).select("threshold", *FIGURES)
        grid = linear.threshold_grid(part("train"), {"val": part("val"), "test": part("test")}, GRID, THRESHOLDS, sweep)
        out = rounded(grid, *[f"{p}_{f}" for p in ("val", "test") for f in ("accuracy", "precision", "recall", "profit")])
        return mq.now(out)  # a row per point of the grid
    finally:
        rows.unpersist()


def _grid_sql() -> str:
    fits = [newton_sql(f"k{i}", "logistic", c, "even" if even else "1.0") for i, (c, even) in enumerate(GRID)]
    scored = " UNION ALL ".join(f"SELECT {c}::DOUBLE AS C, {str(even).lower()} AS balanced, split, target, {r6(f'1 / (1 + exp(-({_DOT})))')} AS score FROM z, k{i} WHERE split <> 'train'" for i, (c, even) in enumerate(GRID))
    counts = f"SELECT C, balanced, threshold, split, {dq._CONF} FROM (SELECT C, balanced, threshold, split, target AS y, CAST(score >= threshold AS INTEGER) AS pred FROM p, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS threshold)) GROUP BY ALL"
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / ({b}) END"
    of = {"accuracy": r6(ratio("tp + tn", "tp + fp + fn + tn")), "precision": r6(ratio("tp", "tp + fp")), "recall": r6(ratio("tp", "tp + fn")), "profit": r6(f"tp * {dq.TP} - fp * {dq.SL} - (tp + fp) * {dq.COST}"), "n_trades": "tp + fp"}
    figures = ", ".join(f"{of.get(f, f)} AS {f}" for f in FIGURES)
    sides = ", ".join(f"{p}.{f} AS {p}_{f}" for p in ("val", "test") for f in FIGURES)
    return f"WITH {_SCALED}, {', '.join(fits)}, p AS ({scored}), f AS (SELECT C, balanced, threshold, split, {figures} FROM ({counts})) SELECT val.C, val.balanced, val.threshold, {sides} FROM f val JOIN f test USING (C, balanced, threshold) WHERE val.split = 'val' AND test.split = 'test'"


QUERIES["logreg_threshold_grid"], ORACLE["logreg_threshold_grid"] = logreg_threshold_grid, _grid_sql()


def mlp_adam(s: SparkSession, d: str) -> DataFrame:
    """Test rates of a perceptron with L2, relu and Adam after at most a few epochs; training stops early on a held-out tenth."""
    rows = scaled(s, d).cache()
    try:
        model = perceptron.build({"hidden_layer_sizes": (16,), "learning_rate_init": 0.02, "max_iter": 4, "steps": 2, "n_iter_no_change": 2}, rows).fit(rows.where("split = 'train'"))
        return mq.now(mq._report(model.transform(rows.where("split = 'test'"))))
    finally:
        rows.unpersist()


QUERIES["mlp_adam"] = mlp_adam


def rbf_svm_nystroem(s: SparkSession, d: str) -> DataFrame:
    """Test rates of a kernel machine with the usual C, scaled gamma and balanced classes, the other parameters being its own."""
    rows = scaled(s, d).cache()
    try:
        train = ml.weighed(kernels.build, rows.where("split = 'train'"))
        return mq.now(mq._report(kernels.build({"C": 1.0, "landmarks": 64}, train).fit(train).transform(rows.where("split = 'test'"))))
    finally:
        rows.unpersist()


QUERIES["rbf_svm_nystroem"] = rbf_svm_nystroem
