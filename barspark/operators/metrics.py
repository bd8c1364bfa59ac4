"""Evaluation: confusion counts and what follows from them, trade results, ensembles, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.selection import exact_median


def _zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(preds: DataFrame, by: list[str] | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn, in one aggregation."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return preds.groupBy(*(by or [])).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


def rates(conf: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 (0 where undefined) and auc of the hard labels (null with one class)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _zero(tp, tp + fp), _zero(tp, tp + fn)
    return conf.withColumns({"accuracy": _zero(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": _zero(2 * tp + F.lit(0.0), 2 * tp + fp + fn), "auc": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2})


def pnl(conf: DataFrame, tp: float, sl: float, cost: float) -> DataFrame:
    """The trades' result and its bounds: profit, maximum, loss rate, capture, gap to the break-even precision."""
    win, lose, miss = F.col("tp"), F.col("fp"), F.col("fn")
    profit = win * F.lit(tp) - lose * F.lit(sl) - (win + lose) * F.lit(cost)
    return conf.withColumns({"profit": profit, "max_profit": (win + miss) * F.lit(tp), "max_net": (win + miss) * F.lit(tp - cost), "loss_rate": _zero(lose, win + lose), "capture_pct": _zero(100 * profit, (win + miss) * F.lit(tp - cost)), "break_even_gap": _zero(win, win + lose) - F.lit((sl + cost) / (tp + sl))})


def selective_leg(trades: DataFrame, cost: float) -> DataFrame:
    """Only pred = 1 with a return: n, gross, and net of cost on both sides (null without trades)."""
    take = (F.col("pred") == 1) & F.col("gross_return").isNotNull()
    n, gross = F.count_if(take), F.sum(F.when(take, F.col("gross_return")))
    return trades.agg(n.alias("n"), gross.alias("gross"), (gross - n * F.lit(2 * cost)).alias("net"))


def two_leg(trades: DataFrame, cost: float) -> DataFrame:
    """pred = 1 earns the row's return, pred = 0 the other symbol's; net takes the cost off once."""
    got = F.when(F.col("pred") == 1, F.col("gross_return")).otherwise(F.col("other_gross_return"))
    t = trades.withColumn("_r", got).where("_r IS NOT NULL")
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 1).alias("n_long"), F.sum("_r").alias("gross"), F.sum(F.col("_r") - F.lit(cost)).alias("net"), F.avg(F.col("_r") - F.lit(cost)).alias("mean_net"))


def unanimous(preds: Column) -> Column:
    """1 if all of an array are 1, 0 if all are 0, else -1."""
    return F.when(F.forall(preds, lambda x: x == 1), 1).when(F.forall(preds, lambda x: x == 0), 0).otherwise(-1)


def consensus_report(preds: DataFrame, votes: str = "votes", y: str = "y") -> DataFrame:
    """Shares of unanimous rows, and the rates on those."""
    voted = preds.withColumn("pred", unanimous(F.col(votes)))
    n = F.count("*")
    shares = voted.agg(n.alias("n"), F.count_if(F.col("pred") >= 0).alias("n_decided"), _zero(F.count_if(F.col("pred") == 1), n).alias("share_all_1"), _zero(F.count_if(F.col("pred") == 0), n).alias("share_all_0"))
    return shares.join(F.broadcast(rates(confusion(voted.where("pred >= 0"), y=y))))


def threshold_sweep(scores: DataFrame, thresholds: list[float], tp: float, sl: float, cost: float, least_trades: int = 0, strict: bool = True) -> DataFrame:
    """Confusion, rates and profit at each threshold in one pass; thresholds with too few trades are marked skipped."""
    rows = scores.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.col("score") > F.col("threshold") if strict else F.col("score") >= F.col("threshold")
    out = pnl(rates(confusion(rows.withColumn("pred", hit.cast("int")), ["threshold"])), tp, sl, cost)
    return out.withColumn("n_trades", F.col("tp") + F.col("fp")).withColumn("skipped", F.col("n_trades") < least_trades)


def best_thresholds(sweep: DataFrame, k: int = 15) -> DataFrame:
    return sweep.where(~F.col("skipped")).orderBy(F.desc("profit"), F.desc("precision"), "n_trades", "threshold").limit(k)


def score_summary(scores: DataFrame) -> DataFrame:
    """Smallest, median and largest score; the median is found when this is called, by counts (see :mod:`selection`)."""
    middle = F.lit(exact_median(scores, "score")).cast("double")
    return scores.agg(F.min("score").alias("min_score"), F.max("score").alias("max_score")).select("min_score", middle.alias("median_score"), "max_score")
