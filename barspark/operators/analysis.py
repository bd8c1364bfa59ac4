"""Summaries: scans over parameter grids, pairs, correlations, data statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.cross import pair_align
from barspark.operators.selection import exact_median
from barspark.operators.windows import SESSION, with_trade_date


def aggregate_trades(trades: DataFrame, cost: float) -> DataFrame:
    """Per (symbol, tp, sl): revenue, cost and profit of the take-profit trades, shares of trades and days, imputed, bars."""
    win = F.col("kind") == "tp"
    n = F.count_if(win)
    return trades.groupBy("symbol", "tp", "sl").agg(
        F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("revenue"), (n * F.lit(cost)).alias("cost"), n.alias("n_trades"), (n / F.count("*")).alias("pct_trades"),
        (F.count_distinct(F.when(win, F.col("trade_date"))) / F.count_distinct("trade_date")).alias("pct_days"),
        F.sum(F.when(win & F.coalesce("imputed", F.lit(False)), 1).otherwise(0)).alias("imputed"), F.coalesce(F.avg(F.when(win, F.col("duration") + F.lit(0.0))), F.lit(0.0)).alias("mean_duration"),
    ).withColumn("profit", F.col("revenue") - F.col("cost"))


def top_profits(scan: DataFrame, k: int = 10) -> DataFrame:
    """The k most profitable grid points of each symbol; ties by tp, then sl."""
    w = Window.partitionBy("symbol").orderBy(F.desc("profit"), "tp", "sl")
    return scan.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def data_stats(bars: DataFrame, close_digits: int = 4, pct_digits: int = 2) -> DataFrame:
    """Per symbol: first and last day, rows, extremes, mean close and imputed percent, rounded half to even."""
    imputed = F.coalesce("imputed", F.lit(False)) if "imputed" in bars.columns else F.lit(False)
    return bars.groupBy("symbol").agg(F.to_date(F.min("timestamp")).alias("start_date"), F.to_date(F.max("timestamp")).alias("end_date"), F.count("*").alias("n_rows"), F.min("low").alias("min_low"), F.max("high").alias("max_high"), F.bround(F.avg("close"), close_digits).alias("mean_close"), F.bround(F.avg(F.when(imputed, 100.0).otherwise(0.0)), pct_digits).alias("pct_imputed"))


def longest_session(bars: DataFrame, configured: int | None = None) -> DataFrame:
    """The most bars of a symbol's session, 1 at least; a ``configured`` number wins."""
    if configured is not None:
        return bars.sparkSession.range(1).select(F.lit(max(1, int(configured))).cast("long").alias("longest"))
    return with_trade_date(bars).groupBy(*SESSION).count().agg(F.greatest(F.max("count"), F.lit(1)).alias("longest"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation, null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def feature_correlations(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, corr), all from one aggregation, the strongest first."""
    row = table.agg(*[correlation(f, target).alias(f) for f in features])
    return row.select(F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f))])).alias("feature", "corr")).orderBy(F.desc(F.abs("corr")), "feature")


def pair_returns(bars: DataFrame, a: str, b: str, horizon: int) -> DataFrame:
    """Forward returns of both symbols over ``horizon`` common bars of a day, null where a price is not above 0."""
    w = Window.partitionBy("trade_date").orderBy("timestamp")
    pairs = pair_align(bars, a, b).withColumn("trade_date", F.to_date("timestamp"))
    ok = (F.col("close_a") > 0) & (F.col("close_b") > 0)
    return pairs.withColumns({f"ret_{x}": F.when(ok, F.lead(f"close_{x}", horizon).over(w) / F.col(f"close_{x}") - 1) for x in "ab"})


def band_stats(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Where a's return is in [low, high]: b's n, mean, median, sample std, mean of the sum, and its share in [-high, -low].

    The median is found when this is called, by counts (see :mod:`selection`).
    """
    rows = pairs.where(F.col("ret_a").isNotNull() & F.col("ret_b").isNotNull() & F.col("ret_a").between(low, high))
    mirror = F.col("ret_b").between(-high, -low)
    return rows.agg(F.count("*").alias("n"), F.avg("ret_b").alias("mean"), F.lit(exact_median(rows, "ret_b")).cast("double").alias("median"), F.stddev_samp("ret_b").alias("std"), F.avg(F.col("ret_a") + F.col("ret_b")).alias("mean_sum"), F.count_if(mirror).alias("n_mirror"), F.try_divide(F.count_if(mirror), F.count("*")).alias("share_mirror"))


def exit_summary(trades: DataFrame) -> DataFrame:
    """Every-bar trades: counts and percents by exit, mean return (all, horizon exits) and population std."""
    t = trades.where("exit_kind >= 0")
    kinds = {"tp": 0, "sl": 1, "horizon": 2}
    return t.groupBy("symbol").agg(F.count("*").alias("n"), *[F.count_if(F.col("exit_kind") == k).alias(f"n_{x}") for x, k in kinds.items()], *[(100.0 * F.count_if(F.col("exit_kind") == k) / F.count("*")).alias(f"pct_{x}") for x, k in kinds.items()], F.avg("gross_return").alias("mean_return"), F.avg(F.when(F.col("exit_kind") == 2, F.col("gross_return"))).alias("mean_horizon"), F.stddev_pop("gross_return").alias("std_return"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
