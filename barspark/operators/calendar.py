"""The New York stock exchange's sessions from rules, and the grids made of them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Closures outside the rules.
AD_HOC_CLOSURES = {
    date(2001, 9, 11), date(2001, 9, 12), date(2001, 9, 13), date(2001, 9, 14), date(2004, 6, 11), date(2007, 1, 2),
    date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9),
}


def easter(year: int) -> date:
    """Western Easter Sunday."""
    a, b, c = year % 19, year // 100, year % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return date(year, f // 31, f % 31 + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; n = -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def _observed(day: date) -> date | None:
    """Saturday holidays are kept on Friday, Sunday ones on Monday; a Saturday New Year is not kept at all."""
    if day.weekday() == 5:
        return None if (day.month, day.day) == (1, 1) else day - timedelta(days=1)
    return day + timedelta(days=1) if day.weekday() == 6 else day


def holidays(year: int) -> set[date]:
    found = {
        _observed(date(year, 1, 1)), _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(days=2), _nth(year, 5, 0, -1),
        _observed(date(year, 6, 19)) if year >= 2022 else None, _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25)),
    }
    return {d for d in found if d} | {d for d in AD_HOC_CLOSURES if d.year == year}


def early_closes(year: int) -> set[date]:
    """The day after Thanksgiving, and July 3 and December 24 where they are trading days."""
    days = {_nth(year, 11, 3, 4) + timedelta(days=1), date(year, 7, 3), date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def nyse_sessions(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(trade_date, market_open, market_close, early) with UTC times without zone; one row per session (250 a year)."""
    days = spark.createDataFrame([(d,) for y in range(start.year, end.year + 1) for d in sorted(holidays(y))], "trade_date date")
    half = spark.createDataFrame([(d, True) for y in range(start.year, end.year + 1) for d in sorted(early_closes(y))], "trade_date date, early boolean")
    every = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("trade_date")).where(F.weekday("trade_date") < 5)
    open_days = every.join(F.broadcast(days), "trade_date", "left_anti").join(F.broadcast(half), "trade_date", "left").withColumn("early", F.coalesce("early", F.lit(False)))
    at = lambda h: F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.concat(F.col("trade_date").cast("string"), h).cast("timestamp_ntz"))
    return open_days.select("trade_date", at(F.lit(" 09:30:00")).alias("market_open"), at(F.when(F.col("early"), " 13:00:00").otherwise(" 16:00:00")).alias("market_close"), "early")


def rth_grid(sessions: DataFrame, step: str = "1 minute", clip: tuple[str, str] | None = None) -> DataFrame:
    """(trade_date, timestamp) from open to close, both included."""
    grid = sessions.select("trade_date", F.explode(F.sequence("market_open", "market_close", F.expr(f"interval {step}"))).alias("timestamp"))
    if clip:
        grid = grid.where(F.col("timestamp").between(F.lit(clip[0]).cast("timestamp_ntz"), F.lit(clip[1]).cast("timestamp_ntz")))
    return grid


def non_rth_intervals(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """(gap_start, gap_end): before the first session, between sessions and after the last.

    The window runs over the session dimension, 250 rows a year.
    """
    w = Window.orderBy("market_open")
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = sessions.where((F.col("market_close") >= lo) & (F.col("market_open") <= hi))
    gaps = inside.select(F.coalesce(F.lag("market_close").over(w), lo).alias("gap_start"), F.col("market_open").alias("gap_end"))
    tail = inside.agg(F.coalesce(F.max("market_close"), lo).alias("gap_start")).select("gap_start", hi.alias("gap_end"))
    return gaps.unionAll(tail).where("gap_start < gap_end")
