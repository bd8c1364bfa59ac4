"""Bars, calendar, cleaning, validation and sources."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.scalars import to_decimal
from barspark.operators import calendar, clean, validate
from barspark.plans.sqlbars import DAILY, HOURLY, MINUTE, ORDERS, r6
from barspark.sources import bars as source

START, END = date(2024, 1, 1), date(2024, 1, 31)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def sessions(spark: SparkSession) -> DataFrame:
    return calendar.nyse_sessions(spark, START, END)


def _bars(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rounded(make(spark, d), "open", "high", "low", "close", "vwap")


def _bar_sql(view: str) -> str:
    return f"SELECT symbol, timestamp, {', '.join(f'{r6(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume, trade_count, {r6('vwap')} AS vwap FROM ({view})"


def minute(spark: SparkSession, d: str) -> DataFrame:
    return source.event_bars(spark, d, "minute")


def _in_sessions(spark: SparkSession, d: str, days: DataFrame, times: DataFrame) -> DataFrame:
    """``days`` with n_events, how many of ``times`` (ts) lie between open and close; the days are a small dimension."""
    met = times.join(F.broadcast(days), F.col("ts").between(F.col("market_open"), F.col("market_close")))
    counts = met.groupBy("trade_date").agg(F.count("*").alias("n_events"))
    return days.join(counts, "trade_date", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def _event_times(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp_ntz").alias("ts"))


def nyse(spark: SparkSession, d: str) -> DataFrame:
    """Per year its sessions and the events within them."""
    days = _in_sessions(spark, d, calendar.nyse_sessions(spark, date(2022, 1, 1), date(2025, 12, 31)), _event_times(spark, d))
    return days.groupBy(F.year("trade_date").cast("int").alias("year")).agg(
        F.count("*").alias("n_sessions"), F.count_if("early").alias("n_early"), F.min("market_open").alias("first_open"), F.max("market_close").alias("last_close"), F.sum("n_events").alias("n_events")
    )


def grid_of_events(spark: SparkSession, d: str) -> DataFrame:
    """Per session the minutes of its grid and those in which something happened."""
    seen = _event_times(spark, d).select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp")).distinct().withColumn("seen", F.lit(1))
    grid = calendar.rth_grid(sessions(spark)).join(seen, "timestamp", "left")
    return grid.groupBy("trade_date").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("seen").alias("n_seen"))


def events_between_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The gaps between sessions and the events that fall into each (its start belongs to it, its end does not)."""
    gaps = calendar.non_rth_intervals(sessions(spark), "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    met = _event_times(spark, d).join(F.broadcast(gaps), (F.col("ts") >= F.col("gap_start")) & (F.col("ts") < F.col("gap_end")))
    counts = met.groupBy("gap_start").agg(F.count("*").alias("n_events"))
    return gaps.join(counts, "gap_start", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


# The sessions' exceptions from 2022 to 2025.
_HOLIDAYS = "2022-01-17 2022-02-21 2022-04-15 2022-05-30 2022-06-20 2022-07-04 2022-09-05 2022-11-24 2022-12-26 2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25 2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25 2025-01-01 2025-01-09 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27 2025-12-25".split()
_EARLY = "2022-11-25 2023-07-03 2023-11-24 2024-07-03 2024-11-29 2024-12-24 2025-07-03 2025-11-28 2025-12-24".split()
_list = lambda days: ", ".join(f"DATE '{d}'" for d in days)
# Summer time lasts from the second Sunday in March to the first one in November.
_SESSIONS = f"""
SELECT d AS trade_date, d + INTERVAL 9 HOUR + INTERVAL 30 MINUTE + z AS market_open, d + (CASE WHEN early THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END) + z AS market_close, early
FROM (SELECT d, d IN ({_list(_EARLY)}) AS early,
        CASE WHEN d >= make_date(year(d), 3, 8) + CAST((7 - dayofweek(make_date(year(d), 3, 8))) % 7 AS INTEGER) AND d < make_date(year(d), 11, 1) + CAST((7 - dayofweek(make_date(year(d), 11, 1))) % 7 AS INTEGER)
             THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS z
      FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2022-01-01', TIMESTAMP '2025-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND d NOT IN ({_list(_HOLIDAYS)}))
"""
_JAN = f"SELECT * FROM ({_SESSIONS}) WHERE trade_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"


def closed_removed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.remove_closed_market_rows(minute(spark, d), sessions(spark)), "open", "high", "low", "close", "vwap")


_RTH = f"SELECT m.* FROM ({MINUTE}) m JOIN ({_JAN}) s ON m.timestamp BETWEEN s.market_open AND s.market_close"


def propagated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.forward_propagate(source.event_bars(spark, d), "1 hour"), "open", "high", "low", "close", "vwap")


def propagated_rth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.clean(minute(spark, d), sessions(spark), True), "open", "high", "low", "close", "vwap")


def _fill_sql(bars: str, grid: str) -> str:
    fill = ", ".join(f"{r6(f'coalesce(last({c} IGNORE NULLS) OVER f, first({c} IGNORE NULLS) OVER g)')} AS {c}" for c in ("open", "high", "low", "close", "vwap"))
    return f"""WITH b AS ({bars}), span AS (SELECT symbol, min(timestamp) AS lo, max(timestamp) AS hi FROM b GROUP BY symbol), grid AS ({grid}), j AS (SELECT grid.symbol, grid.timestamp, open, high, low, close, volume, trade_count, vwap FROM grid LEFT JOIN b USING (symbol, timestamp))
SELECT symbol, timestamp, {fill}, CASE WHEN close IS NULL THEN 0 ELSE volume END AS volume, CASE WHEN close IS NULL THEN 0 ELSE trade_count END AS trade_count, close IS NULL AS imputed
FROM j WINDOW f AS (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def _broken(bars: DataFrame) -> DataFrame:
    """Bars with known faults: nulls and prices out of range in some minutes."""
    m = F.minute("timestamp")
    return bars.withColumn("open", F.when(m % 10 == 3, None).otherwise(F.col("open"))).withColumn("close", F.when(m % 15 == 7, F.col("high") + 1).otherwise(F.col("close"))).withColumn("vwap", F.when(m % 20 == 9, F.lit(float("nan"))).otherwise(F.col("vwap")))


_BROKEN = f"SELECT symbol, timestamp, CASE WHEN minute(timestamp) % 10 = 3 THEN NULL ELSE open END AS open, high, low, CASE WHEN minute(timestamp) % 15 = 7 THEN high + 1 ELSE close END AS close, volume, trade_count, CASE WHEN minute(timestamp) % 20 = 9 THEN CAST('nan' AS DOUBLE) ELSE vwap END AS vwap FROM ({MINUTE})"


def upsert(spark: SparkSession, d: str) -> DataFrame:
    base = source.order_bars(spark, d).groupBy("symbol").agg(F.max("high").alias("high"), F.count("*").alias("n"))
    new = base.where(F.substring("symbol", 1, 1).isin("1", "3")).select("symbol", (F.col("high") * 2).alias("high"), F.lit(0).cast("long").alias("n")).unionAll(spark.createDataFrame([("6-NEW", 1.0, 1)], "symbol string, high double, n long"))
    return source.merge_upsert(base, new, ["symbol"])


_UP = f"SELECT symbol, max(high) AS high, count(*) AS n FROM ({ORDERS}) GROUP BY symbol"

QUERIES = {
    "bars_hourly": _bars(source.event_bars),
    "bars_minute": _bars(minute),
    "bars_daily": source.daily_bars,
    "bars_orders": _bars(source.order_bars),
    "nyse_sessions": nyse,
    "rth_grid": grid_of_events,
    "non_rth_intervals": events_between_sessions,
    "remove_closed_rows": closed_removed,
    "forward_propagate": propagated,
    "forward_propagate_rth": propagated_rth,
    "dq_nulls": lambda spark, d: validate.null_counts(_broken(minute(spark, d))),
    "dq_ohlc": lambda spark, d: validate.ohlc_violations(_broken(minute(spark, d))),
    "dq_completeness_all": lambda spark, d: validate.completeness(source.event_bars(spark, d), 3600),
    "dq_completeness_session": lambda spark, d: validate.completeness(minute(spark, d), 60, sessions(spark)),
    "dq_duplicates": lambda spark, d: validate.duplicate_keys(source.event_bars(spark, d).select("symbol", F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("timestamp"))).withColumnRenamed("count", "n"),
    "merge_upsert": upsert,
    "point_in_time": lambda spark, d: rounded(clean.point_in_time(source.event_bars(spark, d), "2024-01-10 15:00:00", "view"), "open", "high", "low", "close", "vwap"),
    "to_decimal": lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", to_decimal(F.when(F.col("o_orderkey") % 3 == 0, "None").when(F.col("o_orderkey") % 3 == 1, "x1").otherwise(F.col("o_orderkey").cast("string"))).cast("double").alias("amount")),
}

_MIN_GRID = f"SELECT symbol, timestamp FROM (SELECT symbol, lo, hi, unnest(generate_series(market_open, market_close, INTERVAL 1 MINUTE)) AS timestamp FROM span, ({_JAN})) WHERE timestamp BETWEEN lo AND hi"
_GAP = "SELECT symbol, previous, timestamp, CASE WHEN gap < 0 THEN 'closer than' ELSE 'Missing bar(s)' END AS problem FROM (SELECT *, date_diff('microsecond', previous, timestamp) / 1e6 - {p} AS gap FROM (SELECT symbol, timestamp, lag(timestamp) OVER (PARTITION BY {k} ORDER BY timestamp) AS previous FROM ({b})) WHERE previous IS NOT NULL) WHERE abs(gap) > 1"
ORACLE = {
    "bars_hourly": _bar_sql(HOURLY),
    "bars_minute": _bar_sql(MINUTE),
    "bars_daily": f"SELECT symbol, timestamp, open, high, low, close, volume, trade_count, vwap FROM ({DAILY})",
    "bars_orders": _bar_sql(ORDERS),
    "nyse_sessions": f"SELECT CAST(year(trade_date) AS INTEGER) AS year, count(DISTINCT trade_date) AS n_sessions, CAST(count(DISTINCT trade_date) FILTER (WHERE early) AS BIGINT) AS n_early, min(market_open) AS first_open, max(market_close) AS last_close, count(ts) AS n_events FROM ({_SESSIONS}) LEFT JOIN events ON ts BETWEEN market_open AND market_close GROUP BY 1",
    "rth_grid": f"SELECT trade_date, count(*) AS n, min(t) AS first_ts, max(t) AS last_ts, count(m) AS n_seen FROM (SELECT trade_date, unnest(generate_series(market_open, market_close, INTERVAL 1 MINUTE)) AS t FROM ({_JAN})) LEFT JOIN (SELECT DISTINCT date_trunc('minute', ts) AS m FROM events) ON m = t GROUP BY 1",
    "non_rth_intervals": f"WITH s AS ({_JAN}), g AS (SELECT coalesce(lag(market_close) OVER (ORDER BY market_open), TIMESTAMP '2024-01-01') AS gap_start, market_open AS gap_end FROM s UNION ALL SELECT max(market_close), TIMESTAMP '2024-02-01' FROM s) SELECT gap_start, gap_end, count(ts) AS n_events FROM g LEFT JOIN events ON ts >= gap_start AND ts < gap_end GROUP BY 1, 2",
    "remove_closed_rows": _bar_sql(_RTH),
    "forward_propagate": _fill_sql(HOURLY, "SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM span"),
    "forward_propagate_rth": _fill_sql(_RTH, _MIN_GRID),
    "dq_nulls": f"WITH b AS ({_BROKEN}) SELECT * FROM (SELECT 'open' AS \"column\", count(*) FILTER (WHERE open IS NULL) AS n_missing FROM b UNION ALL SELECT 'vwap', count(*) FILTER (WHERE isnan(vwap)) FROM b) WHERE n_missing > 0",
    "dq_ohlc": f"WITH b AS ({_BROKEN}) SELECT * FROM ({' UNION ALL '.join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {r}) AS n FROM b" for r in validate.OHLC)}) WHERE n > 0",
    "dq_completeness_all": _GAP.format(p=3600, k="symbol", b=HOURLY),
    "dq_completeness_session": _GAP.format(p=60, k="symbol, CAST(timestamp AS DATE)", b=_RTH),
    "dq_duplicates": f"SELECT symbol, date_trunc('day', timestamp) AS timestamp, count(*) AS n FROM ({HOURLY}) GROUP BY 1, 2 HAVING count(*) > 1",
    "merge_upsert": f"WITH t AS ({_UP}), s AS (SELECT symbol, high * 2 AS high, 0 AS n FROM t WHERE symbol[1] IN ('1', '3') UNION ALL SELECT '6-NEW', 1.0, 1) SELECT coalesce(s.symbol, t.symbol) AS symbol, CASE WHEN s.symbol IS NULL THEN t.high ELSE s.high END AS high, CAST(CASE WHEN s.symbol IS NULL THEN t.n ELSE s.n END AS BIGINT) AS n FROM t FULL JOIN s ON t.symbol = s.symbol",
    "point_in_time": _bar_sql(f"SELECT * FROM ({HOURLY}) WHERE timestamp = TIMESTAMP '2024-01-10 15:00:00' AND symbol = 'view'"),
    "to_decimal": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_orderkey AS DOUBLE) ELSE 0.0 END AS amount FROM orders",
}
