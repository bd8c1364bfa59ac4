"""Cleaning: closed-market rows and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.scans import nearest_known

PRICES = ["open", "high", "low", "close", "vwap"]
COUNTS = ["volume", "trade_count"]


def ny_date(ts: str = "timestamp"):
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col(ts)))


def remove_closed_market_rows(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows that stand exactly on the one-minute grid of a session (UTC times without zone).

    A broadcast of the session dimension (250 rows a year) instead of the grid: open <= time <= close, whole minute.
    """
    s = F.broadcast(sessions.select(F.col("trade_date").alias("_d"), "market_open", "market_close"))
    on_minute = F.date_trunc("minute", "timestamp").cast("timestamp_ntz") == F.col("timestamp")
    return bars.join(s, (ny_date() == F.col("_d")) & F.col("timestamp").between(F.col("market_open"), F.col("market_close")) & on_minute, "left_semi")


def expected_times(bars: DataFrame, step: str, sessions: DataFrame | None = None) -> DataFrame:
    """(symbol, timestamp): each symbol's grid between its first and last bar, of sessions or of fixed steps."""
    span = bars.groupBy("symbol").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    if sessions is None:
        return span.select("symbol", F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("timestamp"))
    days = span.join(F.broadcast(sessions), F.col("market_close").between(F.col("lo"), F.col("hi")) | F.col("market_open").between(F.col("lo"), F.col("hi")) | ((F.col("market_open") <= F.col("lo")) & (F.col("market_close") >= F.col("hi"))))
    return days.select("symbol", "lo", "hi", F.explode(F.sequence("market_open", "market_close", F.expr(f"interval {step}"))).alias("timestamp")).where("timestamp BETWEEN lo AND hi").select("symbol", "timestamp")


def forward_propagate(bars: DataFrame, step: str = "1 minute", sessions: DataFrame | None = None, mark_imputed: bool = True) -> DataFrame:
    """Bars on the whole grid: gaps repeat the last bar (the next one before the first), without volume.

    A row whose close is null counts as inserted and loses its volume. Rows off the grid are dropped. A symbol without
    grid times keeps its rows. Duplicate keys are an error of the input: see ``validate.duplicate_keys``. Values carry
    over from day to day, so a symbol is as many tasks' work as it has days; the joined grid is read twice.
    """
    grid = expected_times(bars, step, sessions)
    columns = [c for c in bars.columns if c not in ("symbol", "timestamp", "imputed")]
    joined = grid.join(bars.drop("imputed"), ["symbol", "timestamp"], "left").withColumn("imputed", F.col("close").isNull())
    known = nearest_known(joined, ["symbol"], ["timestamp"], F.to_date("timestamp"), {f"_past_{c}": c for c in columns}, {f"_ahead_{c}": c for c in columns})
    filled = known.select("symbol", "timestamp", *[F.coalesce(f"_past_{c}", f"_ahead_{c}").alias(c) for c in columns], "imputed")
    filled = filled.withColumns({c: F.when(F.col("imputed"), F.lit(0)).otherwise(F.col(c)).cast("bigint") for c in COUNTS if c in columns})
    if sessions is not None:
        none = bars.join(grid.select("symbol").distinct(), "symbol", "left_anti")
        filled = filled.unionByName(none.withColumn("imputed", F.lit(False)).select(*filled.columns))
    return filled if mark_imputed else filled.drop("imputed")


def to_utc(bars: DataFrame, zone: str = "UTC") -> DataFrame:
    """Times as instants: one without a zone is read as local to ``zone``, an instant stays what it is."""
    if dict(bars.dtypes)["timestamp"] == "timestamp":
        return bars
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("timestamp"))
    # A time without zone becomes an instant in the session's zone, whatever that is.
    return bars.withColumn("timestamp", F.convert_timezone(F.lit("UTC"), F.current_timezone(), utc).cast("timestamp"))


def point_in_time(bars: DataFrame, time: Column | str, symbol: str | None = None) -> DataFrame:
    """The bars of one time, of all symbols or of one: a filter that the Parquet scan gets."""
    at = F.lit(time).cast(dict(bars.dtypes)["timestamp"]) if isinstance(time, str) else time
    found = bars.where(F.col("timestamp") == at)
    return found if symbol is None else found.where(F.col("symbol") == symbol)


def clean(bars: DataFrame, sessions: DataFrame, mark_imputed: bool = False) -> DataFrame:
    """Session rows only, then gaps on the minute grid."""
    return forward_propagate(remove_closed_market_rows(bars, sessions), "1 minute", sessions, mark_imputed)
