"""Causal features as window expressions.

Every function takes and returns a bar frame; features of one call share one window node, and Spark reuses one
exchange for all windows over a symbol. "Not yet known" is 0, as in the bar frames this engine is made for. Session
features restart each trading day, history features cross days. ``name`` arguments rename the new columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barspark.functions.scalars import at_least, ratio0, std_tag
from barspark.operators.windows import history, session, trailing, whole_session, with_trade_date

Naming = Callable[[int], str]


def bars_until_close(bars: DataFrame, name: str = "bars_until_close") -> DataFrame:
    return with_trade_date(bars).withColumn(name, F.count("*").over(whole_session()) - F.row_number().over(session()))


def bars_since_open(bars: DataFrame, name: str = "bars_since_open") -> DataFrame:
    return with_trade_date(bars).withColumn(name, (F.row_number().over(session()) - 1).cast("bigint"))


def pct_change(bars: DataFrame, lags: Sequence[int], name: Naming = "pct_change_{}".format) -> DataFrame:
    """(c - c[-b]) / c[-b] within the session; 0 where c[-b] is missing or 0."""
    for b in lags:
        at_least("lag", b, 1)
    old = lambda b: F.lag("close", b).over(session())
    return with_trade_date(bars).withColumns({name(b): F.when(old(b) != 0, (F.col("close") - old(b)) / old(b)).otherwise(F.lit(0.0)) for b in lags})


def _full(spec: WindowSpec, n: int) -> Column:
    return F.count("*").over(trailing(spec, n)) == n


def rolling_zscore(bars: DataFrame, columns: Sequence[str], window: int, name: Callable[[str, int], str] = "{}_zscore_{}".format) -> DataFrame:
    """(x - mean) / population std of the last ``window`` bars of the session; 0 while incomplete or flat."""
    at_least("window", window, 1)
    w = trailing(session(), window)
    z = lambda c: F.when(_full(session(), window) & (F.stddev_pop(c).over(w) > 0), (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(F.lit(0.0))
    return with_trade_date(bars).withColumns({name(c, window): z(c) for c in columns})


def volume_roll_mean(bars: DataFrame, windows: Sequence[int], name: Naming = "volume_roll_mean_{}".format) -> DataFrame:
    for n in windows:
        at_least("window", n, 1)
    return with_trade_date(bars).withColumns({name(n): F.when(_full(session(), n), F.avg("volume").over(trailing(session(), n))).otherwise(F.lit(0.0)) for n in windows})


def rolling_vwap(bars: DataFrame, window: int, name: Naming = "typical_vwap_{}_pct_diff".format) -> DataFrame:
    """The typical price against the volume-weighted one of the last ``window`` bars of the session."""
    at_least("window", window, 1)
    typical, volume, w = (F.col("high") + F.col("low") + F.col("close")) / 3, F.greatest(F.col("volume").cast("double"), F.lit(0.0)), trailing(session(), window)
    total = F.sum(volume).over(w)
    vwap = F.when(total > 0, F.sum(typical * volume).over(w) / total)
    return with_trade_date(bars).withColumn(name(window), ratio0(typical, vwap))


def close_sma(bars: DataFrame, periods: Sequence[int], name: Naming = "close_sma_{}_pct_diff".format) -> DataFrame:
    for p in periods:
        at_least("period", p, 1)
    mean = lambda p: F.when(_full(history(), p), F.avg("close").over(trailing(history(), p)))
    return bars.withColumns({name(p): ratio0(F.col("close"), mean(p)) for p in periods})


def bollinger(bars: DataFrame, period: int, k: float, name: Callable[[str, int, str], str] = "close_bb_{}_{}_{}_pct_diff".format) -> DataFrame:
    """The close against mean + k * std and mean - k * std (population) of the last ``period`` bars."""
    at_least("period", period, 1)
    if k <= 0:
        raise ValueError("the multiplier must be above 0")
    w = trailing(history(), period)
    band = lambda s: F.when(_full(history(), period), F.avg("close").over(w) + F.lit(float(s * k)) * F.stddev_pop("close").over(w))
    return bars.withColumns({name(side, period, std_tag(k)): ratio0(F.col("close"), band(s)) for side, s in (("upper", 1), ("lower", -1))})


def close_bar_vwap(bars: DataFrame, name: str = "close_vwap_pct_diff") -> DataFrame:
    return bars.withColumn(name, F.when(F.col("vwap") != 0, (F.col("close") - F.col("vwap")) / F.col("vwap")).otherwise(F.lit(0.0)))


def lag_pct_diff(bars: DataFrame, column: str, lags: Sequence[int], name: Callable[[str, int], str] = "{}_lag_{}_pct_diff".format) -> DataFrame:
    """ratio0(x, x[-n]) over the symbol's whole history."""
    if column not in bars.columns:
        raise ValueError(f"no column {column}")
    for n in lags:
        at_least("lag", n, 1)
    return bars.withColumns({name(column, n): ratio0(F.col(column), F.lag(column, n).over(history())) for n in lags})


def lagged_difference(bars: DataFrame, a: str, b: str, lags: Sequence[int], name: Callable[[str, str, int], str] = "{}_minus_{}_lag_{}".format) -> DataFrame:
    """a[-n] - b[-n], 0 where there is no such bar: ``{a}_minus_{b}_lag_{n}``."""
    for n in lags:
        at_least("lag", n, 0)
    return bars.withColumns({name(a, b, n): F.lag(F.col(a) - F.col(b), n, 0.0).over(history()) if n else F.col(a) - F.col(b) for n in lags})


def close_lag_vector(bars: DataFrame, longest: int, name: str = "close_lags") -> DataFrame:
    """ratio0(c, c[-n]) for n = 1..longest as one array: very wide lag sets stay one column and one window."""
    at_least("lag", longest, 1)
    past = F.collect_list("close").over(history().rowsBetween(-longest, -1))
    return bars.withColumn("_past", past).withColumn(name, F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: ratio0(F.col("close"), F.get("_past", F.size("_past") - n)))).drop("_past")


def day_of_week(bars: DataFrame, name: str = "day_of_week") -> DataFrame:
    """Monday is 1, Sunday 7."""
    return with_trade_date(bars).withColumn(name, (F.weekday("trade_date") + 1).cast("int"))


def true_range(bars: DataFrame, name: str = "true_range") -> DataFrame:
    before = F.lag("close").over(history())
    return bars.withColumn(name, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def directional_movement(bars: DataFrame, name: Callable[[str], str] = "{}_dm".format) -> DataFrame:
    up, down = F.col("high") - F.lag("high").over(history()), F.lag("low").over(history()) - F.col("low")
    side = lambda a, b: F.when((a > b) & (a > 0), a).otherwise(F.lit(0.0))
    return bars.withColumns({name("plus"): side(up, down), name("minus"): side(down, up)})


def last_close_per_day(bars: DataFrame) -> DataFrame:
    return with_trade_date(bars).groupBy("symbol", "trade_date").agg(F.max_by("close", "timestamp").alias("close"))


def daily_return(bars: DataFrame, name: str = "daily_return") -> DataFrame:
    """Simple returns of the last closes of consecutive days; the first day has none and is left out."""
    from pyspark.sql import Window

    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    return last_close_per_day(bars).withColumn(name, F.when(before != 0, F.col("close") / before - 1)).where(F.col(name).isNotNull())


def session_forward_return(bars: DataFrame, horizon: int, name: str = "forward_return") -> DataFrame:
    """c[+h] / c - 1 within the session where c > 0, else null."""
    at_least("horizon", horizon, 1)
    return with_trade_date(bars).withColumn(name, F.when(F.col("close") > 0, F.lead("close", horizon).over(session()) / F.col("close") - 1))
