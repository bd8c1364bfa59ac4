"""Window specifications and session columns shared by features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SESSION = ["symbol", "trade_date"]


def with_trade_date(bars: DataFrame) -> DataFrame:
    """Adds trade_date: the New York date of an instant, the plain date of a time without zone."""
    if "trade_date" in bars.columns:
        return bars
    ts = F.col("timestamp")
    if dict(bars.dtypes)["timestamp"] == "timestamp":
        return bars.withColumn("trade_date", F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), "America/New_York")))
    return bars.withColumn("trade_date", F.to_date(ts))


def session() -> WindowSpec:
    return Window.partitionBy(*SESSION).orderBy("timestamp")


def whole_session() -> WindowSpec:
    return Window.partitionBy(*SESSION)


def history() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("timestamp")


def trailing(spec: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return spec.rowsBetween(-(n - 1), 0)


def running_sum(frame: DataFrame, name: str, value: Column, order: list[str], block: Column, own: list[str] | None = None) -> DataFrame:
    """:func:`running_sums` of one value."""
    return running_sums(frame, {name: value}, order, block, own)


def running_sums(frame: DataFrame, values: dict[str, Column], order: list[str], block: Column, own: list[str] | None = None) -> DataFrame:
    """Adds, for each name, the sum of its value over all rows up to this one in ``order``, per ``own`` columns.

    ``block`` must grow with the order (a day of the first order column, say): sums per block, a small table, give each
    block's start, and the rest is a window per block, so no task holds all rows.
    """
    own, names = own or [], list(values)
    rows = frame.withColumns({f"_value_{n}": v for n, v in values.items()}).withColumn("_block", block)
    starts = rows.groupBy(*own, "_block").agg(*[F.sum(f"_value_{n}").alias(f"_total_{n}") for n in names])
    blocks = Window.partitionBy(*own).orderBy("_block")
    starts = starts.withColumns({f"_start_{n}": F.sum(f"_total_{n}").over(blocks) - F.col(f"_total_{n}") for n in names}).withColumnsRenamed({c: f"_own_{c}" for c in own}).withColumnRenamed("_block", "_own_block")
    met = F.col("_block").eqNullSafe(F.col("_own_block"))
    for c in own:
        met = met & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    within = Window.partitionBy(*own, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(starts, met, "left")
    return joined.select(*[c for c in frame.columns if c not in names], *[(F.col(f"_start_{n}") + F.sum(f"_value_{n}").over(within)).alias(n) for n in names])
