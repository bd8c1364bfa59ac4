"""Features from other symbols: exact alignment on the timestamp."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import ratio0
from barspark.operators.recursive import recursive_features


def pivot_close(reference: DataFrame, symbols: Sequence[str], value: str = "close", prefix: str = "_ref_") -> DataFrame:
    """One row per timestamp with a column per reference symbol: one conditional aggregation."""
    return reference.where(F.col("symbol").isin(list(symbols))).groupBy("timestamp").agg(*[F.max(F.when(F.col("symbol") == s, F.col(value))).alias(f"{prefix}{s}") for s in symbols])


def close_vs_symbol(bars: DataFrame, reference: DataFrame, symbol: str, name: Callable[[str], str] = "close_{}_pct_diff".format) -> DataFrame:
    """:func:`close_vs_reference` for one symbol, which the reference must hold: ValueError where it is absent."""
    if reference.where(F.col("symbol") == symbol).isEmpty():
        raise ValueError(f"no bars of {symbol}")
    return close_vs_reference(bars, reference, [symbol], name)


def close_vs_reference(bars: DataFrame, reference: DataFrame, symbols: Sequence[str], name: Callable[[str], str] = "close_{}_pct_diff".format) -> DataFrame:
    """ratio0(close, the symbol's close at the same time), 0 where it has none; symbols in name order."""
    symbols = sorted(symbols)
    if not symbols:
        return bars
    joined = bars.join(pivot_close(reference, symbols), "timestamp", "left")
    return joined.select(*[F.col(c) for c in bars.columns], *[ratio0(F.col("close"), F.col(f"_ref_{s}")).alias(name(s)) for s in symbols])


def reference_rsi(bars: DataFrame, reference: DataFrame, symbols: Sequence[str], period: int, flat: float = 50.0, name: Callable[[str, int], str] = "rsi_{}_{}".format) -> DataFrame:
    """The reference symbols' RSI, each on its own history, at the same time; 0 where there is none."""
    symbols = sorted(symbols)
    if not symbols:
        return bars
    with_rsi = recursive_features(reference.where(F.col("symbol").isin(symbols)), rsi=[period], flat=flat)
    joined = bars.join(pivot_close(with_rsi, symbols, f"rsi_{period}"), "timestamp", "left")
    return joined.select(*[F.col(c) for c in bars.columns], *[F.coalesce(F.col(f"_ref_{s}"), F.lit(0.0)).alias(name(s, period)) for s in symbols])


def pair_align(bars: DataFrame, a: str, b: str) -> DataFrame:
    """(timestamp, close_a, close_b) where both symbols have a bar."""
    x = bars.where(F.col("symbol") == a).select("timestamp", F.col("close").alias("close_a"))
    return x.join(bars.where(F.col("symbol") == b).select("timestamp", F.col("close").alias("close_b")), "timestamp")


def swapped_lookup(bars: DataFrame, other: DataFrame, symbol: str, value: str) -> DataFrame:
    """Adds ``value`` of ``symbol`` in ``other`` at each row's time as other_``value`` (null where there is none)."""
    o = other.where(F.col("symbol") == symbol).select("timestamp", F.col(value).alias(f"other_{value}"))
    return bars.join(o, "timestamp", "left").select(*bars.columns, f"other_{value}")
