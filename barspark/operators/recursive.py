"""Features whose value depends on the one before: Wilder averages, ATR, ADX, RSI, EMA.

Each is a recurrence x = a * (x before) + b whose a and b follow from a bar, the bar before and the bar's number, so
all run as affine scans over days (see :mod:`scans`): a symbol's history spreads over as many tasks as it has days.
A Wilder average with period p adds up 1 / p of each of the first p values, which gives their mean, and goes on from
there. ADX takes a second scan over the directional indicators of the first. A null or NaN price makes every later
value of its symbol NaN: ``validate.null_counts`` finds them before.

A scan reads its input twice, so bars that are expensive to make should be cached or written before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import at_least
from barspark.operators.scans import affine_scan, block_places

def _from(k: int) -> Column:
    """Rows from number ``k`` on."""
    return F.col("_k") >= k


def wilder(x: Column, p: int, first: int = 0) -> tuple[Column, Column]:
    """The map of a Wilder average over the values from row ``first`` on: their mean at row first + p - 1, then (old * (p - 1) + x) / p."""
    a = F.when(_from(first + p), (p - 1) / p).otherwise(1.0)
    return a, F.when(_from(first), x / p).otherwise(0.0)


def smoothed(x: Column, span: int) -> tuple[Column, Column]:
    alpha = 2 / (span + 1)
    return F.when(_from(1), 1 - alpha).otherwise(0.0), F.when(_from(1), alpha * x).otherwise(x)


def _share(a: Column, b: Column) -> Column:
    """100 a / b, 0 where b is not above 0; NaN stays."""
    return F.when(F.isnan(b), b).when(b > 0, 100 * a / b).otherwise(0.0)


def recursive_features(bars: DataFrame, *, atr: Sequence[int] = (), adx: Sequence[int] = (), rsi: Sequence[int] = (), ema: Sequence[int] = (), flat: float = 50.0, name: Callable[[str, int], str] | None = None) -> DataFrame:
    """Adds atr_p, plus_di_p, minus_di_p, adx_p, rsi_p and close_ema_s_pct_diff. ``flat``: the RSI of a flat market. ``name`` gives other
    names: of a kind (atr, plus_di, minus_di, adx, rsi, ema) and a period.

    Values not known yet are 0: up to row p - 2 for averages, p - 1 for the RSI, s - 2 for the EMA.
    """
    for p in (*atr, *adx, *ema):
        at_least("period", p, 1)
    for p in rsi:
        at_least("RSI period", p, 2 if flat == 50.0 else 1)
    day, order, own = F.to_date("timestamp"), ["timestamp"], ["symbol"]
    high, low, close = (F.col(c).cast("double") for c in ("high", "low", "close"))
    placed = block_places(bars, own, order, day, {"_ph": high, "_pl": low, "_pc": close}, "_k")
    first = ~_from(1)
    ranged = F.when(first, high - low).otherwise(F.greatest(high - low, F.abs(high - F.col("_pc")), F.abs(low - F.col("_pc"))))
    up, down = high - F.col("_ph"), F.col("_pl") - low
    steps = {
        "_tr": F.when(high.isNull() | low.isNull() | (~first & F.col("_pc").isNull()), float("nan")).otherwise(ranged),
        "_plus": F.when(~first & (up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when(~first & (down > up) & (down > 0), down).otherwise(0.0),
        "_gain": F.when(first, 0.0).otherwise(_above(close - F.col("_pc"))), "_loss": F.when(first, 0.0).otherwise(_above(F.col("_pc") - close)),
    }
    rows = placed.withColumns(steps)
    maps = {f"_tr_{p}": wilder(F.col("_tr"), p) for p in {*atr, *adx}}
    maps |= {f"_{s}_{p}": wilder(F.col(f"_{s}"), p) for p in adx for s in ("plus", "minus")}
    maps |= {f"_{s}_{p}": wilder(F.col(f"_{s}"), p, 1) for p in rsi for s in ("gain", "loss")}
    maps |= {f"_ema_{s}": smoothed(close, s) for s in ema}
    known = lambda x, k: F.when(_from(k), x).otherwise(F.when(F.isnan(x), x).otherwise(0.0))
    out: dict[tuple[str, int], Column] = {}
    if maps:
        rows = affine_scan(rows, maps, own, order, day)
    if adx:
        di = {f"_{s}_di_{p}": known(_share(F.col(f"_{s}_{p}"), F.col(f"_tr_{p}")), p - 1) for p in adx for s in ("plus", "minus")}
        rows = rows.withColumns(di)
        gap = {p: _share(F.abs(F.col(f"_plus_di_{p}") - F.col(f"_minus_di_{p}")), F.col(f"_plus_di_{p}") + F.col(f"_minus_di_{p}")) for p in adx}
        rows = affine_scan(rows, {f"_dx_{p}": wilder(gap[p], p) for p in adx}, own, order, day)
    for p in atr:
        out["atr", p] = known(F.col(f"_tr_{p}"), p - 1)
    for p in adx:
        out |= {("plus_di", p): F.col(f"_plus_di_{p}"), ("minus_di", p): F.col(f"_minus_di_{p}"), ("adx", p): known(F.col(f"_dx_{p}"), p - 1)}
    for p in rsi:
        g, s = F.col(f"_gain_{p}"), F.col(f"_loss_{p}")
        value = F.when(F.isnan(g) | F.isnan(s), float("nan")).when(s > 0, 100 - 100 / (1 + g / s)).when(g > 0, 100.0).otherwise(flat)
        out["rsi", p] = known(value, p)
    for span in ema:
        e = known(F.col(f"_ema_{span}"), span - 1)
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        out["ema", span] = F.when(fine(close) & fine(e) & (e > 0), (close - e) / e).otherwise(0.0)
    usual = lambda kind, p: f"close_ema_{p}_pct_diff" if kind == "ema" else f"{kind}_{p}"
    return rows.select(*bars.columns, *[c.alias((name or usual)(*k)) for k, c in out.items()])


def _above(x: Column) -> Column:
    """The part above 0; unknown values stay unknown."""
    return F.when(x.isNull() | F.isnan(x), float("nan")).otherwise(F.greatest(x, F.lit(0.0)))

