"""Column functions: guarded arithmetic, fees, names and durations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regulatory fee rates per share and the cap of the sale fee.
CAT_RATE = 0.00003
SALE_RATE = 0.000166
SALE_CAP = 8.30


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite (Spark orders NaN above everything)."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ratio0(a: Column, b: Column) -> Column:
    """(a - b) / b for finite a and finite b > 0, else 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(finite(a) & finite(b) & (b > 0), (a - b) / b).otherwise(F.lit(0.0))


def round_up_cent(x: Column) -> Column:
    """Up to the next cent, with the double artefact of x * 100 kept (1.10 gives 1.11)."""
    return F.ceil(x * 100) / F.lit(100.0)


def regulatory_fee(side: Column, qty: Column) -> Column:
    """Both sides pay per share; sales pay a capped fee besides, each rounded up to a cent."""
    base = round_up_cent(F.lit(CAT_RATE) * qty)
    return base + F.when(side == "sell", round_up_cent(F.least(F.lit(SALE_RATE) * qty, F.lit(SALE_CAP)))).otherwise(F.lit(0.0))


def slipped(price: Column, side: Column, bps: float) -> Column:
    """The fill price: buys pay more, sales get less; nothing for bps <= 0."""
    if bps <= 0:
        return price
    return F.when(side == "buy", price * (1 + bps / 10000)).otherwise(price * (1 - bps / 10000))


def min_win_rate_column(tp: Column, sl: Column, cost: Column) -> Column:
    """:func:`min_win_rate` of each row."""
    return (sl + cost) / (tp + sl)


def min_win_rate(tp: float, sl: float, cost: float) -> float:
    """The share of winners at which trades of (tp, sl) with ``cost`` break even."""
    return (sl + cost) / (tp + sl)


def to_decimal(text: Column, default: str = "0") -> Column:
    """Decimal(38, 6) of a string; '', 'None', 'null' and what is no number give ``default``."""
    empty = text.isNull() | text.isin("", "None", "null")
    return F.coalesce(F.when(~empty, text.try_cast("decimal(38,6)")), F.lit(default).cast("decimal(38,6)"))


def std_tag(k: float) -> str:
    """1.0 gives '1std', 1.5 gives '1p5std'; six digits after the point count. ValueError for a multiplier not above 0."""
    if not k > 0:
        raise ValueError("the multiplier must be above 0")
    return f"{k:.6f}".rstrip("0").rstrip(".").replace(".", "p") + "std"


def timeframe(amount: int, unit: str) -> timedelta:
    """The duration of a time frame; a month has 30 days. Other units raise ValueError."""
    one = {"Minute": timedelta(minutes=1), "Hour": timedelta(hours=1), "Day": timedelta(days=1), "Week": timedelta(weeks=1), "Month": timedelta(days=30)}
    if unit not in one:
        raise ValueError(f"unsupported time frame unit: {unit}")
    return one[unit] * amount


def at_least(name: str, value: float, least: float) -> None:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")
