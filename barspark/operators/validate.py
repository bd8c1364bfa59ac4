"""Data-quality checks: each gives a DataFrame of violations; ``assert_clean`` raises on the first kind found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.clean import ny_date, remove_closed_market_rows

REQUIRED = ["open", "high", "low", "close", "volume", "trade_count", "vwap"]


class InvalidDataException(Exception):
    pass


def schema_errors(bars: DataFrame, require_instant: bool = False) -> list[str]:
    """Missing keys and columns, and wrong types, from the schema alone."""
    types = dict(bars.dtypes)
    errors = [f"missing key column {k}" for k in ("symbol", "timestamp") if k not in types]
    missing = sorted(c for c in REQUIRED if c not in types)
    if missing:
        errors.append("missing columns: " + ", ".join(missing))
    errors += [f"{c} must be a float column, not {types[c]}" for c in ("open", "high", "low", "close", "vwap") if c in types and types[c] not in ("double", "float")]
    errors += [f"{c} must be a number column, not {types[c]}" for c in ("volume", "trade_count") if c in types and types[c] not in ("bigint", "int", "smallint", "double", "float")]
    if types.get("symbol", "string") != "string":
        errors.append("symbol must be a string column")
    if types.get("timestamp", "timestamp") not in ("timestamp", "timestamp_ntz"):
        errors.append("timestamp must be a time column")
    elif require_instant and types.get("timestamp") == "timestamp_ntz":
        errors.append("timestamp must be UTC, not without a zone")
    return errors


def null_counts(bars: DataFrame) -> DataFrame:
    """(column, n_missing) of the columns with null or NaN: one pass over the table."""
    types = dict(bars.dtypes)
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))
    counts = bars.agg(*[F.count_if(bad(c)).alias(c) for c in bars.columns if c not in ("symbol", "timestamp")])
    return counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("column", "n_missing")).where("n_missing > 0")


OHLC = {"low > high": "low > high", "open < low": "open < low", "open > high": "open > high", "close < low": "close < low", "close > high": "close > high"}


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """(rule, n) of the price rules that some row breaks: one pass."""
    counts = bars.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in OHLC.items()])
    return counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("rule", "n")).where("n > 0")


def duplicate_keys(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "timestamp").count().where("count > 1")


def completeness(bars: DataFrame, period_seconds: int, sessions: DataFrame | None = None, tolerance: int = 1) -> DataFrame:
    """(symbol, previous, timestamp, problem) for neighbours that are not one period apart.

    With ``sessions`` only rows on the session grid count, and neighbours of one New York day are compared.
    """
    rows = (bars if sessions is None else remove_closed_market_rows(bars, sessions)).select("symbol", "timestamp").distinct()
    keys = ["symbol"] if sessions is None else ["symbol", "_day"]
    rows = rows if sessions is None else rows.withColumn("_day", ny_date())
    before = F.lag("timestamp").over(Window.partitionBy(*keys).orderBy("timestamp"))
    gap = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / 1e6
    found = rows.withColumn("previous", before).where("previous IS NOT NULL").withColumn("gap", gap - period_seconds).where(F.abs("gap") > tolerance)
    return found.select("symbol", "previous", "timestamp", F.when(F.col("gap") < 0, "closer than").otherwise("Missing bar(s)").alias("problem"))


def assert_clean(bars: DataFrame, period_seconds: int = 60, sessions: DataFrame | None = None, require_instant: bool = False) -> None:
    """Raise InvalidDataException for the first check that fails: columns, nulls, prices, zone, completeness."""
    errors = schema_errors(bars, require_instant)
    if errors:
        raise InvalidDataException("; ".join(errors))
    if missing := null_counts(bars).collect():
        raise InvalidDataException("missing values in " + ", ".join(sorted(r["column"] for r in missing)))
    if wrong := ohlc_violations(bars).collect():
        raise InvalidDataException("; ".join(sorted(f"{r['rule']} ({r['n']})" for r in wrong)))
    if gaps := completeness(bars, period_seconds, sessions).take(1):
        raise InvalidDataException(f"{gaps[0]['problem']} {period_seconds} s: {gaps[0]['symbol']} at {gaps[0]['timestamp']}")


def check(bars: DataFrame, **options) -> bool:
    try:
        assert_clean(bars, **options)
    except InvalidDataException:
        return False
    return True


def require_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``frame`` with just these columns; ValueError names those it lacks."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return frame.select(*columns)
