"""Bar views in SQL, for the comparison queries."""

from __future__ import annotations

_PICK = "first({p} ORDER BY {o}) AS open, max({p}) AS high, min({p}) AS low, last({p} ORDER BY {o}) AS close"


def events(unit: str) -> str:
    return f"SELECT event_type AS symbol, date_trunc('{unit}', ts) AS timestamp, {_PICK.format(p='value', o='ts, event_id')}, CAST(count(*) AS BIGINT) AS volume, count(*) AS trade_count, avg(value) AS vwap FROM events GROUP BY 1, 2"


HOURLY, MINUTE = events("hour"), events("minute")
DAILY = f"SELECT l_returnflag AS symbol, l_shipdate AS timestamp, {_PICK.format(p='l_extendedprice / l_quantity', o='l_orderkey, l_linenumber, l_partkey, l_suppkey')}, CAST(sum(l_quantity) AS BIGINT) AS volume, count(*) AS trade_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS vwap FROM lineitem GROUP BY 1, 2"
ORDERS = f"SELECT o_orderpriority AS symbol, o_orderdate AS timestamp, {_PICK.format(p='o_totalprice', o='o_orderkey')}, CAST(count(*) AS BIGINT) AS volume, count(*) AS trade_count, avg(o_totalprice) AS vwap FROM orders GROUP BY 1, 2"

W = "WINDOW w AS (PARTITION BY symbol, d ORDER BY timestamp), s AS (PARTITION BY symbol, d), h AS (PARTITION BY symbol ORDER BY timestamp)"


def bars(view: str = HOURLY, columns: str = "") -> str:
    """CTEs b (the view), t (with the trade date d) and x (with i, n and ``columns`` over windows w, s, h)."""
    more = f", {columns}" if columns else ""
    return f"WITH b AS ({view}), t AS (SELECT *, CAST(timestamp AS DATE) AS d FROM b), x AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER s AS n{more} FROM t {W})"


def ratio0(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {b} > 0 THEN ({a} - {b}) / {b} ELSE 0.0 END"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"
