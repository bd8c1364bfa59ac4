"""Backtests: relational for orders that are known, a grouped function for strategies that are code.

Orders are (symbol, side, qty, type, submitted, seq). Market orders fill at the close of the first bar at or after
their time; other types stay pending. The ledger is running sums, the average cost an affine scan, both by days.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.scalars import regulatory_fee, round_up_cent, slipped
from barspark.operators.scans import affine_scan, nearest_known
from barspark.operators.splits import ordinal
from barspark.operators.windows import running_sum, running_sums
from barspark.session import checkpointed


def with_ids(orders: DataFrame) -> DataFrame:
    """sim-0, sim-1, ... in the order of ``seq``; given ids stay, but count.

    Numbers come from the counts of blocks of ``seq``: its days' worth of leading digits for texts, 65,536 for numbers.
    """
    block = F.substring("seq", 1, 8) if dict(orders.dtypes)["seq"] == "string" else F.floor(F.col("seq") / 65536)
    numbered = ordinal(orders, ["seq"], "_n", block)
    given = F.col("order_id") if "order_id" in orders.columns else F.lit(None).cast("string")
    return numbered.withColumn("order_id", F.coalesce(given, F.concat(F.lit("sim-"), F.col("_n").cast("string")))).drop("_n")


def order_violations(orders: DataFrame) -> DataFrame:
    """Orders with a quantity not above 0, or without the limit or stop price their type needs."""
    missing = lambda c: F.col(c).isNull() if c in orders.columns else F.lit(True)
    why = F.when(F.col("qty") <= 0, "quantity must be above 0").when(F.col("type").isin("limit", "stop_limit") & missing("limit_price"), "limit price missing").when(F.col("type").isin("stop", "stop_limit") & missing("stop_price"), "stop price missing")
    return orders.withColumn("violation", why).where("violation IS NOT NULL")


def market_fills(orders: DataFrame, bars: DataFrame, slippage_bps: float = 0.0, fee: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Fills of market orders: a forward as-of match by a sort per symbol and day, in which the next day's first bar carries over; no range join.

    ``fee`` maps (side, qty, price) to a column; the default is the regulatory fee. Fees are rounded up to a cent.
    """
    o = orders.where("type = 'market'")
    columns = [c for c in o.columns if c not in ("symbol",)]
    marked = o.select("symbol", F.col("submitted").alias("_t"), F.lit(0).alias("_bar"), F.struct(*columns).alias("_o"), F.lit(None).cast("struct<timestamp:timestamp_ntz,close:double>").alias("_b"))
    b = bars.where(F.col("close").isNotNull()).select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_bar"), F.lit(None).cast(marked.schema["_o"].dataType).alias("_o"), F.struct(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("close").cast("double").alias("close")).alias("_b"))
    # At one time orders come before the bar, so it is the next one for them.
    known = nearest_known(marked.unionByName(b), ["symbol"], ["_t", "_bar"], F.to_date("_t"), ahead={"_met": "_b"})
    met = known.where("_bar = 0 AND _met IS NOT NULL").drop("_b").withColumnRenamed("_met", "_b")
    filled = met.select("symbol", *[F.col(f"_o.{c}").alias(c) for c in columns], F.col("_b.timestamp").alias("filled"), slipped(F.col("_b.close"), F.col("_o.side"), slippage_bps).alias("price"))
    cost = fee(F.col("side"), F.col("qty"), F.col("price")) if fee else regulatory_fee(F.col("side"), F.col("qty"))
    return filled.withColumn("fee", round_up_cent(cost))


def ledger(fills: DataFrame, cash: float, account: str | None = None) -> DataFrame:
    """Running cash of the account and running quantity per symbol after each fill, by (filled, seq).

    Cash is one running sum per account (``account`` names its column), made of sums by day.
    """
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    own = [account] if account else []
    one = Window.partitionBy(*own, "symbol").orderBy("filled", "seq")
    book = running_sum(fills, "cash", -sign * F.col("price") * F.col("qty") - F.col("fee"), ["filled", "seq"], F.to_date("filled"), own)
    return book.withColumn("cash", F.lit(cash) + F.col("cash")).withColumn("position", F.sum(sign * F.col("qty")).over(one))


def oversells(book: DataFrame) -> DataFrame:
    """Fills that sell more than is held."""
    return book.where("position < 0")


def cost_basis(fills: DataFrame) -> DataFrame:
    """``fills`` with the symbol's position, cost basis and average price after each, by (filled, seq), and the basis before it (basis_before).

    A sale of s out of q takes the basis off at the average price, which leaves (1 - s / q) of it, and a position of 0
    has none; with the running quantities known, that is an affine scan over days.
    """
    sign, qty = F.when(F.col("side") == "buy", 1).otherwise(-1), F.col("qty").cast("double")
    order, day = ["filled", "seq"], F.to_date("filled")
    held = running_sum(fills, "position", sign * qty, order, day, ["symbol"])
    after, before = F.col("position"), F.col("position") - sign * qty
    kept = F.when(F.col("side") == "buy", 1.0).when(after == 0, 0.0).when(before != 0, after / before).otherwise(1.0)
    paid = F.when(F.col("side") == "buy", qty * F.col("price")).otherwise(0.0)
    out = affine_scan(held, {"basis": (kept, paid)}, ["symbol"], order, day, before={"basis": "basis_before"})
    return out.withColumn("avg_price", F.when(after != 0, F.col("basis") / after).otherwise(0.0))


def average_cost(fills: DataFrame) -> DataFrame:
    """Per symbol that is held: quantity, cost basis and average price after all fills."""
    last = F.max_by(F.struct("position", "basis", "avg_price"), F.struct("filled", "seq"))
    done = cost_basis(fills).groupBy("symbol").agg(last.alias("s"))
    return done.select("symbol", F.col("s.position").alias("qty"), F.col("s.basis").alias("basis"), F.col("s.avg_price").alias("avg_price")).where("qty <> 0")


def equity_curve(fills: DataFrame, bars: DataFrame, cash: float) -> DataFrame:
    """(timestamp, equity) at each bar time: cash, plus each position at its symbol's close, or at its average cost where the symbol has no bar at that time.

    All positions at cost are one running sum over times; a bar adds what its close makes of the position beyond that.
    The changes by symbol and time are checkpointed, as what follows reads them several times.
    """
    sign, day = F.when(F.col("side") == "buy", 1).otherwise(-1), F.to_date("timestamp")
    changes = {"dq": sign * F.col("qty"), "db": F.col("basis") - F.col("basis_before"), "dc": -sign * F.col("price") * F.col("qty") - F.col("fee")}
    moves = checkpointed(cost_basis(fills).groupBy("symbol", F.col("filled").alias("timestamp")).agg(*[F.sum(v).alias(n) for n, v in changes.items()]))
    both = bars.select("symbol", "timestamp", "close", F.lit(True).alias("bar")).join(moves, ["symbol", "timestamp"], "full_outer")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    held = running_sums(both, {"q": none("dq"), "b": none("db")}, ["timestamp"], day, ["symbol"])
    beyond = F.when(F.col("close").isNotNull(), F.col("q") * F.col("close") - F.col("b")).otherwise(0.0)
    per_time = held.groupBy("timestamp").agg(F.sum(none("dc") + none("db")).alias("d"), F.sum(beyond).alias("beyond"), F.max("bar").alias("bar"))
    curve = running_sum(per_time, "book", F.col("d"), ["timestamp"], day).where("bar")
    return curve.select("timestamp", (F.lit(cash) + F.col("book") + F.col("beyond")).alias("equity"))


@dataclass
class Position:
    quantity: int = 0
    cost_basis: float = 0.0

    @property
    def avg_price(self) -> float:
        return self.cost_basis / self.quantity if self.quantity else 0.0


@dataclass
class Portfolio:
    cash: float
    positions: dict[str, Position] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.cash < 0:
            raise ValueError("cash must not be below 0")

    def position(self, symbol: str) -> Position:
        return self.positions.get(symbol, Position())

    def apply(self, symbol: str, side: str, qty: int, price: float, fee: float) -> None:
        p = self.positions.setdefault(symbol, Position())
        if side == "buy":
            p.quantity, p.cost_basis, self.cash = p.quantity + qty, p.cost_basis + qty * price, self.cash - qty * price - fee
        else:
            if qty > p.quantity:
                raise ValueError(f"Cannot sell {qty} of {p.quantity} {symbol}")
            p.cost_basis -= p.avg_price * qty
            p.quantity, self.cash = p.quantity - qty, self.cash + qty * price - fee
        if not p.quantity:
            del self.positions[symbol]

    def equity(self, closes: dict[str, float] | None = None) -> float:
        """Marked at ``closes``; a symbol without one, and all without ``closes``, at cost."""
        return self.cash + sum(p.quantity * (closes or {}).get(s, p.avg_price) for s, p in self.positions.items())


class Strategy(Protocol):
    def next(self, time: Any, snapshot: pd.DataFrame, portfolio: Portfolio) -> list[tuple[str, str, int]]:
        """Market orders (symbol, side, qty) to fill at this bar's closes."""


def run_backtest(bars: DataFrame, strategy: Callable[[], Strategy], cash: float, run_col: str, slippage_bps: float = 0.0, fee: Callable[[str, int, float], float] | None = None) -> DataFrame:
    """(run, timestamp, equity, cash, n_fills): one strategy object per run, all runs in parallel.

    A run (a parameter set, a portfolio, a group of symbols) is a sequential computation over its own bars.
    """
    run_type = dict(bars.dtypes)[run_col]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        book, plan, out, n, waiting = Portfolio(cash), strategy(), [], 0, []
        for time, snap in pdf.sort_values(["timestamp", "symbol"]).groupby("timestamp", sort=True):
            closes = dict(zip(snap["symbol"], snap["close"], strict=True))
            waiting += plan.next(time, snap, book)
            later = []
            for symbol, side, qty in waiting:
                if symbol not in closes:
                    later.append((symbol, side, qty))
                    continue
                price = closes[symbol] * (1 + (1 if side == "buy" else -1) * max(slippage_bps, 0) / 10000)
                book.apply(symbol, side, qty, price, fee(side, qty, price) if fee else 0.0)
                n += 1
            waiting = later
            out.append((pdf[run_col].iloc[0], time, book.equity(closes), book.cash, n))
        return pd.DataFrame(out, columns=[run_col, "timestamp", "equity", "cash", "n_fills"])

    return bars.groupBy(run_col).applyInPandas(one, f"{run_col} {run_type}, timestamp {dict(bars.dtypes)['timestamp']}, equity double, cash double, n_fills long")
