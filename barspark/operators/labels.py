"""Forward-looking labels and simulated trades, per session.

The signal is at bar i, the entry is taken from bar i + 1, and exits are looked for from bar i + 2 to the horizon or
the session's end; only i < n - 3 gives trades. A bar's first hit of a level is found in a table of range extremes of
its session (maxima and minima over 1, 2, 4, ... bars) by a binary search, so a session of n bars takes n log n numbers
and n log n steps a level, with or without a horizon. Bars must be free of nulls (see ``validate``); a null or NaN
price never hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from barspark.functions.scalars import at_least, finite
from barspark.operators.windows import SESSION, session, whole_session, with_trade_date

#: Whole sessions are searched together until they have so many bars.
_TOGETHER = 20_000


def range_maxima(values: np.ndarray, most: int) -> list[np.ndarray]:
    """Level k holds the maximum of values[i : i + 2 ** k] at i, up to 2 ** k <= most; NaN is left out."""
    out = [values]
    while 2 << len(out) - 1 <= most:
        last, half = out[-1], 1 << len(out) - 1
        out.append(np.fmax(last[:-half], last[half:]))
    return out


def first_reach(maxima: list[np.ndarray], start: np.ndarray, end: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first index in [start, end) whose value is at least ``level``, else ``end`` (or ``start``, if that is beyond it)."""
    at = start.copy()
    for k in reversed(range(len(maxima))):
        fits = np.flatnonzero(at + (1 << k) <= end)
        skip = fits[~(maxima[k][at[fits]] >= level[fits])]
        at[skip] += 1 << k
    # A last step of each size is enough, as what is left of the range is shorter than the step before.
    return at


def _sessions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole sessions from batches that are sorted by session and time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("_session").to_numpy()
        if held and rows >= _TOGETHER:
            # A session of the rows that are held may go on in this batch.
            last = held[-1].column("_session")[-1].as_py()
            new = np.flatnonzero(key != last)
            if len(new):
                cut = int(new[0])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _ahead(bars: DataFrame, ups: Sequence[float], downs: Sequence[float], horizon: int | None, entry: str = "high") -> DataFrame:
    """``bars`` with _i, _n, _entry, the places (from 1 at bar i + 2) of the first hits of each level (_ups, _downs, null without), and of the bars looked at their number (_looked) and the last one's low (_last)."""
    if horizon is not None:
        at_least("horizon", horizon, 1)
    dated = with_trade_date(bars)
    added = [StructField("_i", LongType()), StructField("_n", LongType()), StructField("_entry", DoubleType()), *[StructField(c, ArrayType(LongType())) for c in ("_ups", "_downs")], StructField("_looked", LongType()), StructField("_last", DoubleType())]

    def places(found: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.Array:
        grid = np.stack(found, axis=1) if found else np.zeros((len(start), 0), dtype=np.int64)
        none = (grid >= end[:, None]).ravel()
        values = pa.array((grid - start[:, None] + 1).ravel(), pa.int64(), mask=none)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * grid.shape[1], pa.int32()), values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _sessions(batches):
            key = table["_session"].to_numpy()
            n = len(key)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, n))
            begin, count = np.repeat(first, size), np.repeat(size, size)
            row = np.arange(n)
            high, low, price = (table[c].to_numpy().astype(np.float64) for c in ("high", "low", entry))
            price = np.where(row + 1 < begin + count, np.append(price[1:], np.nan), np.nan)
            start, last = row + 2, begin + count
            end = np.maximum(last if horizon is None else np.minimum(last, start + horizon), start)
            reach = int((end - start).max(initial=1)) or 1
            highs, lows = range_maxima(high, min(reach, n)), range_maxima(-low, min(reach, n))
            up = [first_reach(highs, start, end, price * (1 + t)) for t in ups]
            down = [first_reach(lows, start, end, -(price * (1 - t))) for t in downs]
            there = end > start
            last_low = pa.array(np.where(there, low[np.minimum(end, n) - 1], np.nan), mask=~there)
            new = [pa.array(row - begin), pa.array(count), pa.array(price, mask=np.isnan(price)), places(up, start, end), places(down, start, end), pa.array(end - start), last_low]
            out = table.drop_columns(["_session"])
            for f, column in zip(added, new, strict=True):
                out = out.append_column(f.name, column)
            yield from out.combine_chunks().to_batches(max_chunksize=_TOGETHER)

    dealt = dated.withColumn("_session", F.xxhash64(*SESSION)).repartition(*SESSION).sortWithinPartitions(*SESSION, "timestamp")
    return dealt.mapInArrow(run, StructType([*dated.schema.fields, *added]))


def _first(values: str, hit: Callable[[Column], Column]) -> Column:
    """The 1-based place of the first hit, null if there is none."""
    return F.nullif(F.array_position(F.transform(values, hit), True), F.lit(0))


_TEMP = ["_i", "_n", "_entry", "_ups", "_downs", "_looked", "_last"]


def _valid() -> Column:
    return (F.col("_i") < F.col("_n") - 3) & finite(F.col("_entry")) & (F.col("_entry") > 0)


def tp_before_sl(bars: DataFrame, tp: float, sl: float, horizon: int | None = None, name: str = "target") -> DataFrame:
    """1 if the take-profit level is reached strictly before the stop; both in one bar is 0."""
    up, down = F.get("_ups", F.lit(0)), F.get("_downs", F.lit(0))
    return _ahead(bars, [tp], [sl], horizon).withColumn(name, F.when(_valid() & up.isNotNull() & (down.isNull() | (up < down)), 1).otherwise(0)).drop(*_TEMP)


def touched(bars: DataFrame, tp: float, sl: float, horizon: int | None = None, name: str = "range_target") -> DataFrame:
    """1 if either level is touched; a maximum and a minimum over the frame, no arrays."""
    if horizon is not None:
        at_least("horizon", horizon, 1)
    w = session().rowsBetween(2, Window.unboundedFollowing if horizon is None else horizon + 1)
    df = with_trade_date(bars).withColumns({"_i": F.row_number().over(session()) - 1, "_n": F.count("*").over(whole_session()), "_entry": F.lead("high").over(session()), "_max": F.max("high").over(w), "_min": F.min("low").over(w)})
    hit = (F.col("_max") >= F.col("_entry") * (1 + F.lit(tp))) | (F.col("_min") <= F.col("_entry") * (1 - F.lit(sl)))
    return df.withColumn(name, F.when(_valid() & hit, 1).otherwise(0)).drop("_i", "_n", "_entry", "_max", "_min")


def absolute_move(bars: DataFrame, threshold: float, horizon: int, name: str = "move_target") -> DataFrame:
    """1 if the close moves by ``threshold`` either way within the next ``horizon`` bars of the session."""
    at_least("threshold", threshold, 0)
    at_least("horizon", horizon, 1)
    w = session().rowsBetween(1, horizon)
    move = F.greatest(F.max("high").over(w) / F.col("close") - 1, 1 - F.min("low").over(w) / F.col("close"))
    return with_trade_date(bars).withColumn(name, F.when((F.col("close") > 0) & (move >= threshold), 1).otherwise(0))


def direction(bars: DataFrame, threshold: float, horizon: int) -> DataFrame:
    """Adds move_eligible (as :func:`absolute_move`) and move_direction: 1 up first, 0 down first, null if neither.

    If both are crossed in one bar, the larger excursion decides, up on a tie.
    """
    at_least("threshold", threshold, 0)
    at_least("horizon", horizon, 1)
    w = session().rowsBetween(1, horizon)
    df = with_trade_date(bars).withColumns({"_highs": F.collect_list("high").over(w), "_lows": F.collect_list("low").over(w)})
    c = F.col("close")
    df = df.withColumns({"_tp": _first("_highs", lambda x: x / c - 1 >= threshold), "_sl": _first("_lows", lambda x: 1 - x / c >= threshold)})
    up, down = F.col("_tp"), F.col("_sl")
    eligible = (c > 0) & (up.isNotNull() | down.isNotNull())
    k = F.coalesce(up, F.lit(1)).cast("int")
    tie = F.try_element_at("_highs", k) / c - 1 >= 1 - F.try_element_at("_lows", k) / c
    way = F.when(down.isNull() | (up < down), 1).when(up.isNull() | (down < up), 0).when(tie, 1).otherwise(0)
    return df.withColumn("move_eligible", F.when(eligible, 1).otherwise(0)).withColumn("move_direction", F.when(eligible, way).cast("int")).drop("_highs", "_lows", "_tp", "_sl")


EXIT_KINDS = {-1: "none", 0: "tp", 1: "sl", 2: "horizon"}


def gross_return(bars: DataFrame, tp: float, sl: float, horizon: int | None = None, entry: str = "high") -> DataFrame:
    """Adds gross_return and exit_kind (0 take-profit, 1 stop, 2 horizon, -1 no trade).

    The entry is the next bar's ``entry`` price; a bar that reaches both levels stops; without either, the exit is the
    low of the last bar looked at.
    """
    hit = _ahead(bars, [tp], [sl], horizon, entry)
    e, up, down = F.col("_entry"), F.get("_ups", F.lit(0)), F.get("_downs", F.lit(0))
    kind = F.when(~_valid() | (F.col("_looked") == 0), -1).when(down.isNotNull() & (up.isNull() | (down <= up)), 1).when(up.isNotNull(), 0).otherwise(2).cast("int")
    df = hit.withColumn("exit_kind", kind)
    price = F.when(F.col("exit_kind") == 1, e * (1 - F.lit(sl))).when(F.col("exit_kind") == 0, e * (1 + F.lit(tp))).when(F.col("exit_kind") == 2, F.col("_last"))
    return df.withColumn("gross_return", price / e - 1).drop(*_TEMP)


def grid_trades(bars: DataFrame, take_profits: Sequence[float], stop_losses: Sequence[float], horizon: int | None = None) -> DataFrame:
    """One row per opportunity (i < n - 3) and grid point: tp, sl, kind (tp, sl, eod), pnl and duration.

    Each level's first hit is found once per bar; the grid's points are exploded from these.
    """
    ahead = _ahead(bars, [float(t) for t in take_profits], [float(x) for x in stop_losses], horizon).where(F.col("_i") < F.col("_n") - 3)
    point = lambda i, t, j, x: F.struct(F.lit(float(t)).alias("tp"), F.lit(float(x)).alias("sl"), F.get("_ups", F.lit(i)).alias("up"), F.get("_downs", F.lit(j)).alias("down"))
    points = F.array(*[point(i, t, j, x) for i, t in enumerate(take_profits) for j, x in enumerate(stop_losses)])
    hit = ahead.withColumn("_g", F.explode(points)).withColumns({"tp": F.col("_g.tp"), "sl": F.col("_g.sl")})
    ok, up, down = finite(F.col("_entry")) & (F.col("_entry") > 0), F.col("_g.up"), F.col("_g.down")
    kind = F.when(ok & down.isNotNull() & (up.isNull() | (down <= up)), "sl").when(ok & up.isNotNull(), "tp").otherwise("eod")
    out = hit.withColumn("kind", kind).withColumn("duration", F.when(F.col("kind") == "sl", down).when(F.col("kind") == "tp", up).otherwise(0).cast("bigint"))
    return out.withColumn("pnl", F.when(F.col("kind") == "sl", -F.col("sl")).when(F.col("kind") == "tp", F.col("tp")).otherwise(F.lit(0.0))).drop(*_TEMP, "_g")


def reachable_rows(features: DataFrame, tp: float, sl: float, horizon: int | None = None) -> DataFrame:
    """The rows of a feature table (made before, on the whole history) from which either level is touched."""
    return touched(features, tp, sl, horizon, "_reach").where("_reach = 1").drop("_reach")


def eligible_rows(labelled: DataFrame) -> DataFrame:
    """The rows of :func:`direction` that moved at all, with the way they went as a long."""
    return labelled.where("move_eligible = 1").drop("move_eligible").withColumn("move_direction", F.col("move_direction").cast("long"))
