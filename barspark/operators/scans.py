"""Recurrences and carried values over long histories, by blocks.

A history (the rows of one symbol, say) is cut into blocks, such as days. What a block does to the state before it is
summed up in one row; these rows, a small table, are scanned per history; each block then starts from its own state.
So a history spreads over as many tasks as it has blocks, and no task or window holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

_A, _B, _X, _BLOCK, _FIRST, _KEY = "_scan_a", "_scan_b", "_scan_x", "_scan_block", "_scan_first", "_scan_key"


def composed(a: np.ndarray, b: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of the maps x -> a x + b along axis 0, each starting anew where ``fresh``: row i maps the state before its run to the state after i.

    Doubling: after round k a row holds the composition of the last 2 ** k maps of its run.
    """
    a, b, done, step = a.copy(), b.copy(), fresh.copy(), 1
    while step < len(a) and not done.all():
        more = ~done[step:, None]
        b_new = np.where(more, a[step:] * b[:-step] + b[step:], b[step:])
        a_new = np.where(more, a[step:] * a[:-step], a[step:])
        reach = done[step:] | done[:-step]
        a[step:], b[step:], done[step:] = a_new, b_new, reach
        step *= 2
    return a, b


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def affine_scan(frame: DataFrame, maps: dict[str, tuple[Column, Column]], own: Sequence[str], order: Sequence[str], block: Column, before: dict[str, str] | None = None) -> DataFrame:
    """``frame`` with a column for each of ``maps``, name -> (a, b): x = a * (x of the row before) + b, from 0 in front of each history.

    ``own`` are the columns of a history, ``order`` sorts it and ``block`` grows with the order. A null or NaN in a or b
    makes the rest of its history NaN. ``before`` names columns for the value in the row before: a key of ``maps`` -> the
    column. The frame is read twice.
    """
    names, width = list(maps), len(maps)
    earlier = list((before or {}).items())
    own = list(own)
    each = [F.array(*[F.coalesce(m[i].cast("double"), F.lit(float("nan"))) for m in maps.values()]) for i in (0, 1)]
    rows = frame.withColumns({_A: each[0], _B: each[1], _BLOCK: block})

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, held = None, None, None  # the block that is open: its key, its maps so far, a batch that names it

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held.columns[: len(own) + 1], _lists(at[0]), _lists(at[1])], [*own, _BLOCK, _A, _B])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(_KEY).to_numpy()
            fresh = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            a, b = composed(_rows(batch.column(_A), width), _rows(batch.column(_B), width), fresh)
            runs = np.flatnonzero(fresh)
            if held is not None and not fresh[0]:
                stop = runs[0] if len(runs) else len(key)
                b[:stop], a[:stop] = a[:stop] * at[1] + b[:stop], a[:stop] * at[0]
            elif held is not None:
                yield done()
            ends = np.append(runs[runs > 0] - 1, len(key) - 1)
            closed = ends[:-1]
            if len(closed):
                names_of = batch.take(pa.array(closed))
                yield pa.RecordBatch.from_arrays([*names_of.columns[: len(own) + 1], _lists(a[closed]), _lists(b[closed])], [*own, _BLOCK, _A, _B])
            last, at, held = key[-1], (a[-1:].copy(), b[-1:].copy()), batch.slice(len(key) - 1, 1)
        if held is not None:
            yield done()

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    keyed = [StructField(c, kinds[c]) for c in (*own, _BLOCK)]
    state = [StructField(c, ArrayType(DoubleType())) for c in (_A, _B)]
    narrow = rows.select(*own, _BLOCK, _A, _B, F.xxhash64(*own, _BLOCK).alias(_KEY), *[F.col(c).alias(f"_scan_o{i}") for i, c in enumerate(order)])
    sorted_rows = narrow.repartition(*own, _BLOCK).sortWithinPartitions(*own, _BLOCK, *[f"_scan_o{i}" for i in range(len(order))])
    sums = sorted_rows.mapInArrow(summed, StructType([*keyed, *state]))

    def starts(table: pa.Table) -> pa.Table:
        """The state in front of each block of one history."""
        table = table.sort_by(_BLOCK)
        a, b = (_rows(table[c].combine_chunks(), width) for c in (_A, _B))
        _, b = composed(a, b, np.append(True, np.zeros(len(a) - 1, dtype=bool)))
        x = np.concatenate([np.zeros((1, width)), b[:-1]])
        return pa.Table.from_arrays([*[table[c] for c in (*own, _BLOCK)], _lists(x)], [*own, _BLOCK, _X])

    begun = sums.groupBy(*own).applyInArrow(starts, StructType([*keyed, StructField(_X, ArrayType(DoubleType()))]))
    # A block's state goes in front of its rows as a row of its own: a map to it from anywhere.
    marks = begun.select(*own, _BLOCK, F.transform(_X, lambda _: F.lit(0.0)).alias(_A), F.col(_X).alias(_B), F.lit(0).alias(_FIRST))
    whole = rows.withColumn(_FIRST, F.lit(1)).unionByName(marks, allowMissingColumns=True)
    dealt = whole.repartition(*own, _BLOCK).sortWithinPartitions(*own, _BLOCK, _FIRST, *order)
    kept = frame.columns

    def applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros((1, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column(_FIRST).to_numpy() == 0
            a, b = composed(_rows(batch.column(_A), width), _rows(batch.column(_B), width), mark)
            stop = int(np.argmax(mark)) if mark.any() else len(mark)
            b[:stop] = a[:stop] * state + b[:stop]  # the run of the batch before goes on
            old = np.concatenate([state, b[:-1]])
            state = b[-1:].copy()
            at = np.flatnonzero(~mark)
            out = batch.select(kept).take(pa.array(at))
            new = [pa.array(np.ascontiguousarray(b[at, i])) for i in range(width)] + [pa.array(np.ascontiguousarray(old[at, names.index(n)])) for n, _ in earlier]
            yield pa.RecordBatch.from_arrays([*out.columns, *new], [*kept, *names, *[c for _, c in earlier]])

    return dealt.mapInArrow(applied, StructType([*frame.schema.fields, *[StructField(n, DoubleType()) for n in [*names, *[c for _, c in earlier]]]]))


def block_places(frame: DataFrame, own: Sequence[str], order: Sequence[str], block: Column, carried: dict[str, Column], place: str) -> DataFrame:
    """``frame`` with ``place``, the number (from 0) of the row in its history, and for each of ``carried`` (name -> value) the value in the row before, null in front.

    Numbers of rows and last values per block, a small table, carry over; the rest is a window per block. The frame is
    read twice.
    """
    own = list(own)
    rows = frame.withColumns({_BLOCK: block, _X: F.struct(*[v.alias(n) for n, v in carried.items()], F.lit(1).alias("_there"))})
    facts = rows.groupBy(*own, _BLOCK).agg(F.count("*").alias("_n"), F.max_by(_X, F.struct(*order)).alias("_last"))
    blocks = Window.partitionBy(*own).orderBy(_BLOCK)
    facts = facts.withColumns({"_start": F.sum("_n").over(blocks) - F.col("_n"), "_carry": F.lag("_last").over(blocks)})
    named = facts.select(*[F.col(c).alias(f"_own_{c}") for c in own], F.col(_BLOCK).alias("_own_block"), "_start", "_carry")
    met = F.col(_BLOCK).eqNullSafe(F.col("_own_block"))
    for c in own:
        met = met & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    inside = Window.partitionBy(*own, _BLOCK).orderBy(*order)
    joined = rows.join(named, met, "left")
    placed = joined.withColumns({place: F.col("_start") + F.row_number().over(inside) - 1, "_before": F.coalesce(F.lag(_X).over(inside), F.col("_carry"))})
    return placed.select(*frame.columns, F.col(place).cast(LongType()).alias(place), *[F.col(f"_before.{n}").alias(n) for n in carried])


def nearest_known(frame: DataFrame, own: Sequence[str], order: Sequence[str], block: Column, past: dict[str, str] | None = None, ahead: dict[str, str] | None = None) -> DataFrame:
    """``frame`` with, for each of ``past`` (new name -> column), the column's last value that is not null up to the row, and for each of ``ahead`` the first one from the row on.

    A block's last and first known values, a small table, carry over to the blocks after and before it; the rest is a
    window per block in each direction. The frame is read twice.
    """
    own, past, ahead = list(own), past or {}, ahead or {}
    rows, at = frame.withColumn(_BLOCK, block), F.struct(*order)
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    facts = rows.groupBy(*own, _BLOCK).agg(
        *[F.max_by(c, known(c)).alias(f"_last_{n}") for n, c in past.items()], *[F.min_by(c, known(c)).alias(f"_next_{n}") for n, c in ahead.items()], F.count("*").alias("_n")
    )
    before = Window.partitionBy(*own).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*own).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carries = {f"_carry_{n}": F.last(f"_last_{n}", True).over(before) for n in past} | {f"_carry_{n}": F.last(f"_next_{n}", True).over(after) for n in ahead}
    named = facts.select(*[F.col(c).alias(f"_own_{c}") for c in own], F.col(_BLOCK).alias("_own_block"), *[v.alias(n) for n, v in carries.items()])
    met = F.col(_BLOCK).eqNullSafe(F.col("_own_block"))
    for c in own:
        met = met & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    # Growing frames in both directions: Spark carries their state, where a frame to the end would start anew.
    up = Window.partitionBy(*own, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*own, _BLOCK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = {n: F.coalesce(F.last(c, True).over(up), F.col(f"_carry_{n}")) for n, c in past.items()} | {n: F.coalesce(F.last(c, True).over(down), F.col(f"_carry_{n}")) for n, c in ahead.items()}
    joined = rows.join(named, met, "left")
    return joined.select(*frame.columns, *[v.alias(n) for n, v in found.items()])
