"""Exact nearest neighbours with pruning by pivots.

A bounded number of train rows, picked by hash, are pivots; every train row belongs to the cell of its nearest pivot,
and of each cell the number of rows and the smallest and largest distance to the pivot are known. A query first looks
into the nearest cells that hold k rows, which gives a bound on its k-th distance, and then only into the cells that
the triangle inequality cannot rule out: those whose ring of distances around the pivot comes within the bound. Both
passes deal a cell's rows and its queries into blocks, one block of each per task group, so a cell with a third of
all rows, or of all queries, is spread. Which rows are pivots changes the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.session import checkpointed, stages

_CHUNK = 512
MOST_PIVOTS = 4096


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Sums of absolute (p = 1) or squared (p = 2) gaps between the rows of ``a`` and ``b``."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        out += np.abs(gap) if p == 1 else gap * gap
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


@dataclass(frozen=True)
class Cells:
    """``pivots`` (cell, feature), and of each cell the number of its rows and their ring of distances around the pivot."""

    pivots: np.ndarray
    counts: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    p: int

    def distance(self, x: np.ndarray) -> np.ndarray:
        found = distances(x, self.pivots, self.p)
        return found if self.p == 1 else np.sqrt(found)

    def home(self, x: np.ndarray, k: int) -> np.ndarray:
        """Which cells each row looks into first: the nearest ones, until they hold k rows."""
        d = self.distance(x)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (self.counts > 0)

    def within(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells may hold a row as near as ``bound``; rounding is allowed for."""
        d = self.distance(x)
        slack = 1e-9 * (d + self.farthest + bound[:, None]) + 1e-300
        return (d - self.farthest <= bound[:, None] + slack) & (self.nearest - d <= bound[:, None] + slack) & (self.counts > 0)


class PivotIndex:
    """``rows``: x (array of double), y (long) and t (string, the order of equally near rows). ``pivots``: by default one for 1,024 rows, ``MOST_PIVOTS`` at most."""

    def __init__(self, rows: DataFrame, width: int, p: int = 2, pivots: int | None = None, block: int = 4096) -> None:
        self.p, self.width, self.block = p, width, block
        self.rows = rows
        if pivots is None:
            pivots = min(MOST_PIVOTS, rows.count() // 1024 + 1)
        picked = rows.select("x").orderBy(F.xxhash64("t", "x"), "x").limit(pivots).collect()
        points = np.unique(np.array([r["x"] for r in picked], dtype=np.float64).reshape(-1, width), axis=0)
        empty = np.zeros(len(points))
        self.cells = Cells(points, empty.astype(np.int64), empty, empty, p)
        if len(points):
            rings = self._placed().groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).collect()
            counts, nearest, farthest = empty.astype(np.int64), empty.copy(), empty.copy()
            for r in rings:
                counts[r["cell"]], nearest[r["cell"]], farthest[r["cell"]] = r["n"], r["a"], r["b"]
            self.cells = Cells(points, counts, nearest, farthest, p)

    def _placed(self) -> DataFrame:
        """The rows with their cell and their distance to its pivot (r)."""
        cells, width = self.cells, self.width

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _CHUNK):
                    part = batch.slice(at, _CHUNK)
                    d = cells.distance(_matrix(part.column("x"), width))
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("x", "y", "t")], pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["x", "y", "t", "cell", "r"])

        return self.rows.select("x", "y", "t").mapInArrow(run, "x array<double>, y long, t string, cell int, r double")

    def visits(self, queries: DataFrame, k: int, bounded: bool) -> DataFrame:
        """(key, q, cell): the cells of the first pass, or (``bounded``, by the column ``bound``) the others that cannot be ruled out."""
        cells, width = self.cells, self.width
        key = dict(queries.dtypes)["key"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _CHUNK):
                    part = batch.slice(at, _CHUNK)
                    x = _matrix(part.column("q"), width)
                    seen = cells.home(x, k)
                    if bounded:
                        bound = part.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                        seen = cells.within(x, np.where(np.isnan(bound), np.inf, bound)) & ~seen
                    row, cell = np.nonzero(seen)
                    some = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("q"), pa.array(cell, pa.int32())], ["key", "q", "cell"])

        return queries.select("key", "q", *(["bound"] if bounded else [])).mapInArrow(run, f"key {key}, q array<double>, cell int")

    def compare(self, visits: DataFrame, k: int) -> DataFrame | None:
        """(key, near): the k nearest rows of the visited cells, as an array of (d, t, y), None without a visit; ``visits`` is read twice."""
        spark, p, width = visits.sparkSession, self.p, self.width
        asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        if not asked:
            return None
        parts = [(c, max(1, -(-int(n) // self.block)), max(1, -(-asked.get(c, 0) // self.block))) for c, n in enumerate(self.cells.counts) if asked.get(c)]
        deal = spark.createDataFrame(pa.table({n: pa.array([x[i] for x in parts], pa.int32()) for i, n in enumerate(("cell", "parts", "askers"))}))
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one_of = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
        # At most a row per pivot: small enough to broadcast.
        left = visits.join(F.broadcast(deal), "cell").withColumns({"asker": one_of("askers", "key")}).withColumn("part", all_of("parts"))
        right = self._placed().drop("r").join(F.broadcast(deal), "cell").withColumns({"part": one_of("parts", "t", "x")}).withColumn("asker", all_of("askers"))
        key = dict(visits.dtypes)["key"]
        schema = f"key {key}, near array<struct<d: double, t: string, y: long>>"

        def nearest(_: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
            names = ["key", "near"]
            kind = pa.list_(pa.struct([("d", pa.float64()), ("t", pa.string()), ("y", pa.int64())]))
            if not queries.num_rows or not rows.num_rows:
                return pa.table({"key": queries["key"].slice(0, 0), "near": pa.array([], kind)})
            rows = rows.select(["x", "y", "t"]).sort_by("t").combine_chunks()
            x, few = _matrix(rows["x"].combine_chunks(), width), min(k, rows.num_rows)
            y, t = rows["y"].combine_chunks(), rows["t"].combine_chunks()
            q, out = _matrix(queries["q"].combine_chunks(), width), []
            for at in range(0, len(q), _CHUNK):
                d = distances(q[at : at + _CHUNK], x, p)
                best = np.argsort(d, axis=1, kind="stable")[:, :few]  # equal distances stay in the order of t
                flat = pa.array(best.ravel())
                near = pa.StructArray.from_arrays([pa.array(np.take_along_axis(d, best, 1).ravel()), t.take(flat), y.take(flat)], ["d", "t", "y"])
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * few, pa.int32()), near))
            return pa.Table.from_arrays([queries["key"], pa.chunked_array(out).cast(kind)], names)

        group = ["cell", "part", "asker"]
        found = left.select("key", "q", *group).groupBy(*group).cogroup(right.select("x", "y", "t", *group).groupBy(*group)).applyInArrow(nearest, schema)
        return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(key, near): the k nearest of each key's lists; equally near ones by t."""
    # Each list is short; partial lists are cut to k before they meet.
    return found.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def k_nearest(train: DataFrame, queries: DataFrame, width: int, k: int, p: int = 2, pivots: int | None = None, block: int = 4096) -> DataFrame:
    """(key, near) for ``queries`` (key, q) among ``train`` (x, y, t): arrays of (d, t, y), nearest first, equally near ones by t.

    Keys are unique. d is the sum of absolute (p = 1) or squared (p = 2) gaps. Vectors that hold a null or a value that is not finite are
    left out on both sides. The result is checkpointed; the tables of the passes are deleted.
    """
    if k < 1 or p not in (1, 2):
        raise ValueError("k must be 1 at least, p 1 or 2")
    whole = lambda c: (F.size(c) == width) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    with stages(train.sparkSession) as keep:
        index = PivotIndex(keep(train.where(whole("x")).select("x", "y", "t")), width, p, pivots, block)
        with stages(train.sparkSession) as keep_pass:
            queries = keep_pass(queries.where(whole("q")).select("key", "q"))
            first = index.compare(index.visits(queries, k, False), k)
            if first is None:
                return train.sparkSession.createDataFrame([], f"key {dict(queries.dtypes)['key']}, near array<struct<d: double, t: string, y: long>>")
            # The k-th distance so far; with fewer than k rows in all there is no bound.
            kth = F.when(F.size("near") >= k, F.element_at("near", F.lit(k))["d"])
            bound = (kth if p == 1 else F.sqrt(kth)).alias("bound")
            passed = keep_pass(queries.join(first.withColumn("bound", bound), "key", "left"))
            near = passed.where("near IS NOT NULL").select("key", "near")
            second = index.compare(index.visits(passed, k, True), k) if np.count_nonzero(index.cells.counts) > 1 else None
            return checkpointed(near if second is None else merged(near.unionByName(second), k))


def vote_share(near: Column, p: int, weighted: bool) -> Column:
    """The share of label 1 among the neighbours, each counting 1 or (``weighted``) one over its distance."""
    weight = (lambda n: F.when(n["d"] > 0, 1 / (F.sqrt(n["d"]) if p == 2 else n["d"])).otherwise(1e12)) if weighted else (lambda n: F.lit(1.0))
    total = F.aggregate(near, F.lit(0.0), lambda a, n: a + weight(n))
    return F.aggregate(near, F.lit(0.0), lambda a, n: a + n["y"] * weight(n)) / total


def neighbour_votes(train: DataFrame, rows: DataFrame, features: Sequence[str], key: list[str], k: int = 5, label: str = "target", p: int = 2, weighted: bool = False, pivots: int = 1024, block: int = 4096) -> DataFrame:
    """(key, votes, pred) for ``rows``: how many of the k nearest train rows have label 1, and whether their share is above a half."""
    names = list(features)
    vector = F.array(*[F.col(f).cast("double") for f in names])
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    known = train.select(vector.alias("x"), F.col(label).cast("long").alias("y"), text.alias("t"))
    near = k_nearest(known, rows.select(F.struct(*key).alias("key"), vector.alias("q")), len(names), k, p, pivots, block)
    votes = F.aggregate("near", F.lit(0).cast("long"), lambda a, n: a + n["y"])
    return near.select(*[F.col(f"key.{c}").alias(c) for c in key], votes.alias("votes"), (vote_share(F.col("near"), p, weighted) > 0.5).cast("int").alias("pred"))
