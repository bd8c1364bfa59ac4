"""Second-order boosted trees on histograms, for binary labels.

Each round fits one tree to the gradients g and Hessians h of the logistic loss. A level of a tree is one pass: tasks
add up g and h by (node, feature, bin), Spark adds the tasks' sums, a window over the bins gives both sides of every
split, and only the best split of each node comes to the driver. The gain of a split is
GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2); it must exceed a millionth and reach ``gamma``, and both sides
must hold a Hessian of ``min_child``. Leaves are worth -rate * G / (H + l2). Missing values (null or NaN) go to the
side that gains more, right on a tie.

g and h are added up as integers (fixed point), so sums do not depend on the order of rows or on how they are
partitioned, and a fit that loses executors ends with the same trees. Of equal gains the lower feature, then the
lower cut wins. Rows travel as bin numbers with their margin; every ``cut`` trees the table is written anew, in between
a task scores the few trees since then, so no round scores more than ``cut`` trees. A task holds at most ``CELLS``
sums; levels with more (node, feature, bin) cells take several passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.session import stages

#: Sums of a kind that a task holds at a time.
CELLS = 1 << 21
#: The least gain of a split.
LEAST = 1e-6
_BLOCK = 8192


@dataclass
class Tree:
    """Nodes in heap order: the root is 1, the children of n are 2n (below the threshold) and 2n + 1; splits: node -> (feature, cut, threshold, missing_left)."""

    splits: dict[int, tuple[int, int, float, bool]] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def _walk(self, goes_left, n: int) -> np.ndarray:
        at = np.ones(n, dtype=np.int64)
        for node in sorted(self.splits):  # parents come before their children
            here = np.flatnonzero(at == node)
            if len(here):
                at[here] = 2 * node + ~goes_left(here, *self.splits[node])
        return at

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row of bin numbers (-1 is missing)."""
        return self._walk(lambda rows, f, cut, _, missing: np.where(bins[rows, f] < 0, missing, bins[rows, f] <= cut), len(bins))

    def values(self, x: np.ndarray) -> np.ndarray:
        """The leaf value of each row of features (NaN is missing)."""
        at = self._walk(lambda rows, f, _, threshold, missing: np.where(np.isnan(x[rows, f]), missing, x[rows, f] < threshold), len(x))
        return self._worth(at)

    def values_of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self._worth(self.nodes(bins))

    def _worth(self, at: np.ndarray) -> np.ndarray:
        known, back = np.unique(at, return_inverse=True)
        return np.array([self.leaves[int(k)] for k in known], dtype=np.float64)[back] if len(at) else np.zeros(0)


def feature_array(data: DataFrame) -> Column:
    kind = dict(data.dtypes)["features"]
    return F.col("features").cast("array<double>") if kind.startswith("array") else vector_to_array("features")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), dtype=kind)


class BoostedTrees:
    """Parameters as usual for extreme gradient boosting; ``subsample`` and ``columns`` are shares of rows and features per tree, drawn by hash.

    ``fit`` takes features (vector or array), label (0 or 1) and weight; rows without a label are left out.
    ``transform`` adds score (the margin), probability_1 and prediction. ``base`` is the probability from which the
    margins start. ``positive`` takes the place of the weights: what a row of class 1 weighs.
    """

    def __init__(self, rounds: int = 100, depth: int = 6, rate: float = 0.3, l2: float = 1.0, gamma: float = 0.0, min_child: float = 1.0, bins: int = 256, base: float = 0.5, subsample: float = 1.0, columns: float = 1.0, positive: float | None = None, seed: int = 42, cut: int = 8) -> None:
        if not 0 < base < 1 or rounds < 0 or depth < 0 or bins < 2 or not 0 < subsample <= 1 or not 0 < columns <= 1:
            raise ValueError("base must lie between 0 and 1, shares in (0, 1], bins be 2 at least")
        self.rounds, self.depth, self.rate, self.l2, self.gamma, self.min_child = rounds, depth, rate, l2, gamma, min_child
        self.bins, self.base, self.subsample, self.columns, self.positive, self.seed, self.cut = bins, base, subsample, columns, positive, seed, cut
        self.trees: list[Tree] = []
        self.cuts: list[np.ndarray] = []

    # --- fitting ---------------------------------------------------------------------------------------------------

    def fit(self, data: DataFrame) -> BoostedTrees:
        weight = F.col("weight").cast("double") if "weight" in data.columns else F.lit(1.0)
        if self.positive is not None:
            weight = F.when(F.col("label") == 1, float(self.positive)).otherwise(1.0)
        rows = data.where("label IS NOT NULL").select(feature_array(data).alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"))
        self.trees, start = [], math.log(self.base / (1 - self.base))
        with stages(data.sparkSession) as keep:
            rows = keep(rows)
            shape = rows.agg(F.max(F.size("x")), F.max("w")).first()
            if not shape[0]:
                return self
            self.cuts = self._cuts(rows, shape[0])
            # g and h of a block must add up exactly in a double: 2 ** 38 for the heaviest row.
            scale = 2.0 ** (38 - math.ceil(math.log2(max(shape[1] or 1.0, 1e-300))))
            table, since = keep(self._binned(rows, start)), 0
            for k in range(self.rounds):
                if k - since == self.cut:
                    table, since = keep(self._advanced(table, self.trees[since:k])), k
                self.trees.append(self._tree(table, self.trees[since:k], scale, k))
        return self

    def _cuts(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """The features' quantiles by sketches of a fixed accuracy, without repeats; exact on small tables."""
        shares = F.array(*[F.lit(i / self.bins) for i in range(1, self.bins)])
        value = lambda j: F.nanvl(F.get("x", F.lit(j)), F.lit(None).cast("double"))
        found = rows.agg(*[F.percentile_approx(value(j), shares, max(100 * self.bins, 10_000)) for j in range(width)]).first()
        return [np.unique(np.array(c if c is not None else [], dtype=np.float64)) for c in found]

    def _binned(self, rows: DataFrame, start: float) -> DataFrame:
        cuts = self.cuts

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"), np.float64)
                bins = np.empty(x.shape, dtype=np.int16)
                for j, c in enumerate(cuts):
                    bins[:, j] = np.where(np.isnan(x[:, j]), -1, np.searchsorted(c, x[:, j], side="right"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(cuts), pa.int32()), pa.array(bins.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *[batch.column(c) for c in ("y", "w", "key")], pa.array(np.full(len(x), start))], ["b", "y", "w", "key", "margin"])

        keyed = rows.where(F.size("x") == len(cuts)).withColumn("key", F.xxhash64("x", "y"))
        return keyed.mapInArrow(run, "b array<smallint>, y double, w double, key long, margin double")

    def _advanced(self, table: DataFrame, trees: Sequence[Tree]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _matrix(batch.column("b"), np.int16)
                margin = batch.column("margin").to_numpy() + sum(t.values_of_bins(bins) for t in trees)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("b", "y", "w", "key")], pa.array(margin)], ["b", "y", "w", "key", "margin"])

        return table.mapInArrow(run, table.schema)

    def _drawn(self, k: int) -> list[int]:
        """The features of tree ``k``."""
        n = max(1, round(self.columns * len(self.cuts)))
        return sorted(np.random.default_rng([self.seed, k]).permutation(len(self.cuts))[:n].tolist())

    def _tree(self, table: DataFrame, since: Sequence[Tree], scale: float, k: int) -> Tree:
        tree, features = Tree(), self._drawn(k)
        slots = len(features) * (max(len(self.cuts[f]) for f in features) + 2)
        at_once, open_nodes, sums = max(1, CELLS // slots), [1], {}
        worth = lambda g, h: -self.rate * g / (h + self.l2) if h + self.l2 > 0 else 0.0
        for level in range(max(self.depth, 1)):
            following = []
            for a in range(0, len(open_nodes), at_once):
                some = open_nodes[a : a + at_once]
                for r in self._best(self._sums(table, since, tree, some, features, scale, k), scale).collect():
                    node = int(r["node"])
                    sums.setdefault(node, (r["g"] / scale, r["h"] / scale))
                    if self.depth == 0 or r["split"] is None:
                        continue
                    f, cut = r["split"]["feature"], r["split"]["bin"]
                    threshold = float(self.cuts[f][cut]) if cut < len(self.cuts[f]) else math.inf
                    tree.splits[node], tree.gains[node] = (f, cut, threshold, bool(r["split"]["missing_left"])), r["split"]["gain"]
                    left = float(r["split"]["g"]) / scale, float(r["split"]["h"]) / scale
                    whole = sums[node]
                    sums[2 * node], sums[2 * node + 1] = left, (whole[0] - left[0], whole[1] - left[1])
                    following += [2 * node, 2 * node + 1]
            open_nodes = following
            if not open_nodes:
                break
        tree.leaves = {n: worth(*s) for n, s in sums.items() if n not in tree.splits} or {1: 0.0}
        return tree

    def _sums(self, table: DataFrame, since: Sequence[Tree], tree: Tree, nodes: list[int], features: list[int], scale: float, k: int) -> DataFrame:
        """(node, feature, bin, g, h): sums of the rows in ``nodes``; g and h are whole numbers."""
        lanes, trees, place = max(len(self.cuts[f]) for f in features) + 2, list(since), {n: i for i, n in enumerate(nodes)}
        subsample, salt = self.subsample, np.uint64(0x9E3779B97F4A7C15 * (self.seed * 1_000_003 + k + 1) % (1 << 64))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = len(nodes) * len(features) * lanes
            g_sum, h_sum, seen = np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=bool)
            held, top = 0.0, 0.0

            def out() -> Iterator[pa.RecordBatch]:
                at = np.flatnonzero(seen)
                if len(at):
                    node, feature = np.array(nodes, dtype=np.int64)[at // (len(features) * lanes)], np.array(features)[at // lanes % len(features)]
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(feature, pa.int32()), pa.array(at % lanes - 1, pa.int32()), pa.array(g_sum[at]), pa.array(h_sum[at])], ["node", "feature", "bin", "g", "h"])

            for batch in batches:
                for a in range(0, batch.num_rows, _BLOCK):
                    part = batch.slice(a, _BLOCK)
                    bins = _matrix(part.column("b"), np.int16)
                    at = tree.nodes(bins)
                    slot = np.array([place.get(int(n), -1) for n in np.unique(at)], dtype=np.int64)[np.unique(at, return_inverse=True)[1]]
                    take = slot >= 0
                    if subsample < 1:
                        mixed = (part.column("key").to_numpy().view(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                        take &= (mixed >> np.uint64(11)).astype(np.float64) < subsample * 2.0**53
                    if not take.any():
                        continue
                    bins, slot = bins[take], slot[take]
                    y, w = part.column("y").to_numpy()[take], part.column("w").to_numpy()[take]
                    margin = part.column("margin").to_numpy()[take] + sum(t.values_of_bins(bins) for t in trees)
                    p = 1 / (1 + np.exp(-margin))
                    g, h = np.rint(scale * w * (p - y)), np.rint(scale * w * np.maximum(p * (1 - p), 1e-16))
                    top = max(np.abs(g).max(), h.max())
                    held += top * len(g)
                    if held >= 2.0**62:
                        yield from out()
                        g_sum[:], h_sum[:], seen[:], held = 0, 0, False, top * len(g)
                    for i, f in enumerate(features):
                        cell = (slot * len(features) + i) * lanes + bins[:, f] + 1
                        low, n = int(cell.min()), int(cell.max()) + 1
                        g_sum[low:n] += np.bincount(cell - low, g, n - low).astype(np.int64)
                        h_sum[low:n] += np.bincount(cell - low, h, n - low).astype(np.int64)
                        seen[cell] = True
            yield from out()

        parts = table.mapInArrow(run, "node long, feature int, bin int, g long, h long")
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        # What a task sends is added up already; one exchange serves these sums and the windows over the bins.
        return parts.repartition("node", "feature").groupBy("node", "feature", "bin").agg(exact("g"), exact("h"))

    def _best(self, sums: DataFrame, scale: float) -> DataFrame:
        """(node, g, h, split): each node's sums and its best split, null where none is good enough."""
        whole = Window.partitionBy("node", "feature")
        below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        there, none = F.col("bin") >= 0, F.lit(0).cast("decimal(38,0)")
        cumulated = sums.withColumns({
            "all_g": F.sum("g").over(whole), "all_h": F.sum("h").over(whole),
            "none_g": F.sum(F.when(there, none).otherwise(F.col("g"))).over(whole), "none_h": F.sum(F.when(there, none).otherwise(F.col("h"))).over(whole),
            "below_g": F.sum(F.when(there, F.col("g")).otherwise(none)).over(below), "below_h": F.sum(F.when(there, F.col("h")).otherwise(none)).over(below),
        })
        real = lambda c: c.cast("double") / F.lit(scale)
        worth = lambda g, h: F.when(h + self.l2 > 0, g * g / (h + self.l2)).otherwise(0.0)
        all_g, all_h = F.col("all_g"), F.col("all_h")

        def side(missing_left: bool) -> Column:
            """The split that sends missing values left or right, null where it is not good enough."""
            g, h = (F.col(f"below_{c}") + (F.col(f"none_{c}") if missing_left else none) for c in "gh")
            gain = worth(real(g), real(h)) + worth(real(all_g - g), real(all_h - h)) - worth(real(all_g), real(all_h))
            ok = there & (real(h) >= self.min_child) & (real(all_h - h) >= self.min_child) & (h > 0) & (all_h > h) & (gain > LEAST) & (gain >= self.gamma)
            order = [gain.alias("gain"), (-F.col("feature")).alias("o_feature"), (-F.col("bin")).alias("o_bin"), F.lit(not missing_left).alias("o_side")]
            return F.when(ok, F.struct(*order, "feature", "bin", F.lit(missing_left).alias("missing_left"), g.alias("g"), h.alias("h")))

        best = cumulated.withColumn("split", F.greatest(side(False), side(True)))
        return best.groupBy("node").agg(F.max_by("all_g", "feature").cast("double").alias("g"), F.max_by("all_h", "feature").cast("double").alias("h"), F.max("split").alias("split"))

    # --- using -----------------------------------------------------------------------------------------------------

    def transform(self, data: DataFrame) -> DataFrame:
        trees, start, width = list(self.trees), math.log(self.base / (1 - self.base)), len(self.cuts)

        @F.pandas_udf("double")
        def margin(x):
            import pandas as pd

            rows = np.array([v if v is not None and len(v) == width else [np.nan] * width for v in x], dtype=np.float64).reshape(len(x), width)
            return pd.Series(start + sum((t.values(rows) for t in trees), np.zeros(len(rows))))

        scored = data.withColumn("score", margin(feature_array(data)))
        return scored.withColumns({"probability_1": 1 / (1 + F.exp(-F.col("score"))), "prediction": (F.col("score") > 0).cast("double")})

    def table(self) -> list[tuple[int, int, int | None, float | None, bool | None, float | None, float | None]]:
        """(tree, node, feature, threshold, missing_left, gain, leaf) of all nodes."""
        out = []
        for k, t in enumerate(self.trees):
            out += [(k, n, f, threshold, missing, t.gains[n], None) for n, (f, _, threshold, missing) in sorted(t.splits.items())]
            out += [(k, n, None, None, None, None, v) for n, v in sorted(t.leaves.items())]
        return out

    def importance(self) -> dict[int, float]:
        """Total gain of each feature that splits use."""
        found: dict[int, float] = {}
        for t in self.trees:
            for n, (f, *_) in t.splits.items():
                found[f] = found.get(f, 0.0) + t.gains[n]
        return found
