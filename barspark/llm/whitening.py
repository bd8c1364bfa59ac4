"""Whitening of embeddings with an exact integer scatter matrix.

Entries are integers x (see :func:`integers.integer_vectors`). Each task subtracts a shift, which is a row of the
table (the exact result does not depend on which), and sums the shifted vectors and their cross-products exactly:
blocks whose products fit the 53 bits of a double go through a matrix product, larger entries are split into limbs
first, and the totals are integers of any size. They leave the task cut into limbs of 32 bits, so that Spark adds
them up as longs without loss: at most one row per pair of dimensions and limb from a task. From these the driver
forms n * X'X - S S' exactly (d * (d + 1) / 2 integers for vectors of length d, whatever the number of rows), and only
then converts to double: the covariance V, its eigenvalues and unit eigenvectors.

No cancellation can occur, however far the mean is from zero: that is what the shift and the integers are for.

Defined results: rows with a null vector, an entry that is null or not finite, or one too large for an exact integer
are dropped, and so are vectors of another length than the most frequent one; ids may be null or repeat, each row is
a vector of its own; components without variance (an eigenvalue within rounding of zero) have no whitened value and no
rows, so a table of one vector or of equal vectors gives none; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import materialize, scratch
from barspark.llm.integers import integer_vectors, matrix

_LIMB = 32
_BLOCK = 8192


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x in integers of any size, for a block of long vectors."""
    largest = int(np.abs(x).max(initial=0))
    if largest * largest * max(len(x), 1) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    low = x & ((1 << 20) - 1)
    high = x >> 20
    cross = _limb_product(low, high)
    return _limb_product(low, low) + ((cross + cross.T) << 20) + (exact_products(high) << 40)


def _limb_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b where a is under 2 to the 20; b is split until its products are exact."""
    largest = int(np.abs(b).max(initial=0))
    if largest * (1 << 20) * max(len(a), 1) < 1 << 53:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    return _limb_product(a, b & ((1 << 19) - 1)) + (_limb_product(a, b >> 19) << 19)


@dataclass(frozen=True)
class Scatter:
    """n, the sums and n * X'X - S S' of the integer vectors, all exact."""

    n: int
    sums: list[int]
    matrix: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        """Each entry is the double next to the exact quotient."""
        d, nn = len(self.sums), self.n * self.n
        return np.array([[self.matrix[i, j] / nn for j in range(d)] for i in range(d)], dtype=np.float64).reshape(d, d)


def scatter(rows: DataFrame, d: int) -> Scatter:
    """Of the column ``x`` of ``rows``, vectors of length ``d``."""
    first = rows.select("x").first()
    if first is None:
        return Scatter(0, [0] * d, np.zeros((d, d), dtype=object))
    shift = np.array(first["x"], dtype=np.int64)
    upper = np.triu_indices(d)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            x = matrix(batch.column("x"), d) - shift
            for at in range(0, len(x), _BLOCK):
                block = x[at : at + _BLOCK]
                n += len(block)
                total = total + (block.sum(axis=0) if int(np.abs(block).max()) * _BLOCK < 1 << 62 else block.astype(object).sum(axis=0))
                products = products + exact_products(block)
        if not n:
            return
        # Row -1 holds n and the sums, the others the upper half of the products.
        keys = [(-1, -1), *((-1, int(i)) for i in range(d)), *zip(upper[0].tolist(), upper[1].tolist(), strict=True)]
        values = [n, *total.tolist(), *products[upper].tolist()]
        out: tuple[list, list, list, list] = ([], [], [], [])
        for (i, j), value in zip(keys, values, strict=True):
            k = 0
            while not -(1 << _LIMB) < value < 1 << _LIMB:
                for c, v in zip(out, (i, j, k, value & ((1 << _LIMB) - 1)), strict=True):
                    c.append(v)
                value, k = value >> _LIMB, k + 1
            for c, v in zip(out, (i, j, k, value), strict=True):  # the last limb keeps the sign
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], ["i", "j", "k", "v"])

    limbs = rows.select("x").mapInArrow(sums, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    n, total, products = 0, [0] * d, np.zeros((d, d), dtype=object)
    for r in limbs.collect():
        value = r["v"] << (_LIMB * r["k"])
        if r["i"] >= 0:
            products[r["i"], r["j"]] += value
        elif r["j"] >= 0:
            total[r["j"]] += value
        else:
            n += value
    products = np.triu(products) + np.triu(products, 1).T
    moved = np.array(total, dtype=object)
    # The scatter does not change with the shift; the sums do.
    exact = n * products - np.outer(moved, moved)
    return Scatter(n, [int(s + n * h) for s, h in zip(total, shift.tolist(), strict=True)], exact)


@dataclass(frozen=True)
class Whitening:
    """``mean`` is exact as (sums, n); ``axes`` has one unit eigenvector per column, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float


def fit(found: Scatter, components: int) -> Whitening:
    """The first ``components`` eigenvectors with a variance above rounding."""
    v = found.covariance
    if not found.n:
        return Whitening(0, found.sums, np.zeros(0), np.zeros((len(v), 0)), 0.0)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    kept = order[values[order] > len(v) * np.finfo(np.float64).eps * max(values.max(), 0.0)]
    trace = sum(found.matrix[i, i] for i in range(len(v))) / (found.n * found.n)
    return Whitening(found.n, found.sums, values[kept], axes[:, kept], trace)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """One row per kept row and component: id, component (from 1), n, deviation (its digits, exact), whitened, explained, identity_error.

    ``identity_error`` is measured on the whitened values: the largest absolute entry of their covariance less the
    identity.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        rows, d = integer_vectors(vectors, {"id": id_col}, vector_col, scale, offset)
        model = fit(scatter(rows, d), components)
        k, n = len(model.eigenvalues), model.n
        shift = np.array([s // n if n else 0 for s in model.sums], dtype=np.int64)
        rest = [s - n * int(h) for s, h in zip(model.sums, shift, strict=True)]  # sums of the shifted vectors, in [0, n)
        inner, square = np.array([r / n if n else 0.0 for r in rest]), sum(r * r for r in rest)
        axes = model.axes / np.sqrt(model.eigenvalues)

        def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exact_rest = np.array(rest, dtype=object)
            for batch in batches:
                for at in range(0, batch.num_rows, _BLOCK):
                    part = batch.slice(at, _BLOCK)
                    x = matrix(part.column("x"), d) - shift
                    largest = int(np.abs(x).max(initial=0))
                    if d * largest * max(largest, n) < 1 << 62:
                        squares, dots = (x * x).sum(axis=1), x @ exact_rest.astype(np.int64)
                    else:
                        squares, dots = (x.astype(object) ** 2).sum(axis=1), x.astype(object) @ exact_rest
                    # sum((n * x - S) ** 2) with x and S shifted alike
                    deviation = [str(n * n * int(q) - 2 * n * int(p) + square) for q, p in zip(squares, dots, strict=True)]
                    white = (x.astype(np.float64) - inner) @ axes
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, max(k, 1))[: len(x) + 1] if k else np.zeros(len(x) + 1), pa.int32()), pa.array(white.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(deviation, pa.string()), lists], ["id", "deviation", "w"])

        kind = dict(rows.dtypes)["id"]
        out = f"{id_col} {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
        if not k:
            return spark.createDataFrame([], out)
        white = materialize(rows.mapInArrow(values, f"id {kind}, deviation string, w array<double>"), outer=True)
        error = identity_error(white, k)
        told = white.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("at", "whitened"))
        explained = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]), F.col("at") + 1)
        return told.select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` (arrays of ``k`` doubles) less the identity; centred before multiplying."""
    means = white.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    at = [F.col("w")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*[F.avg(at[i] * at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs, strict=True))


def digest(whitened: DataFrame) -> DataFrame:
    """The columns of the registered query. A deviation that no long can hold is null there; its digits follow."""
    return whitened.select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_digits"))
