"""Comparing all rows of each bucket with numpy, large buckets in pairs of blocks.

A bucket of up to ``block`` rows is one table in one task. A larger one is dealt by hash into blocks, and each pair
of blocks is a task's table of its own, so no task ever holds more than about two blocks. Pairs of rows are never
listed: what comes back is one row per row and table, either that it has a candidate there (:func:`candidates`) or the
summed weight of its links and the root of its links' tree (:func:`links`). A dense bucket of m rows gives m rows
(times its number of blocks), not m * m.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import join_counted, materialize, per_group

BLOCK = 1024
#: Tells from a bucket's key and its rows which of them are alike: a boolean matrix.
Alike = Callable[[tuple, pa.Table], np.ndarray]


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over the boolean matrix ``linked``."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


def deal(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` (a written table: keys, rep long, more) with their block, once for each pair of blocks (bi, bj)."""
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > block))
    dealt = join_counted(rows, sizes, keys, "n_rows", F.col("rep"), "left")
    dealt = dealt.withColumn("n_blocks", F.ceil(F.coalesce("n_rows", F.lit(1)) / block).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return dealt.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("n_rows", "n_blocks", "other")


def _matrix(key: tuple, table: pa.Table, alike: Alike) -> np.ndarray | None:
    if table.num_rows < 2:
        return None
    linked = alike(key, table)
    np.fill_diagonal(linked, False)
    if key[-1] != key[-2]:
        blk = table["blk"].to_numpy()
        linked &= blk[:, None] != blk[None, :]
    return linked


def candidates(dealt: DataFrame, keys: list[str], alike: Alike) -> DataFrame:
    """(keys, bi, bj, blk, rep) of the ``dealt`` rows that are ``alike`` another one of their table."""

    def kernel(key: tuple, table: pa.Table) -> pa.Table | None:
        linked = _matrix(key, table, alike)
        if linked is None:
            return None
        return table.select([*keys, "bi", "bj", "blk", "rep"]).take(pa.array(np.flatnonzero(linked.any(axis=1))))

    types = dict(dealt.dtypes)
    return per_group(dealt, [*keys, "bi", "bj"], kernel, ", ".join(f"{c} {types[c]}" for c in [*keys, "bi", "bj", "blk", "rep"]))


def links(dealt: DataFrame, keys: list[str], alike: Alike) -> DataFrame:
    """(rep, links, root) from ``dealt`` rows (keys, bi, bj, blk, rep, weight and what ``alike`` needs)."""

    def kernel(key: tuple, table: pa.Table) -> pa.Table | None:
        linked = _matrix(key, table, alike)
        if linked is None or not (some := linked.any(axis=1)).any():
            return None
        ids, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
        n = (linked.astype(np.float64) @ weight.astype(np.float64)).astype(np.int64)
        return pa.table({"rep": ids[some], "links": n[some], "root": roots(linked, ids)[some]})

    return per_group(dealt, [*keys, "bi", "bj"], kernel, "rep long, links long, root long")
