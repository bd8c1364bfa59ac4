"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors of a label are one class, so a hot vector costs one row. Each table hashes a class to the signs of its
products with ``bits`` random hyperplanes; two vectors at the threshold's angle share a table's code with probability
(1 - angle / pi) ** bits, and as many tables are made as the recall needs. ``bits`` follows from the number of
classes, so that buckets keep their size as the table grows.

Buckets are first searched with the sign bits of all tables alone (and of more hyperplanes, where these are fewer than
``SKETCH``; a few dozen bytes a class): the rows that differ in
few enough bits from another one of their bucket go on, with six standard deviations allowed for at the threshold. Only
to these their vectors are joined, and compared by exact cosine in double precision. A pair that meets in several
tables counts in the first of these, which both rows know from their bits, so links are counted once without being
listed; each bucket gives trees of links, and components are found on those. Vectors travel in the type they have
(float vectors as floats) and are widened in the task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, null labels and null
ids link with nothing (and take no part in any join); vectors of different lengths do not link; each row is a vector
of its own, also where rows share an id: equal rows link with each other, rows of one id that differ do not. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm import pairs
from barspark.llm.common import connected_components, join_counted, materialize, scratch

#: Sign bits by which candidates are told.
SKETCH = 256


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables that find a pair of cosine ``threshold`` with probability ``recall``."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(chunk), -1)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.999999, bucket: int = 256, seed: int = 7) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. ``recall`` is that of a pair at the threshold."""
    with scratch(vectors.sparkSession):
        fine = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0)
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.col(label_col).alias("label"))
        rows = rows.withColumn("ok", F.coalesce(fine & F.coalesce(finite, F.lit(False)), F.lit(False)))
        good = rows.where("ok").withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(1), "label", "v"))
        # One vector stands for its class: the members are equal.
        classes = good.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("weight"), F.first(F.xxhash64("label", F.size("v"))).alias("part"), F.first("v").alias("v"))
        classes = materialize(classes.withColumn("rep", F.xxhash64("h1", "h2")))
        largest = classes.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        bits = min(40, max(4, round(math.log2(max(largest, 1) / bucket)) if largest > bucket else 4))
        n_tables = tables_for(threshold, bits, recall)
        turn = math.acos(threshold) / math.pi
        width = max(n_tables * bits, SKETCH)
        most = math.floor(width * turn + 6 * math.sqrt(width * turn * (1 - turn)))

        def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[int, np.ndarray] = {}
            weigh = np.int64(1) << np.arange(bits, dtype=np.int64)
            for batch in batches:
                lengths = batch.column("v").value_lengths().to_numpy()
                for d in np.unique(lengths):
                    part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    if d not in planes:
                        planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), width))
                    x = _matrix(part.column("v"))
                    signs = x / np.abs(x).max(axis=1, keepdims=True) @ planes[d] > 0
                    code = signs[:, : n_tables * bits].reshape(len(x), n_tables, bits) @ weigh
                    sketch = pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
                    for t in range(n_tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(code[:, t]), *[part.column(c) for c in ("part", "rep")], sketch], ["tab", "code", "part", "rep", "sketch"])

        def signs_of(table: pa.Table) -> np.ndarray:
            packed = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
            return np.unpackbits(packed, axis=1, count=width)

        def first_met(linked: np.ndarray, tab: int, signs: np.ndarray) -> np.ndarray:
            """Without the pairs that have met in an earlier table."""
            code = signs[:, : n_tables * bits].reshape(len(signs), n_tables, bits)[:, :tab].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            i, j = np.nonzero(linked)
            for a in range(0, len(i), 100_000):
                met = (code[i[a : a + 100_000]] == code[j[a : a + 100_000]]).any(axis=1)
                linked[i[a : a + 100_000][met], j[a : a + 100_000][met]] = False
            return linked

        def maybe(key: tuple, table: pa.Table) -> np.ndarray:
            signs = signs_of(table)
            s = signs.astype(np.float32) * 2 - 1
            linked = s @ s.T >= width - 2 * most
            np.fill_diagonal(linked, False)
            return first_met(linked, key[0], signs)

        def close(key: tuple, table: pa.Table) -> np.ndarray:
            x = _matrix(table["v"])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            linked = x @ x.T / (norm[:, None] * norm[None, :]) >= threshold
            np.fill_diagonal(linked, False)
            return first_met(linked, key[0], signs_of(table))

        keys = ["tab", "code", "part"]
        hashed = materialize(classes.select("rep", "part", "v").mapInArrow(codes, "tab int, code long, part long, rep long, sketch binary"))
        asked = materialize(pairs.candidates(pairs.deal(hashed, keys), keys, maybe))
        sketches = hashed.where("tab = 0").select("rep", "sketch")
        met = asked.join(classes.select("rep", "weight", "v"), "rep").join(sketches, "rep")
        found = materialize(pairs.links(met, keys, close))
        groups = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
        return materialize(_result(rows, good, classes, found, groups).select(F.col("id").alias(id_col), "n_links", F.col("group_id").alias("component_id"), F.col("id").eqNullSafe(F.col("group_id")).alias("kept")), outer=True)


def _result(rows: DataFrame, good: DataFrame, classes: DataFrame, found: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, n_links, group_id): what the classes have found, for each row."""
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "rep", "first_id", "weight").join(groups, F.col("rep") == F.col("node"), "left").drop("node")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "component", "left").join(links, "rep", "left")
    named = materialize(named.select("h1", "h2", "weight", F.coalesce("least_id", "first_id").alias("group_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    linked = join_counted(good.select("id", "h1", "h2"), named, ["h1", "h2"], "weight", F.col("id"))
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"))
    return linked.select("id", F.col("n_links").cast("long").alias("n_links"), "group_id").unionAll(alone)
