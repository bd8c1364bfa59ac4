"""n-gram Jaccard join by chosen paths.

A document is the set of its shingles of ``n`` words. Documents with equal sets are one class. Each class has a sketch
of ``coords`` minhash values, which agree with probability J. A run starts with all classes in one bucket; a bucket
draws coordinates at random (about ``branching`` of them) and sends each class to one child bucket per drawn
coordinate, named by the path and the class's value there, so that only sets that share the sampled tokens stay
together. Buckets of at most ``small`` sets, and those left at ``depth``, are compared by brute force; the number of
runs follows from the chance that a pair at the threshold stays together down to the last level, so that the recall is
reached. Buckets with the same sets are compared once.

A bucket's brute force has two steps. The sketches alone tell which rows have a partner worth an exact look (five
standard deviations are allowed for: a pair at the threshold is lost with a chance under 1e-6). Only to these rows
their shingle sets are joined, and compared exactly. A pair that meets in several buckets counts in the one of the
smallest path, which follows from the lists of paths that the rows carry, so links are counted once without being
listed. Classes are the connected components over trees of the links.

Defined results: words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters; a text of fewer than
``n`` words is one shingle; null texts and texts without words link with nothing and are kept; documents with equal
sets have similarity 1; a null id links with nothing; each row is a document of its own, also where rows share an id:
rows with equal sets link with each other, rows of one id that differ do not.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm import pairs
from barspark.llm.common import connected_components, join_counted, materialize, scratch, without
from barspark.llm.textvec import LETTERS, hashed_words, mix, text_slices

U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def shingles(parts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash), sorted and distinct, of all parts."""
    h, at = hashed_words(parts, LETTERS)
    count = np.diff(at)
    mult = _odd(11, n)
    g = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
    for j in range(n):
        g += h[j : j + len(g)] * mult[j]
    doc = np.repeat(np.arange(len(parts)), count)
    whole = np.flatnonzero(doc[: len(g)] == doc[n - 1 :]) if len(g) else np.empty(0, dtype=np.int64)
    docs, hashes = [doc[whole]], [mix(g[whole])]
    for i in np.flatnonzero((count > 0) & (count < n)):
        docs.append(np.array([i]))
        hashes.append(mix((h[at[i] : at[i + 1]] * mult[: count[i]]).sum(dtype=np.uint64, keepdims=True) + U(count[i])))
    d, s = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if len(d):
        first = np.ones(len(d), dtype=bool)
        first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        d, s = d[first], s[first]
    return d, s


def runs_needed(threshold: float, coords: int, branching: float, depth: int, recall: float) -> int:
    """Runs after which a pair at ``threshold`` has met in a last-level bucket with probability ``recall``."""
    stay = 1.0
    for _ in range(depth):
        stay = 1 - (1 - branching / coords * threshold * stay) ** coords
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - stay)))


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, coords: int = 64, branching: float = 2.2, depth: int = 4, small: int = 2048, recall: float = 0.99999, seed: int = 3) -> DataFrame:
    """One row per document: id, class_id (smallest id of its connected class), n_links, kept."""
    found = _classified(docs, id_col, text_col, n, threshold, coords, branching, depth, small, recall, seed)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links", "kept")


def _classified(docs: DataFrame, id_col: str, text_col: str, *options) -> DataFrame:
    """(id, tk, class_id, n_links, kept), written."""
    with scratch(docs.sparkSession):
        found = _similar(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text")), *options)
        return materialize(found.withColumn("kept", F.col("id").eqNullSafe(F.col("class_id"))), outer=True)


def _sketched(docs: DataFrame, n: int, coords: int, seed: int) -> DataFrame:
    """(id, tk, h1, h2, size, sketch) of each document (id, tk, text)."""
    mult, add = _odd(seed, coords), _odd(seed + 1, coords)

    def sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts in text_slices(batch.column(2)):
                d, s = shingles(parts, n)
                ids = [batch.column(c).slice(first, len(parts)) for c in range(2)]
                starts = np.searchsorted(d, np.arange(len(parts)))
                size = np.diff(np.append(starts, len(d)))
                full = np.flatnonzero(size)
                low = np.zeros((len(parts), coords), dtype="<u4")
                h1, h2 = np.zeros(len(parts), dtype=np.uint64), np.zeros(len(parts), dtype=np.uint64)
                if len(full):
                    for c in range(coords):
                        low[full, c] = np.minimum.reduceat((s * mult[c] + add[c]) >> U(32), starts[full]).astype("<u4")
                    h1[full], h2[full] = set_hashes(s, starts[full])
                sketch = pa.array([r.tobytes() for r in low], pa.binary())
                yield pa.RecordBatch.from_arrays([*ids, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(size.astype(np.int64)), sketch], ["id", "tk", "h1", "h2", "size", "sketch"])

    return docs.mapInArrow(sketches, "id long, tk long, h1 long, h2 long, size long, sketch binary")


def set_hashes(s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of shingles, whatever their order."""
    return np.add.reduceat(s, starts), np.add.reduceat(mix(s ^ U(0x5851F42D4C957F2D)), starts)


def _paths(classes: DataFrame, threshold: float, coords: int, branching: float, depth: int, small: int, recall: float, seed: int) -> DataFrame:
    """(path, rep): the buckets to compare."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = U(int(branching / coords * 2.0**64))
        coord = mix(np.arange(coords, dtype=np.uint64) + U(1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                path = part.column(0).to_numpy().view(np.uint64)
                low = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype="<u4").reshape(len(path), coords)
                r = mix(path[:, None] ^ coord[None, :])
                i, c = np.nonzero(r < chance)
                child = mix(r[i, c] + low[i, c].astype(np.uint64) * U(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(part.column(1).to_numpy()[i])], ["path", "rep"])

    runs = runs_needed(threshold, coords, branching, depth, recall)
    start = np.random.default_rng(seed + 2).integers(-(1 << 62), 1 << 62, runs).tolist()
    level = classes.select(F.explode(F.array(*[F.lit(x) for x in start])).alias("path"), "rep", "sketch")
    ready: list[DataFrame] = []
    for k in range(depth):
        last = k == depth - 1
        children = materialize(level.mapInArrow(split, "path long, rep long"))  # distinct: coordinates give distinct paths
        sizes = children.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("sig")).where("n > 1")
        compared = F.lit(True) if last else F.col("n") <= small
        # Of buckets with the same sets one is compared; those that are split again are all kept, each with its own draws.
        sizes = materialize(sizes.groupBy("n", F.when(compared, F.col("sig")).otherwise(F.col("path")).alias("sig")).agg(F.min("path").alias("path")).select("path", "n", compared.alias("done")))
        nodes = materialize(join_counted(children, sizes, ["path"], "n", F.col("rep")))
        ready.append(nodes.where("done").select("path", "rep"))
        large = nodes.where("NOT done").select("path", "rep")
        if last or large.isEmpty():
            break
        level = large.join(classes.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
    return reduce(DataFrame.unionAll, ready)


def _token_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, tokens) of the ``wanted`` classes (id, rep), from a document of each."""
    key = "h1 long, h2 long, size long"

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, parts in text_slices(batch.column(0)):
                d, s = shingles(parts, n)
                cut = np.searchsorted(d, np.arange(len(parts) + 1))
                full = np.flatnonzero(np.diff(cut))
                h1, h2 = set_hashes(s, cut[full]) if len(full) else (np.zeros(0, dtype=np.uint64),) * 2
                cols = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.diff(cut)[full])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([s[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())], ["h1", "h2", "size", "tokens"])

    texts = docs.join(wanted.select("id").distinct(), "id").select("text").mapInArrow(sets, key + ", tokens binary")
    keyed = texts.select(F.xxhash64("h1", "h2", "size").alias("rep"), "tokens")  # an id's other texts find no class
    return keyed.join(wanted.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.max("tokens").alias("tokens"))


def _similar(docs: DataFrame, n: int, threshold: float, coords: int, branching: float, depth: int, small: int, recall: float, seed: int) -> DataFrame:
    base = materialize(_sketched(docs, n, coords, seed))
    full = base.where("size > 0 AND id IS NOT NULL")
    classes = full.groupBy("h1", "h2", "size").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("sketch").alias("sketch"))  # equal sets, equal sketches
    classes = materialize(classes.withColumn("rep", F.xxhash64("h1", "h2", "size")))
    ready = materialize(_paths(classes, threshold, coords, branching, depth, small, recall, seed))
    of_rep = ready.groupBy("rep").agg(F.collect_list("path").alias("paths"))  # at most runs * branching ** depth, about
    known = classes.select("rep", "weight", "sketch").join(of_rep, "rep")
    least = math.ceil((threshold - 5 * math.sqrt(threshold * (1 - threshold) / coords)) * coords)

    def first_met(linked: np.ndarray, path: int, paths: list[list[int]]) -> np.ndarray:
        """Without the pairs that also meet in a bucket of a smaller path."""
        some = np.flatnonzero(linked.any(axis=1))
        lower = [(i, p) for i in some for p in paths[i] if p < path]
        if lower:
            rows, names = (np.array(x) for x in zip(*lower, strict=True))
            _, col, n = np.unique(names, return_inverse=True, return_counts=True)
            shared = n[col] > 1  # a path of one row alone is no meeting
            _, col = np.unique(col[shared], return_inverse=True)
            for a in range(0, col.max() + 1 if len(col) else 0, 512):
                part = (col >= a) & (col < a + 512)
                held = np.zeros((len(linked), 512), dtype=np.float32)
                held[rows[shared][part], col[part] - a] = 1
                linked &= held @ held.T == 0
        return linked

    def maybe(key: tuple, table: pa.Table) -> np.ndarray:
        low = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype="<u4").reshape(table.num_rows, coords)
        same = np.zeros((len(low), len(low)), dtype=np.uint8)
        for c in range(coords):
            same += low[:, c][:, None] == low[:, c][None, :]
        linked = same >= least
        np.fill_diagonal(linked, False)
        return first_met(linked, key[0], table["paths"].to_pylist())

    def alike(key: tuple, table: pa.Table) -> np.ndarray:
        rows = [np.frombuffer(x, dtype=np.uint64) for x in table["tokens"].to_pylist()]
        size = np.array([len(r) for r in rows], dtype=np.float64)
        token, where = np.unique(np.concatenate(rows), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), size.astype(np.int64))
        both = np.zeros((len(rows), len(rows)))
        step = max(1, 4_000_000 // len(rows))
        order = np.argsort(where, kind="stable")
        where, row = where[order], row[order]
        for a in range(0, len(token), step):
            lo, hi = np.searchsorted(where, (a, a + step))
            m = np.zeros((len(rows), min(step, len(token) - a)), dtype=np.float32)
            m[row[lo:hi], where[lo:hi] - a] = 1
            both += m @ m.T
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        return first_met(linked, key[0], table["paths"].to_pylist())

    bucketed = materialize(ready.join(known, "rep").select("path", "rep", "sketch", "paths"))
    asked = materialize(pairs.candidates(pairs.deal(bucketed, ["path"], small), ["path"], maybe))
    wanted = materialize(asked.select("rep").distinct().join(classes, "rep").select("rep", "id"))
    tokens = materialize(_token_sets(docs, wanted, n))
    met = asked.join(tokens, "rep").join(known.select("rep", "weight", "paths"), "rep")
    found = materialize(pairs.links(met, ["path"], alike))
    groups = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "size", "rep", "id", "weight").join(groups, F.col("rep") == F.col("node"), "left").drop("node")
    least_id = named.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least_id"))
    named = named.join(least_id, "component", "left").join(links, "rep", "left")
    named = materialize(named.select("h1", "h2", "size", "weight", F.coalesce("least_id", "id").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    linked = join_counted(full.select("id", "tk", "h1", "h2", "size"), named, ["h1", "h2", "size"], "weight", F.col("id"))
    alone = base.where("NOT (size > 0 AND id IS NOT NULL)").select("id", "tk", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("id", "tk", "class_id", F.col("n_links").cast("long").alias("n_links")).unionAll(alone)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the others of each class, with all their columns, whatever their names."""
    with scratch(docs.sparkSession):
        found = _classified(docs, id_col, text_col, *({**_defaults(), **options}).values())
        return without(docs, found.where("NOT kept").select("id", "tk"), id_col, text_col)


def _defaults() -> dict:
    """The options of :func:`similar_documents` after the columns."""
    names = inspect.signature(similar_documents).parameters
    return {k: p.default for k, p in names.items() if k not in ("docs", "id_col", "text_col")}
