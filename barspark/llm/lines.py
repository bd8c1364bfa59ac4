"""Line dedup by pairwise alignment.

Each line (stripped, not blank) is hashed, and so are the runs of 2 and of ``common`` consecutive lines. Documents
that hold the same run overlap there. A rare run (at most ``rare`` holders) pairs all its holders; a frequent one
pairs each of them with the first of its own holders, so a run that a third of the documents share gives one pair per
holder, and a block is found although its single lines occur elsewhere before. A run counts, however many documents
hold it, if it has ``common`` lines, or at least ``long`` bytes, or is all that the later document holds; shorter runs
count if they are rare. Two documents are aligned if they share a run that counts or ``common`` lines of any kind. The
pair's line hashes are aligned by patience diff: lines that are unique in both and keep their order are anchors
(longest increasing subsequence), matches grow from the anchors to both sides, and gaps between anchors are aligned
the same way again. Aligned blocks with a run that counts or at least ``common`` lines are deleted from the later
document.

Equal texts are aligned once, as the document of the first of them; every later copy of a text with lines loses all
of it. A first holder meets its partners in a sorted stream, so its lines are sent once to a task, not once a pair.

"Earlier" is the smaller id (null last; then by text hash). Defined results: null and empty texts have no lines and
stay as they are; rows that repeat both id and text are one document, each of them treated alike (so a document that
is not a copy of an earlier id stays as often as it occurs); blank lines belong to a block only between its matches;
all other columns are kept, whatever their names, but a caller's n_lines and n_deleted give way to the results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import PARTS, fresh, join_counted, materialize, scratch
from barspark.llm.textvec import byte_table, mix, text_slices, words

RARE = 16
COMMON = 3
LONG = 32
_LINE = byte_table((0x0A, 0x0A))
U = np.uint64


def line_hashes(parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, bytes) of the lines of each text, 0 for blank ones; a line's outer white space does not count."""
    out = []
    for p in parts:
        lines = [x.strip(b" \t\r\x0b\x0c") for x in p.split(b"\n")]
        h = np.zeros(len(lines), dtype=np.uint64)
        size = np.array([len(x) for x in lines])
        some = size > 0
        if some.any():
            h[some] = words(b"\n".join(x for x in lines if x), _LINE)[0]
        out.append((mix(h) * some, size))
    return out


def run_keys(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, first line) of the runs of ``k`` lines that are not blank; the lowest two bits of a key are 0.

    The number of blank lines between the lines is part of the run.
    """
    at = np.flatnonzero(h)
    n = max(len(at) - k + 1, 0)
    key = h[at[:n]]
    for j in range(1, k):
        key = mix(key * U(0x9FB21C651E98DF25) + h[at[j : j + n]] + (at[j : j + n] - at[j - 1 : j - 1 + n]).astype(np.uint64))
    return key & ~U(3), at[:n]


def runs(h: np.ndarray, size: np.ndarray, common: int = COMMON, long: int = LONG) -> tuple[np.ndarray, int]:
    """(distinct runs, the run that is the whole text or 0). Bit 0: counts however many hold it; bit 1: one line."""
    out = []
    filled = size[h != 0]
    whole = 0
    for k in sorted({1, 2, common}):
        key, _ = run_keys(h, k)
        if not len(key):
            break
        total = np.convolve(filled, np.ones(k, dtype=np.int64), "valid")
        key |= ((total >= long) | (k >= common)).astype(np.uint64) | U(2 * (k == 1))
        if len(key) == 1:
            whole = int(key.view(np.int64)[0])
        out.append(key)
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64), whole


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (sorted by the first) whose second members increase."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The matches (i, j) of a patience diff of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if cb[x] == 1}
        unique = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if ca[x] == 1 and x in place]
        anchors = _increasing(unique)
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)] if anchors else []:
            todo.append((i0, i, j0, j))
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int], counted: set[int], common: int) -> list[int]:
    """The lines of ``b`` in aligned blocks that hold a run of ``counted`` or at least ``common`` lines that are not blank."""
    found: set[tuple[int, int]] = set()
    h = np.array(b, dtype=np.int64).view(np.uint64)
    for k in (1, 2):
        key, first = run_keys(h, k)
        found |= {(k, int(i)) for x, i in zip(key.view(np.int64).tolist(), first, strict=True) if x in counted}
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            full = [k for k in block if b[k]]
            if len(full) >= common or any((1, k) in found for k in full) or any((2, k) in found for k in full[:-1]):
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _hashed(id_type: str, common: int, long: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts in text_slices(batch.column(3)):
                hashes = line_hashes(parts)
                found = [runs(x, size, common, long) for x, size in hashes]
                cols = [pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64())) for xs in ([x for x, _ in hashes], [x for x, _ in found])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, len(parts)) for c in range(3)], *cols, pa.array([x for _, x in found], pa.int64())], ["id", "tk", "t", "h", "runs", "whole"])

    return run, f"id {id_type}, tk long, t long, h array<long>, runs array<long>, whole long"


def _pairs(texts: DataFrame, rare: int, common: int) -> DataFrame:
    """(first, doc, counted): the documents to align, the earlier first, with the runs that count between them."""
    single = texts.select("doc", F.explode("runs").alias("run"), "whole")
    shared = materialize(single.groupBy("run").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"))
    links = materialize(join_counted(single, shared, ["run"], "n", F.col("doc")))
    one, key = F.col("run").bitwiseAND(2) == 2, F.col("run").bitwiseAND(-4)
    always = (F.col("run").bitwiseAND(1) == 1) | (F.col("run") == F.col("whole"))
    far = links.where((F.col("n") > rare) & (F.col("doc") != F.col("first")))
    far = far.groupBy("first", "doc").agg(F.count(F.when(one, 1)).alias("n_shared"), F.collect_set(F.when(always, key)).alias("counted"))
    # Runs with the same few holders are put together before their pairs are made: at most rare * (rare - 1) / 2.
    near = links.where(F.col("n") <= rare).groupBy("run").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    near = near.groupBy("docs").agg(F.count(F.when(one, 1)).alias("n_shared"), F.collect_set(key).alias("counted"))
    near = near.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("docs") - 1)))
    near = near.select(F.element_at("docs", F.col("i")).alias("first"), F.explode(F.slice("docs", F.col("i") + 1, F.size("docs"))).alias("doc"), "n_shared", "counted")
    met = far.unionAll(near).groupBy("first", "doc").agg(F.sum("n_shared").alias("n_shared"), F.array_distinct(F.flatten(F.collect_list("counted"))).alias("counted"))
    return met.where((F.col("n_shared") >= common) | (F.size("counted") > 0)).select("first", "doc", "counted")


def _aligned(pairs: DataFrame, texts: DataFrame, common: int) -> DataFrame:
    """(doc, gone): the lines to delete by each pair."""
    kind = dict(pairs.dtypes)["doc"]
    hubs = materialize(pairs.groupBy(F.col("first")).agg(F.count("*").alias("n")))
    total = pairs.count()
    parts = F.ceil(F.col("n") * PARTS / F.lit(max(total, 1))).cast("int")
    hub = hubs.select(F.col("first").alias("doc"), parts.alias("parts")).join(texts.select("doc", "h"), "doc")
    hub = hub.select(F.col("doc").alias("first"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "doc", "h", F.array().cast("array<long>").alias("counted"))
    heavy = hubs.where(F.col("n") * PARTS > total).select("first", parts.alias("parts"))  # fewer than PARTS rows
    later = pairs.join(F.broadcast(heavy), "first", "left").withColumn("part", F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int"))
    later = later.join(texts.select("doc", "h"), "doc").select("first", "part", F.lit(1).alias("kind"), "doc", "h", "counted")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        for batch in batches:
            docs, gone = [], []
            kinds, h, counted = (batch.column(c).to_pylist() for c in ("kind", "h", "counted"))
            for i, k in enumerate(kinds):
                if k == 0:
                    a = h[i]
                    continue
                docs.append(i)
                gone.append(common_blocks(a, h[i], set(counted[i]), common))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(docs, pa.int32())), pa.array(gone, pa.list_(pa.int32()))], ["doc", "gone"])

    rows = hub.unionAll(later).repartition("first", "part").sortWithinPartitions("first", "part", "kind")
    return rows.mapInArrow(align, f"doc {kind}, gone array<int>").where(F.size("gone") > 0)


def aligned_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, common: int = COMMON, long: int = LONG) -> DataFrame:
    """(id, tk, lines, copy): the sorted numbers of the lines to delete in each document that has any.

    ``copy``: the text is that of an earlier document, all of it goes (lines is null).
    """
    with scratch(docs.sparkSession):
        keyed = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.xxhash64(F.lit(1), text_col).alias("t"), F.col(text_col).alias("text"))
        run, schema = _hashed(dict(keyed.dtypes)["id"], common, long)
        rows = materialize(keyed.mapInArrow(run, schema).where(F.size("runs") > 0))
        doc = F.struct(F.col("id").isNull().alias("last"), "id", "tk")
        texts = rows.groupBy("tk", "t").agg(F.min(doc).alias("doc"), F.count("*").alias("n"), F.first("h").alias("h"), F.first("runs").alias("runs"), F.first("whole").alias("whole"))  # equal texts, equal arrays
        texts = materialize(texts)
        pairs = materialize(_pairs(texts, rare, common))
        cut = _aligned(pairs, texts, common).groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("lines"))
        again = texts.where("n > 1").select("tk", "t", "n", F.col("doc").alias("first"))
        copies = join_counted(rows.select("id", "tk", "t"), again, ["tk", "t"], "n", F.col("id")).where(doc != F.col("first")).select("id", "tk").distinct()
        none = F.lit(None).cast("array<int>")
        found = cut.select("doc.id", "doc.tk", "lines", F.lit(False).alias("copy")).unionAll(copies.select("id", "tk", none, F.lit(True)))
        return materialize(found, outer=True)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the aligned lines deleted from ``text_col``; adds (or replaces) n_lines and n_deleted."""
    docs = docs.drop("n_lines", "n_deleted")
    i, t, k, gone, copy, n, new = (fresh(x) for x in ("id", "tk", "key", "lines", "copy", "n", "new"))
    cut = aligned_lines(docs, id_col=id_col, text_col=text_col, **options).toDF(i, t, gone, copy)
    keyed = docs.withColumn(k, F.xxhash64(text_col))
    joined = keyed.join(cut, keyed[id_col].eqNullSafe(cut[i]) & (keyed[k] == cut[t]), "left")
    split = F.split(F.col(text_col), "\n")
    left = F.array_join(F.filter(split, lambda x, at: ~F.array_contains(gone, at)), "\n")
    out = joined.withColumn(n, F.when(F.length(text_col) > 0, F.size(split)).otherwise(0)).withColumn(new, F.when(F.col(copy), F.lit("")).when(F.col(gone).isNotNull(), left).otherwise(F.col(text_col)))
    kept = [F.col(new).alias(text_col) if c == text_col else docs[c] for c in docs.columns]
    deleted = F.when(F.col(copy), F.col(n)).otherwise(F.coalesce(F.size(gone), F.lit(0)))
    return out.select(*kept, F.col(n).cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"))
