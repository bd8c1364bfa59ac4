"""Substring dedup over sliding spans of sentences.

A text is cut into sentences (after . ! ? and white space, and at line breaks). Sentences of any length are cut
further after the word of the smallest hash (the last of equal ones) of every ``window`` consecutive words, so cuts
are at most ``window`` words apart, and from ``window`` words inside a passage on they do not depend on what stands
around it. From every sentence a run is hashed: at least two consecutive sentences, and as many as make
``words_per_run`` words. Runs are joined globally by hash; the first occurrence is the smallest (id, text hash,
sentence); sentences covered by any other occurrence of a repeated run are removed. A passage of
4 * window + words_per_run - 3 words (49 with the defaults) holds a whole run in any surroundings.

Rows (run, id, text hash, sentence) are written once. Runs that more than one row in ``HEAVY`` holds are found by an
exact count of frequent items; their first occurrence is a pre-aggregated minimum that is broadcast (fewer than
2 * HEAVY rows). Rows are dealt by hash of the run, where a window finds the first; those of heavy runs, whose first is
known, are spread over parts.

Defined results: null and empty texts have no sentences and stay; texts of fewer words than a run have none; a run
that a document repeats is removed from the second time on; rows that repeat id and text are one document, each of
them treated alike; a null id comes last. What remains of a text keeps its own white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import PARTS, heavy_values, materialize, scratch
from barspark.llm.textvec import SPACED, mix, text_slices, words

WORDS_PER_RUN = 20
WINDOW = 8
_END = re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|\n+")
U = np.uint64


def sentences(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each sentence and the number of words at the end, word hashes, word starts in bytes)."""
    h, starts, _ = words(data, SPACED)
    if not len(h):
        return np.zeros(1, dtype=np.int64), h, starts
    ends = np.fromiter((m.end() for m in _END.finditer(data)), dtype=np.int64)
    first = np.unique(np.concatenate([[0], np.searchsorted(starts, ends), [len(h)]]))
    if len(h) >= window:
        # Reversed, so that the last of equal hashes is taken.
        least = len(h) - 1 - (np.lib.stride_tricks.sliding_window_view(h[::-1], window).argmin(axis=1) + np.arange(len(h) - window + 1))
        first = np.unique(np.concatenate([first, least + 1]))
    return first, h, starts


def runs(first: np.ndarray, h: np.ndarray, words_per_run: int = WORDS_PER_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, sentences) of the run that starts at each sentence and fits in the text."""
    n = len(first) - 1
    if n < 2:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    start = np.arange(n)
    end = np.maximum(np.searchsorted(first, first[:-1] + words_per_run), start + 2)
    fits = end <= n
    start, end = start[fits], end[fits]
    # A run's hash is a polynomial over its words, from prefix sums.
    base, inverse = U(0xD1342543DE82EF95), U(pow(0xD1342543DE82EF95, -1, 1 << 64))
    power, down = np.full(len(h), base, dtype=np.uint64), np.full(len(h) + 1, inverse, dtype=np.uint64)
    power[:1], down[0] = 1, 1
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)])
    a, b = first[start], first[end]
    return mix((total[b] - total[a]) * np.cumprod(down, dtype=np.uint64)[a] + (b - a).astype(np.uint64)), start, end - start


def repeated_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_run: int = WORDS_PER_RUN, window: int = WINDOW) -> DataFrame:
    """(id, tk, starts): the first sentences of the runs to remove from each document that has any."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, parts in text_slices(batch.column(2)):
                got = []
                for p in parts:
                    first, h, _ = sentences(p, window)
                    got.append(runs(first, h, words_per_run))
                n = np.array([len(g[0]) for g in got])
                if not n.sum():
                    continue
                row = pa.array(np.repeat(np.arange(at, at + len(parts)), n))
                key, start = (np.concatenate([g[k] for g in got]) for k in range(2))
                out = [batch.column(0).take(row), batch.column(1).take(row), pa.array(key.view(np.int64)), pa.array(start.astype(np.int32))]
                yield from pa.Table.from_arrays(out, ["id", "tk", "run", "start"]).to_batches(max_chunksize=20_000)

    with scratch(docs.sparkSession):
        keyed = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
        rows = materialize(keyed.mapInArrow(hashed, f"id {dict(keyed.dtypes)['id']}, tk long, run long, start int"))
        heavy = [r[0] for r in heavy_values(rows, "run").collect()]  # fewer than 2 * HEAVY numbers
        place = F.struct(F.col("id").isNull().alias("last"), "id", "tk", "start")
        firsts = rows.where(F.col("run").isin(heavy)).groupBy("run").agg(F.min(place).alias("known"))
        marked = rows.join(F.broadcast(firsts), "run", "left")
        part = F.when(F.col("known").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "tk"), F.lit(PARTS)))
        # For a heavy run the window says nothing, its parts only spread it.
        dealt = marked.withColumn("part", part).withColumn("least", F.min(place).over(Window.partitionBy("run", "part")))
        again = dealt.where(place != F.coalesce("known", "least")).select("id", "tk", "start")
        found = again.groupBy("id", "tk").agg(F.array_sort(F.collect_set("start")).alias("starts"))
        return materialize(found, outer=True)


def dedup_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_run: int = WORDS_PER_RUN, window: int = WINDOW) -> DataFrame:
    """(id, text, n_sentences, n_removed, words_removed) of every document; ``text`` is what remains."""
    found = repeated_sentences(docs, id_col=id_col, text_col=text_col, words_per_run=words_per_run, window=window)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    joined = keyed.join(found, keyed["id"].eqNullSafe(found["id"]) & (keyed["tk"] == found["tk"]), "left").select(keyed["id"], keyed["text"], "starts")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, parts in text_slices(batch.column(1)):
                starts = batch.column(2).slice(at, len(parts)).to_pylist()
                null = batch.column(1).slice(at, len(parts)).is_null().to_pylist()
                text, size, gone, gone_words = [], [], [], []
                for i, p in enumerate(parts):
                    first, h, places = sentences(p, window)
                    drop = np.zeros(len(first) - 1, dtype=bool)
                    if starts[i]:
                        _, start, n = runs(first, h, words_per_run)
                        for k in np.searchsorted(start, starts[i]):
                            drop[start[k] : start[k] + n[k]] = True
                    if drop.any():
                        edge = np.append(places, len(p))
                        edge[0] = 0
                        p = b"".join(p[edge[first[s]] : edge[first[s + 1]]] for s in np.flatnonzero(~drop)).rstrip()
                    text.append(None if null[i] else p.decode("utf-8"))
                    size.append(len(drop))
                    gone.append(int(drop.sum()))
                    gone_words.append(int(np.diff(first)[drop].sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(parts)), pa.array(text, pa.string()), *[pa.array(x, pa.int64()) for x in (size, gone, gone_words)]], ["id", "text", "n_sentences", "n_removed", "words_removed"])

    out = joined.mapInArrow(remove, f"id {dict(keyed.dtypes)['id']}, text string, n_sentences long, n_removed long, words_removed long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


