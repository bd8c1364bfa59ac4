"""LM scoring by deleted interpolation of a bigram model.

p(w | v) = l1 * c(v, w) / c(v) + l2 * c(w) / N + l3 / (V + 1), with weights l for each bucket of the context's count
(powers of two), learned by expectation-maximisation on counts held out of the training documents: one seventh of
them is held out, the estimates are made from the other counts, and the weights maximise the held-out likelihood.
The final estimates use all training counts. Words and the end of the text are tokens; the context of the first
word is an end.

Counts of words and bigrams are grouped sums over all training documents, keyed by 64-bit hashes, and exact. The
table of counts, written once and bucketed by key, holds the bigrams seen twice or more, and those seen once that a
document of the test fold holds: any other bigram that a training document asks for is seen once, by itself, or not at
all once that document is held out, so it need not be looked up. What a document needs is looked up in two ways: the
most frequent words and bigrams (at most ``head_words`` and ``head_bigrams``, a fixed bound) are broadcast, which also
keeps hot keys out of the shuffle; all others are requests, one row each, that are joined with the counts and summed
per document. Where a word or its context is outside the head, three counts make one term: their requests carry the
position, by which they are put together after the join. So the heads' sizes say only which way a count is looked up,
never what it is. Documents are scored in ``slices`` passes by a hash of the row, so that the disk holds the requests of
one pass. A term travels as a float, so scores are good to about six digits.

The held-out statistics are sums in cells (bucket, unigram and bigram probability in half powers of two), at most
BUCKETS * STEPS * STEPS and, as a bigram's probability is at least one in its bucket, in fact under 300,000 whatever
the size of the corpus. EM takes each cell's mean probabilities, so only the spread within a cell (at most a factor of
1.42) is lost: with means kept, a mixture's log likelihood is off by at most log(1.42)^2 / 8, 0.016, a token.

Defined results: a null text is empty: its one token is the end; a null id is hashed as ''; repeated rows each get
their row; without any training document all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import bucketed, materialize
from barspark.llm.textvec import SPACED, hashed_words, mix, text_slices

U = np.uint64
END = U(0xE7D0C0FFEE123456)
BUCKETS = 48
#: Half powers of two of a probability that are told apart.
STEPS = 96
HEAD_WORDS = 1 << 19
HEAD_BIGRAMS = 1 << 20
FLUSH = 12_000_000
_ROW = "k long, rid long, at long, a double, r double"
_REQUEST, _SUMS, _WORD, _CONTEXT, _DOC, _HELD, _CELL, _SPLIT = range(8)
END_KEY = int((END & ~U(1)).view(np.int64))


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token keys of all texts, each closed by an end, offsets by text)."""
    h, at = hashed_words(parts, SPACED)
    at = at + np.arange(len(at))
    out = np.full(at[-1], END & ~U(1), dtype=np.uint64)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[1:] - 1] = False
    out[inside] = h & ~U(1)
    return out, at


def pair_keys(tok: np.ndarray) -> np.ndarray:
    before = np.concatenate([[END & ~U(1)], tok[:-1]]).astype(np.uint64)
    return mix(before * U(0x9FB21C651E98DF25) + tok) | U(1)


@dataclass
class Head:
    """Sorted keys with their counts and held-out counts."""

    keys: np.ndarray
    n: np.ndarray
    f: np.ndarray
    starts: np.ndarray | None = None

    def count(self, place: np.ndarray, found: np.ndarray, without_held: bool) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(place), dtype=np.int64)
        n = self.n[place].astype(np.int64)
        return np.where(found, n - self.f[place] if without_held else n, 0)

    def find(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found).

        Keys are mixed, so their leading bits deal them evenly: where a run of leading bits begins is one look into a
        table, made once in a process, and the key is one of the few from there; a binary search misses the cache at
        most of its steps.
        """
        if not len(self.keys):
            return np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=bool)
        if self.starts is None:
            bits = min(len(self.keys).bit_length(), 32)
            self.shift = U(64 - bits)
            begin = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
            self.starts = np.minimum(begin, len(self.keys) - 1).astype(np.int32)
        i = self.starts[k >> self.shift].astype(np.int64)
        met = self.keys[i]
        left = np.flatnonzero(met < k)
        while len(left):
            left = left[i[left] < len(self.keys) - 1]
            i[left] += 1
            met[left] = self.keys[i[left]]
            left = left[met[left] < k[left]]
        return i, met == k


@dataclass
class Model:
    words: Head
    pairs: Head
    n: int
    v: int
    n_held: int

def _head(counts: DataFrame, limit: int) -> Head:
    """All keys above the smallest count for which at most ``limit`` keys remain, and the end in any case."""
    bins = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("b")).count().collect()}
    total, least = 0, None
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > limit:
            break
        least = b
    frequent = F.lit(False) if least is None else F.floor(F.log2("n") * 8) >= least
    got = counts.where(frequent | (F.col("k") == END_KEY)).select("k", "n", "f").toArrow()
    k = got["k"].to_numpy().view(np.uint64)
    order = np.argsort(k)
    n, f = got["n"].to_numpy()[order], got["f"].to_numpy()[order]
    small = np.uint32 if len(n) and n.max() < 1 << 32 else np.int64
    return Head(k[order], n.astype(small), f.astype(small))


def count_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """(k, n, f) of all words (even keys) and of bigrams (odd keys), in ``buckets`` partitions by k; docs: (text, part).

    Part 0 is trained on, 1 also held out; of part 2 no token is counted. Bigrams seen once are listed only if part 2
    holds them.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for fold, parts in held.items():
                if parts:
                    k = np.concatenate(parts)
                    parts.clear()
                    k.sort()
                    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    k, n = k[at], np.diff(np.append(at, len(k)))
                    del at
                    for a in range(0, len(k), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64) * 4 + fold)], ["k", "x"])

        for batch in batches:
            fold = batch.column(1).to_numpy()
            for first, parts in text_slices(batch.column(0)):
                tok, at = tokens(parts)
                pair = pair_keys(tok)
                which = np.repeat(fold[first : first + len(parts)], np.diff(at))
                for x in held:
                    if (some := which == x).any():
                        held[x] += [tok[some], pair[some]] if x < 2 else [pair[some]]
                size += 2 * len(tok)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.mapInArrow(partial, "k long, x long")  # x: count and part
    n, part = F.shiftright("x", 2), F.col("x").bitwiseAND(3)
    # Tasks have combined their rows already: dealing them out first spares a second combining, which spills.
    summed = rows.repartition(buckets, "k").groupBy("k").agg(F.sum(F.when(part < 2, n).otherwise(0)).alias("n"), F.sum(F.when(part == 1, n).otherwise(0)).alias("f"), F.max(part == 2).alias("t"))
    return summed.where("k % 2 = 0 OR n >= 2 OR n = 1 AND t").select("k", "n", "f")


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def _step(x: np.ndarray) -> np.ndarray:
    """The half power of two of a probability, 0 (for 1) to STEPS - 1."""
    return np.clip(np.round(-2 * np.log2(np.maximum(x, 1e-30))), 0, STEPS - 1).astype(np.int64)


def learn_weights(cells: list[tuple[int, float, float, float]], v: int, rounds: int = 60) -> np.ndarray:
    """EM over (bucket, mean bigram and unigram probability, count): a row of weights (bigram, unigram, uniform) a bucket.

    A context that was never seen has no bigram term, so that the weights of its bucket are those of the other two.
    """
    w = np.tile(np.array([0.3, 0.6, 0.1]), (BUCKETS, 1))
    w[0] = [0.0, 0.85, 0.15]
    if not cells:
        return w
    bucket, p2, p1, n = (np.array(x) for x in zip(*cells, strict=True))
    bucket = bucket.astype(np.int64)
    p = np.column_stack([p2, p1, np.full(len(p1), 1 / (v + 1))])
    for _ in range(rounds):
        share = w[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.zeros_like(w)
        np.add.at(new, bucket, share)
        new += 1e-3 * w
        w = np.maximum(new / new.sum(axis=1, keepdims=True), [0.0, 1e-6, 1e-6])
        w /= w.sum(axis=1, keepdims=True)
    return w


def _requests(docs: DataFrame, shared: Broadcast, weights: np.ndarray | None = None) -> DataFrame:
    """Rows for the join with the counts; docs: (rid, doc_id, text, unlisted); shared: the model. Without weights: to learn them.

    ``at`` packs the position, the kind of row and a bit: of requests, that the document's bigrams which are not in the
    table are counted once. A word's count belongs to its own position and, as the context's, to the next one.
    """
    learn = weights is None

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total, p0 = max(m.n - (m.n_held if learn else 0), 1), 1 / (m.v + 1)
        end_at, end_ok = m.words.find(np.array([END & ~U(1)]))
        for batch in batches:
            rid = batch.column(0).to_numpy()
            unlisted = batch.column(3).to_numpy()
            for first, parts in text_slices(batch.column(2)):
                tok, at = tokens(parts)
                rids = np.repeat(rid[first : first + len(parts)], np.diff(at))
                once = np.repeat(unlisted[first : first + len(parts)], np.diff(at)).astype(np.int64)
                pos = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
                place, known = m.words.find(tok)
                cw = m.words.count(place, known, learn)
                known |= tok == END & ~U(1)  # not in the head only if nothing was counted
                cv = np.concatenate([m.words.count(end_at, end_ok, learn), cw[:-1]])
                before = np.concatenate([[True], known[:-1]])
                whole = known & before
                p1 = cw / total
                b = _bucket(cv)
                pair = pair_keys(tok)
                spot, near = m.pairs.find(pair)
                ask = whole & ~near & (cv > 0)
                c = np.where(near, m.pairs.count(spot, near, learn), once)
                here, split, far = whole & ~ask, ~whole, ~known
                out = [
                    (pair[split].view(np.int64), rids[split], pos[split], _SPLIT, once[split], np.where(before, cv, -1)[split].astype(float), np.where(known, cw, -1)[split].astype(float)),
                    (tok[far].view(np.int64), rids[far], pos[far], _WORD, 0, None, None),
                    (tok[far].view(np.int64), rids[far], pos[far] + 1, _CONTEXT, 0, None, None),
                ]
                if learn:
                    # Cells: (bucket, step of each probability) with the count and the sums of the probabilities.
                    p2 = np.where(cv > 0, c / np.maximum(cv, 1), 0.0)
                    cell, at_cell, n = np.unique((b * STEPS + _step(p1))[here] * (STEPS + 1) + np.where(p2 > 0, _step(p2), STEPS)[here], return_inverse=True, return_counts=True)
                    sums = [np.bincount(at_cell, x[here], minlength=len(cell)) for x in (p2, p1)]
                    out += [(pair[ask].view(np.int64), np.zeros(ask.sum(), dtype=np.int64), 0, _HELD, 0, cv[ask].astype(float), cw[ask].astype(float)), (cell, cell, n, _CELL, 0, *sums)]
                else:
                    w = weights
                    a = np.where(cv > 0, w[b, 0] / np.maximum(cv, 1), 0.0)
                    r = w[b, 1] * p1 + w[b, 2] * p0
                    full = m.n + m.v + 1
                    # log(a c + r) is log(r) here and log(1 + c a / r) once the count is known.
                    score = np.add.reduceat(np.where(split, 0.0, np.log10(np.where(ask, 0.0, a * c) + r)), at[:-1])
                    base = np.add.reduceat(np.where(known, np.log10((cw + 1) / full), 0.0), at[:-1])
                    n_known = np.add.reduceat((known & (cw > 0)).astype(np.int64), at[:-1])
                    own, ids = rid[first : first + len(parts)], batch.column(1).slice(first, len(parts))
                    out += [
                        (pair[ask].view(np.int64), rids[ask], 0, _REQUEST, once[ask], (a / r)[ask].astype(np.float32).astype(float), None),
                        (own, own, 0, _SUMS, 0, score, base),
                        (ids.fill_null(0).to_numpy(), own, 0, _DOC, ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at).astype(float), n_known.astype(float)),
                    ]
                for k, r_id, p, kind, bit, x, y in out:
                    z = len(k)
                    packed = np.broadcast_to((np.asarray(p, dtype=np.int64) * 8 + kind) * 2 + bit, z)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(r_id, pa.int64()), pa.array(packed, pa.int64()), *[pa.nulls(z, pa.float64()) if q is None else pa.array(q, pa.float64()) for q in (x, y)]], ["k", "rid", "at", "a", "r"])

    return docs.mapInArrow(look, _ROW)


def _unpacked(rows: DataFrame) -> DataFrame:
    """Adds kind, bit and pos (-1 where a row is of no position)."""
    kind = F.shiftright("at", 1).bitwiseAND(7).cast("int")
    rows = rows.withColumn("kind", kind).withColumn("bit", F.col("at").bitwiseAND(1))
    return rows.withColumn("pos", F.when(F.col("kind").isin(_SPLIT, _WORD, _CONTEXT), F.shiftright("at", 4)).otherwise(-1))


def _split_counts() -> list[Column]:
    """The counts of a position's bigram, word and context from its requests."""
    kind, c = F.col("kind"), F.col("c").cast("double")
    return [
        F.max(F.when(kind == _SPLIT, c)).alias("c2"),
        F.max(F.when(kind == _SPLIT, F.col("r")).when(kind == _WORD, c)).alias("cw"),
        F.max(F.when(kind == _SPLIT, F.col("a")).when(kind == _CONTEXT, c)).alias("cv"),
    ]


def _bucket_of(cv: Column) -> Column:
    """As _bucket."""
    return F.when(cv > 0, F.least(F.length(F.bin(cv.cast("long"))), F.lit(BUCKETS - 1))).otherwise(0)


def _step_of(x: Column) -> Column:
    """As _step."""
    return F.least(F.greatest(F.round(-2 * F.log2(F.greatest(x, F.lit(1e-30)))), F.lit(0.0)), F.lit(STEPS - 1.0)).cast("long")


def _learned(rows: DataFrame, counts: DataFrame, shared: Broadcast) -> np.ndarray:
    """The mixture weights; rows: the training documents held out of the estimates."""
    held = _requests(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.lit(0).alias("unlisted")), shared)
    met = _unpacked(held.join(counts.select("k", (F.col("n") - F.col("f")).alias("c")), "k", "left")).withColumn("c", F.coalesce("c", F.lit(0)))
    total = float(max(shared.value.n - shared.value.n_held, 1))

    def sums(cv: Column, cw: Column, c2: Column) -> list[Column]:
        p2, p1 = F.when(cv > 0, c2 / F.greatest(cv, F.lit(1.0))).otherwise(0.0), cw / F.lit(total)
        cell = (_bucket_of(cv) * STEPS + _step_of(p1)) * (STEPS + 1) + F.when(p2 > 0, _step_of(p2)).otherwise(STEPS)
        return [cell.cast("long").alias("cell"), F.lit(1).cast("long").alias("n"), p2.alias("p2"), p1.alias("p1")]

    kind = F.col("kind")
    ready = met.where(kind == _CELL).select(F.col("rid").alias("cell"), F.shiftright("at", 4).alias("n"), F.col("a").alias("p2"), F.col("r").alias("p1"))
    asked = met.where(kind == _HELD).select(*sums(F.col("a"), F.col("r"), F.col("c").cast("double")))
    split = met.where(kind.isin(_SPLIT, _WORD, _CONTEXT)).groupBy("rid", "pos").agg(*_split_counts()).where("c2 IS NOT NULL")
    split = split.select(*sums(F.col("cv"), F.col("cw"), F.col("c2")))
    cells = ready.unionAll(asked).unionAll(split).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
    got = sorted(cells.collect())  # bounded: buckets x steps x steps
    return learn_weights([(r["cell"] // (STEPS + 1) // STEPS, r["p2"] / r["n"], r["p1"] / r["n"], float(r["n"])) for r in got], shared.value.v)


def _scores(rows: DataFrame, counts: DataFrame, shared: Broadcast, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row."""
    n, v = shared.value.n, shared.value.v
    asked = _requests(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "unlisted"), shared, weights)
    met = _unpacked(asked.join(counts.select("k", F.col("n").alias("c")), "k", "left"))
    kind, c = F.col("kind"), F.col("c")
    met = met.withColumn("c", F.coalesce("c", F.when(kind.isin(_REQUEST, _SPLIT), F.col("bit")).otherwise(0)))
    full = float(n + v + 1)

    def blend(c2: Column, cv: Column, cw: Column) -> Column:
        weight = lambda i: F.get(F.array(*[F.lit(float(x)) for x in weights[:, i]]), _bucket_of(cv))
        return F.log10(F.when(cv > 0, weight(0) * c2 / cv).otherwise(0.0) + weight(1) * cw / F.lit(float(max(n, 1))) + weight(2) * F.lit(1 / (v + 1)))

    # Dealt by row once: both groupings below, by position and by row, find their rows together.
    value = F.when(kind == _REQUEST, F.log10(1 + F.col("a") * c).cast("float").cast("double")).otherwise(F.col("a"))
    carried = F.when(kind == _REQUEST, F.lit(None)).when(kind == _DOC, F.when(F.col("bit") == 1, F.col("k"))).otherwise(c)
    dealt = met.select("rid", "pos", "kind", value.alias("a"), "r", carried.alias("c")).repartition("rid")
    by_position = dealt.groupBy("rid", "pos").agg(
        F.max(F.when(kind == _DOC, c)).alias("doc_id"),
        F.max(F.when(kind == _DOC, F.col("a"))).alias("n_tokens"),
        F.sum(F.when(kind == _WORD, (c > 0).cast("double")).when(kind == _DOC, F.col("r"))).alias("n_known"),
        F.sum(F.when(kind == _WORD, F.log10((c + 1) / F.lit(full))).when(kind == _SUMS, F.col("r"))).alias("base_score"),
        F.sum(F.when(kind.isin(_REQUEST, _SUMS), F.col("a"))).alias("score"),
        *_split_counts(),
    )
    term = F.when((F.col("pos") >= 0) & F.col("c2").isNotNull(), blend(F.col("c2"), F.col("cv"), F.col("cw"))).otherwise(F.col("score"))
    return by_position.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").cast("long").alias("n_tokens"), F.sum("n_known").cast("long").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum(term).alias("score")
    ).drop("rid")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, test_fold: int = 2, weight_fold: int = 3, head_words: int = HEAD_WORDS, head_bigrams: int = HEAD_BIGRAMS, slices: int = 3, buckets: int | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(id as text) mod ``folds`` is ``test_fold`` are not learned from; those with ``weight_fold``
    are training documents whose counts are held out while the weights are learned. ``buckets`` of the table of
    counts: as many as shuffle partitions, where not given.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), fold.alias("fold"))
    part = F.when(F.col("fold") == test_fold, 2).when(F.col("fold") == weight_fold, 1).otherwise(0)
    with bucketed(count_tokens(rows.select("text", part.alias("part")), buckets), "k", buckets) as counts:
        words, pairs = counts.where("k % 2 = 0"), counts.where("k % 2 <> 0")
        n, n_held, v = words.agg(F.sum("n"), F.sum("f"), F.count("*")).first()
        n, n_held = n or 0, n_held or 0
        model = Model(_head(words, head_words), _head(pairs, head_bigrams), n, v, n_held)
        shared = spark.sparkContext.broadcast(model)
        weights = _learned(rows.where((F.col("fold") == weight_fold) & (F.col("fold") != test_fold)), counts, shared)
        rows = rows.withColumn("unlisted", (F.col("fold") != test_fold).cast("int"))
        part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))
        done = [materialize(_scores(rows.where(part == i), counts, shared, weights)) for i in range(slices)]
        shared.unpersist()
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    return reduce(DataFrame.unionAll, done).select(F.col("doc_id").alias(id_col), (crc == test_fold).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
