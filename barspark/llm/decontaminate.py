"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every window of ``k + w - 1`` consecutive words keeps the smallest of its ``w`` k-gram hashes (the leftmost of
equal ones). Documents and benchmark windows that share such a span therefore share that fingerprint at the same
place of the span; the fingerprints are joined, and each hit is extended to the whole window and compared word by
word. A word stands for its 64-bit hash in all of this, so two words that share a hash are one word; with ten words to
a window that cannot be told from equality, for items of one or two words it is a chance of 1e-19 a pair. With k = 5 and
w = 6 no shared span of 10 words is missed. Windows of shorter items are whole grams of their own length; documents are
read once for all lengths.

A fingerprint is one long: the upper 36 bits of the k-gram's hash and, below, 28 bits of its position (an array
of word hashes cannot be longer in Spark), so that ``least`` keeps the leftmost smallest k-gram. Truncated hashes
that meet by chance are dropped by the comparison of words.

A window that many items share is one entry with the list of its items; what a document's hits carry is what its
result lists. Where the benchmark is too large to broadcast, fingerprints that many documents hold are split in the join.

Defined results: null and empty texts have no words; items without words are ignored; an item of fewer words
than a window is one window of its own length (its grams are all kept: winnowing with w = 1); repeated items
count once; an item without an id counts as one item named ''. Repeated documents each get their row. Columns of
other names in the inputs are ignored, so clashing names cannot occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ascii_lower, join_counted, materialize, same_row, scratch, without

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
POSITION_BITS = 28
#: Most words of benchmark text whose windows are broadcast (about 120 bytes a window); beyond, the fingerprints are shuffled.
MAX_BROADCAST_WORDS = 200_000


def _word_hashes(text: Column) -> Column:
    found = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _gram(h: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(h, i + o) for o in range(n)])


def _all_grams(n: int) -> Column:
    """The hashes of all n-grams of the word hashes ``h``."""
    return F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: _gram(F.col("h"), i, n))).otherwise(_empty())


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def _with_minima(df: DataFrame, k: int, w: int) -> DataFrame:
    """Adds ``least_gram``: the winnowed fingerprint of each window of the word hashes ``h``."""
    mask = F.lit((1 << POSITION_BITS) - 1)
    grams = F.when(
        F.size("h") >= k + w - 1,
        F.transform(
            F.sequence(F.lit(0), F.size("h") - k),
            lambda i: _gram(F.col("h"), i, k).bitwiseAND(F.bitwise_not(mask.cast("long"))).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(_empty())
    df = df.withColumn("g", grams)
    least = F.when(
        F.size("g") >= w,
        F.transform(F.sequence(F.lit(0), F.size("g") - w), lambda j: F.least(*[F.get(F.col("g"), j + o) for o in range(w)]) if w > 1 else F.get(F.col("g"), j)),
    ).otherwise(_empty())
    return df.withColumn("least_gram", least).drop("g")


def _computed(name: str) -> Column:
    """The array as an expression: over a plain column, explode would infer a size filter that is pushed below
    the projections and computes the array once more for each element."""
    return F.slice(name, 1, F.size(name))


def _position(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), _word_hashes(F.col(text_col)).alias("h")).distinct()


def _index(bench: DataFrame, lengths: list[int], k: int, w: int) -> DataFrame:
    """(n, f, cands): the windows of ``n`` words by fingerprint, each with its place in the window, words and items."""
    parts = []
    for n in lengths:
        if n == k + w - 1:
            wins = _with_minima(bench.where(F.size("h") >= n), k, w).select("item", "h", F.posexplode(_computed("least_gram")).alias("a", "v"))
            parts.append(wins.select("item", F.lit(n).alias("n"), F.slice("h", F.col("a") + 1, n).alias("wh"), F.shiftright("v", POSITION_BITS).alias("f"), (_position(F.col("v")) - F.col("a")).alias("off")))
        else:
            parts.append(bench.where(F.size("h") == n).select("item", F.lit(n).alias("n"), F.col("h").alias("wh"), _gram(F.col("h"), F.lit(0), n).alias("f"), F.lit(0).alias("off")))
    windows = reduce(DataFrame.unionAll, parts).groupBy("n", "f", "off", "wh").agg(F.collect_set("item").alias("items"))
    return windows.groupBy("n", "f").agg(F.collect_list(F.struct("off", "wh", "items")).alias("cands"))


def _marks(rows: DataFrame, lengths: list[int], k: int, w: int) -> DataFrame:
    """(id, tk, h, n, f, p): the fingerprints of each document, for all lengths at once."""
    full = k + w - 1
    as_mark = lambda n, f, p: F.struct(F.lit(n).alias("n"), f.alias("f"), p.alias("p"))
    whole_grams = lambda n: F.transform(_all_grams(n), lambda f, i: as_mark(n, f, i))
    marks = [whole_grams(n) for n in lengths if n != full]
    if full in lengths:
        rows = _with_minima(rows, k, w)
        marks.append(F.transform(F.array_distinct("least_gram"), lambda v: as_mark(full, F.shiftright(v, POSITION_BITS), _position(v))))
    marked = rows.select("id", "tk", "h", F.concat(*marks).alias("marks"))
    return marked.select("id", "tk", "h", F.explode(_computed("marks")).alias("m")).select("id", "tk", "h", "m.n", "m.f", "m.p")


def _hits(docs: DataFrame, index: DataFrame, longest: int, small: bool) -> DataFrame:
    """(id, tk, q, n, items) for the benchmark windows that occur in ``docs`` (id, tk, h, n, f, p)."""
    if small:
        found = docs.join(F.broadcast(index), ["n", "f"]).withColumn("from", F.lit(0))
    else:
        start = F.greatest(F.col("p") - longest, F.lit(0))
        context = materialize(docs.select("id", "tk", "n", "f", "p", start.alias("from"), F.slice("h", start + 1, 2 * longest).alias("h")))
        index = materialize(index)
        held = context.groupBy("n", "f").count().withColumnRenamed("count", "held")
        found = join_counted(context, materialize(index.join(held, ["n", "f"])), ["n", "f"], "held", F.col("id"))
    begin = lambda c: F.col("p") - c["off"] - F.col("from")
    ok = F.filter("cands", lambda c: (begin(c) >= 0) & (F.slice(F.col("h"), F.greatest(begin(c), F.lit(0)) + 1, F.col("n")) == c["wh"]))
    hit = found.select("id", "tk", "p", "n", F.explode(ok).alias("c"))
    return hit.select("id", "tk", (F.col("p") - F.col("c.off")).alias("q"), "n", F.col("c.items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, w: int = 6, max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """One row per document with (``id_col``, n_words, n_hit, spans, items).

    ``spans``: the hit windows as (start word, words), sorted; ``items``: the sorted ids of the items that occur.
    The benchmark's windows are broadcast while it has at most ``max_broadcast_words`` words, else joined by shuffle.
    """
    full = k + w - 1
    bench = _benchmark(benchmark, item_col, item_text_col)
    stat = bench.agg(F.sum(F.size("h")), F.max(F.size("h")), F.collect_set(F.when(F.size("h").between(1, full - 1), F.size("h")))).first()
    lengths = [*sorted(stat[2] or []), *([full] if (stat[1] or 0) >= full else [])]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), _word_hashes(F.col(text_col)).alias("h"))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS_ANY_CASE), lambda x: x != "")).cast("long").alias("n_words"))
    no_spans, no_items = F.array().cast("array<struct<q:int,n:int>>"), F.array().cast("array<string>")
    if not lengths:
        return base.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), no_spans.alias("spans"), no_items.alias("items"))
    hits = _hits(_marks(rows, lengths, k, w), _index(bench, lengths, k, w), lengths[-1], (stat[0] or 0) <= max_broadcast_words)
    got = hits.groupBy("id", "tk").agg(F.array_sort(F.collect_set(F.struct("q", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["q"] + s["n"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), s["q"] + s["n"] - F.greatest(acc["end"], s["q"]))).alias("total")
    )
    got = materialize(got.withColumn("n_hit", F.aggregate("spans", zero, step, lambda acc: acc["total"]).cast("long")))
    joined = base.join(got, same_row(base, got, ["id", "tk"]), "left")
    return joined.select(
        base["id"].alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns, whatever their names."""
    with scratch(docs.sparkSession):
        key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"))
        found = decontaminate(docs.select(key.alias("doc_id"), "text"), benchmark, **options)
        return without(docs, found.where("n_hit > 0").select(F.col("doc_id.i").alias("id"), F.col("doc_id.t").alias("tk")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the result of :func:`decontaminate`."""
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
