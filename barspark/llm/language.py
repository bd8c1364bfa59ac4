"""Language identification by Bayesian evidence fusion.

Evidence: (1) the text, by a naive Bayes model over byte trigrams; (2) the declared markup language; (3) the address
suffix and the host, as a prior that is smoothed from host to suffix to the whole table. The text model is fitted on
a bounded sample of labelled rows; the counts behind (2) and (3) are sums of text posteriors over all rows, by grouped
aggregation. A row's own posterior is left out of the sums that it meets, so no text is counted twice. Heavy hosts and
declared languages are split in the joins.

The sample has about ``sample_rows`` distinct texts, spread evenly over the labels of the whole table (the
``MAX_LABELS`` most frequent), picked by hash of the text; copies count once. Trigrams overlap, so their log likelihoods
are weighed as at most ``effective`` independent ones: the number under which the labels of one half of the sample are
most likely, by a model of the other half. An extra hypothesis, ``und``, stands for text of no known language: all cells
of trigrams are equally likely there, so text has to be likelier in a language than noise. A row is kept if the best
hypothesis is a language with at least ``min_posterior``.

Defined results: null and empty texts and texts without a letter have no text evidence, are ``und`` and are not
kept; a null host, suffix or declared language is a value of its own, ''; repeated rows each get their row; an empty
table or one without labels gives ``und`` for all rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import join_counted, materialize, scratch, without
from barspark.llm.textvec import LOWER, text_slices

CELLS = 1 << 16
SAMPLE_ROWS = 8_000
MAX_LABELS = 500
#: The weights that are tried for the trigrams of a text.
EFFECTIVE = (15, 30, 60, 120, 240, 480)
#: Every ASCII byte that is no lower-case letter becomes a blank.
_BLANKS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_CLEAN = bytes(_BLANKS[b] for b in LOWER)


def trigrams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each trigram whose middle byte belongs to a word, offsets by text)."""
    data = np.frombuffer(b"  ".join([b"", *parts, b""]).translate(_CLEAN), dtype=np.uint8)
    mid = np.flatnonzero(data[1:-1] != 0x20) + 1
    code = (data[mid - 1].astype(np.uint32) << 16) | (data[mid].astype(np.uint32) << 8) | data[mid + 1]
    cells = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    ends = np.cumsum([2, *(len(p) + 2 for p in parts)])
    return cells, np.searchsorted(mid, ends)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log probability by (cell, language)
    effective: float


def _sample(rows: DataFrame, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(label, half, text): distinct labelled texts, as many of each label."""
    labelled = rows.select(F.col(text_col).alias("text"), F.lower(label_col).alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    counts = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LABELS).collect()
    each = sample_rows / max(len(counts), 1)
    if not counts:
        return labelled.where(F.lit(False)).select("label", F.lit(0).alias("half"), "text")
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, each / r["count"]))])  # at most MAX_LABELS
    picked = labelled.withColumn("rate", F.try_element_at(rates, F.col("label"))).withColumn("tk", F.xxhash64("text"))
    picked = picked.where(F.pmod("tk", F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    return picked.groupBy("label", "tk").agg(F.min("text").alias("text")).select("label", F.pmod(F.shiftright("tk", 32), F.lit(2)).cast("int").alias("half"), "text")


def _log_table(found: pa.Table, names: list[str], halves: tuple[int, ...]) -> np.ndarray:
    table = np.full((CELLS, len(names)), 0.2)
    some = np.isin(found["half"].to_numpy(), halves)
    where = np.searchsorted(np.array(names, dtype=object), np.array(found["label"].to_pylist(), dtype=object)[some])
    np.add.at(table, (found["cell"].to_numpy()[some], where), found["n"].to_numpy()[some])
    return np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def best_weight(ll: np.ndarray, size: np.ndarray, label: np.ndarray) -> float:
    """The entry of EFFECTIVE under which the labels are most likely, given each text's log likelihoods by language."""

    def loss(effective: float) -> float:
        x = ll * np.minimum(1.0, effective / size)[:, None]
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), label]).mean())

    return float(min(EFFECTIVE, key=loss))


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model of a bounded sample of labelled rows; see the module's text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            label, half = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, parts in text_slices(batch.column(2)):
                cells, at = trigrams(parts)
                for i in range(len(parts)):
                    c = sums.setdefault((label[first + i], half[first + i]), np.zeros(CELLS, dtype=np.int64))
                    c += np.bincount(cells[at[i] : at[i + 1]], minlength=CELLS)
        for (k, h), c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.string()), pa.array([h] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(c[some])], ["label", "half", "cell", "n"])

    with scratch(rows.sparkSession):
        sample = materialize(_sample(rows, text_col, label_col, sample_rows))
        # At most as many rows as the bounded sample has trigrams.
        found = sample.mapInArrow(count, "label string, half int, cell int, n long").groupBy("label", "half", "cell").agg(F.sum("n").alias("n")).toArrow()
        names = sorted(set(found["label"].to_pylist()))
        if not names:
            return TextModel([], np.zeros((CELLS, 0), dtype=np.float32), EFFECTIVE[0])
        table, own = _log_table(found, names, (0, 1)), _log_table(found, names, (0,))

        def held_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, parts in text_slices(batch.column(2)):
                    cells, at = trigrams(parts)
                    sums = np.concatenate([np.zeros((1, len(names))), np.cumsum(own[cells], axis=0, dtype=np.float64)])
                    ll = sums[at[1:]] - sums[at[:-1]]
                    offsets = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * len(names))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(parts)), pa.array(np.diff(at)), pa.ListArray.from_arrays(offsets, pa.array(ll.ravel()))], ["label", "size", "ll"])

        seen = sample.where("half = 1").mapInArrow(held_out, "label string, size long, ll array<double>").where("size >= 20").toArrow()
    size = seen["size"].to_numpy()
    if len(size) < 20:
        return TextModel(names, table, 60.0)  # too few labelled texts to measure it
    label = np.searchsorted(np.array(names, dtype=object), np.array(seen["label"].to_pylist(), dtype=object))
    ll = np.array(seen["ll"].to_pylist())
    return TextModel(names, table, best_weight(ll, size, label))


def host_suffix(host: Column) -> Column:
    """The last label of a host name, '' for a name of one label."""
    return F.coalesce(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def identify(rows: DataFrame, model: TextModel, *, text: Column, declared: Column, host: Column, keys: dict[str, Column], smoothing: float = 20.0, min_posterior: float = 0.5) -> DataFrame:
    """The ``keys`` of each row with language, posterior, n_grams and kept."""
    with scratch(rows.sparkSession):
        return materialize(_identify(rows, model, text, declared, host, keys, smoothing, min_posterior), outer=True)


def _identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, keys: dict[str, Column], smoothing: float, min_posterior: float) -> DataFrame:
    langs, table, effective = model.languages, model.table, model.effective
    m, names = len(langs), list(keys)
    src = rows.select(*[c.alias(f"k_{k}") for k, c in keys.items()], F.coalesce(F.lower(declared), F.lit("")).alias("declared"), F.coalesce(F.lower(host), F.lit("")).alias("host"), text.alias("text"))
    n_keys = len(src.columns) - 1
    passed = src.columns[:-1]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts in text_slices(batch.column(n_keys)):
                cells, at = trigrams(parts)
                size = np.diff(at)
                sums = np.concatenate([np.zeros((1, m)), np.cumsum(table[cells], axis=0, dtype=np.float64)])
                ll = np.column_stack([sums[at[1:]] - sums[at[:-1]], -size * np.log(CELLS)]) * np.minimum(1.0, effective / np.maximum(size, 1))[:, None]
                ll -= ll.max(axis=1, keepdims=True)
                p = np.exp(ll)
                p = p / p.sum(axis=1, keepdims=True) * (size > 0)[:, None]
                offsets = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * (m + 1))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (ll, p)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, len(parts)) for c in range(n_keys)], pa.array(size.astype(np.int64)), *lists], [*passed, "n_grams", "ll", "p"])

    schema = ", ".join(f"`{c}` {t}" for c, t in src.dtypes if c != "text") + ", n_grams long, ll array<double>, p array<double>"
    scored = materialize(src.mapInArrow(score, schema))
    out = [F.col(f"k_{k}").alias(k) for k in names]
    if not m:
        return scored.select(*out, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), "n_grams", F.lit(False).alias("kept"))
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(m)]
    packed = lambda name: F.array(*[F.col(f"s{i}") for i in range(m)]).alias(name)
    by_host = scored.groupBy("host").agg(*sums, F.count("*").alias("n_host")).withColumn("suffix", host_suffix(F.col("host")))
    by_host = materialize(by_host)
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(m)]
    by_suffix = by_host.groupBy("suffix").agg(*again, F.count("*").alias("n_suffix"))
    of_host = materialize(by_host.select("host", "n_host", "suffix", packed("in_host")).join(by_suffix.select("suffix", packed("in_suffix")), "suffix").drop("suffix"))
    of_declared = materialize(scored.groupBy("declared").agg(*sums, F.count("*").alias("n_declared")).select("declared", "n_declared", packed("in_declared")))
    total = [float(x or 0) for x in by_host.agg(*again).first()]
    met = join_counted(scored, of_host, ["host"], "n_host", F.col(passed[0]))
    met = join_counted(met, of_declared, ["declared"], "n_declared", F.col(passed[0]))
    # Without the row's own posterior.
    rest = lambda sums: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.greatest(F.get(sums, i) - F.get(F.col("p"), i), F.lit(0.0)))
    for name in ("in_host", "in_suffix", "in_declared"):
        met = met.withColumn(name, rest(F.col(name)))
    met = met.withColumn("in_all", rest(F.array(*[F.lit(x) for x in total])))
    plus = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    for name in ("in_host", "in_suffix", "in_declared", "in_all"):
        met = met.withColumn(f"{name}_sum", plus(name))

    def fused(i: Column) -> Column:
        at = lambda name: F.get(F.col(name), i)
        share = (at("in_all") + 1) / (F.col("in_all_sum") + m)
        of_suffix = (at("in_suffix") + smoothing * share) / (F.col("in_suffix_sum") + smoothing)
        prior = (at("in_host") + smoothing * of_suffix) / (F.col("in_host_sum") + smoothing)
        said = (at("in_declared") + smoothing * F.col("said_any")) / (at("in_all") + smoothing)
        return at("ll") + F.log(prior) + F.log(said)

    met = met.withColumn("said_any", (F.col("in_declared_sum") + 1) / (F.col("in_all_sum") + 1))
    none = F.get("ll", F.lit(m)) + F.lit(float(np.log(0.01))) + F.log("said_any")
    met = met.withColumn("fused", F.concat(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), fused), F.array(none))).withColumn("best", F.array_max("fused"))
    met = met.withColumn("posterior", 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best"))))
    guess = F.element_at(F.array(*[F.lit(x) for x in [*langs, "und"]]), F.array_position("fused", F.col("best")).cast("int"))
    met = met.withColumn("language", F.when(F.col("n_grams") > 0, guess).otherwise("und")).withColumn("posterior", F.when(F.col("n_grams") > 0, F.col("posterior")).otherwise(0.0))
    return met.select(*out, "language", "posterior", "n_grams", ((F.col("language") != "und") & (F.col("posterior") >= min_posterior)).alias("kept"))


def identify_documents(docs: DataFrame, model: TextModel | None = None, **options) -> DataFrame:
    """Documents: ``lang`` is the declared language and ``source`` the host."""
    keys = {"doc_id": F.col("doc_id"), "declared_lang": F.col("lang"), "tk": F.xxhash64("text")}
    return identify(docs, model or fit(docs), text=F.col("text"), declared=F.col("lang"), host=F.col("source"), keys=keys, **options)


def identify_pages(pages: DataFrame, model: TextModel, **options) -> DataFrame:
    """Web pages: the html's lang attribute, and host and suffix from the address."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    declared = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)
    host = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return identify(pages, model, text=body, declared=declared, host=host, keys={"page_id": F.col("page_id"), "declared_lang": declared, "host": host}, **options)


def known_language(docs: DataFrame, **options) -> DataFrame:
    """The documents of a known language, with all their columns."""
    found = identify_documents(docs, **options)
    return without(docs, found.where("NOT kept").select(F.col("doc_id").alias("id"), "tk"))
