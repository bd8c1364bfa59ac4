"""Product-quantised codes of embeddings by Lloyd rounds that are maintained by differences.

Vectors of integers (see :func:`integers.integer_vectors`) are cut into equal parts, each part position with a
codebook of its own. The state of a round is a table in the shared folder: each vector with the codes it had and the
codes it has now. The driver holds, for each codebook entry, the number of its parts and their sums, all exact
integers. A round (1) writes the next state by assigning each part to the nearest entry of the current codebooks,
(2) reads from it only the vectors with a changed code and shuffles for each of their changed parts a minus to the
entry it left and a plus to the one it joined, added up within the task (at most one row per entry and component from
a task), and (3) adds these to the running sums, from which the next codebooks follow. The first round has no earlier
codes, so everything is a plus. Codebooks are of fixed size, so they travel with the tasks. A state is deleted when
the next one is written.

Distances are exact: in doubles where every product and sum fits 53 bits, else in longs or integers of any size.

Defined results: rows with a null vector, an entry that is null or not finite, or one too large for an exact integer
are dropped, and so are vectors of another length than the most frequent one; a length that the parts do not divide
is filled up with zeros, which change no distance; first entries are the vectors of the smallest ids, null ids last
and repeated ids by their vector, so with fewer vectors than entries the codebooks are as small; of equally near
entries the lower wins; entries that no part is nearest to stay as they are; null labels are one label; ids may be
null or repeat, each row is a vector of its own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import delete, join_counted, materialize, scratch, shared_folder
from barspark.llm.integers import integer_vectors, matrix

_BLOCK = 4096


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries`` for each row of ``x``, exact; the lower index on ties."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * largest * largest * max(x.shape[1], 1)
    if bound < 1 << 53:
        a, c = x.astype(np.float64), entries.astype(np.float64)
        # |a|^2 is the same for all entries: it is added to the smallest alone.
        part = (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)
        at = part.argmin(axis=1)
        return at, (part[np.arange(len(a)), at] + (a * a).sum(axis=1)).astype(np.int64)
    kind = np.int64 if bound < 1 << 63 else object
    a, c = x.astype(kind), entries.astype(kind)
    part = (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)
    at = np.array(part.argmin(axis=1), dtype=np.int64)
    return at, part[np.arange(len(a)), at] + (a * a).sum(axis=1)


@dataclass
class Codebooks:
    """``entries`` and the running ``sums`` are (part, entry, component), ``counts`` (part, entry); integers of any size."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray, parts: int) -> Codebooks:
        """``first``: the vectors whose parts are the first entries."""
        cut = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
        return cls(cut.copy(), np.zeros(cut.shape, dtype=object), np.zeros(cut.shape[:2], dtype=object))

    def apply(self, changes: Iterable[tuple[int, int, int, int]]) -> None:
        """Adds (part, entry, component, value), component -1 being the count; then moves the entries that have parts."""
        for part, entry, component, value in changes:
            if component < 0:
                self.counts[part, entry] += value
            else:
                self.sums[part, entry, component] += value
        for part, entry in zip(*np.nonzero(self.counts), strict=True):
            self.entries[part, entry] = [int(s) // int(self.counts[part, entry]) for s in self.sums[part, entry]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _assigned(state: DataFrame, entries: np.ndarray, d: int, last: bool) -> DataFrame:
    """The next state: ``was`` is the code so far, ``code`` the new one, ``error`` the squared distance."""
    parts = entries.shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                piece = batch.slice(at, _BLOCK)
                x = matrix(piece.column("x"), d).reshape(piece.num_rows, parts, -1)
                found = [nearest(x[:, p], entries[p]) for p in range(parts)]
                code = np.stack([f[0] for f in found], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts), pa.int32()), pa.array(code.ravel()))
                if last:
                    error = [Decimal(int(e)) for e in sum(f[1].astype(object) for f in found)]
                    yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), lists, pa.array(error, pa.decimal128(38, 0))], ["id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), piece.column("x"), piece.column("code"), lists], ["id", "label", "x", "was", "code"])

    kinds = dict(state.dtypes)
    kept = f"id {kinds['id']}, label {kinds['label']}, "
    return state.mapInArrow(run, kept + ("code array<int>, error decimal(38,0)" if last else "x array<long>, was array<int>, code array<int>"))


def changes(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, component, value): what the changed parts of ``state`` add to the entries they joined and take from those they left."""
    parts, size, width = shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, held = np.zeros((parts * size, width), dtype=np.int64), np.zeros(parts * size, dtype=np.int64), 0

        def out() -> Iterator[pa.RecordBatch]:
            for values, component in ((counts[:, None], np.array([-1])), (sums, np.arange(width))):
                at, c = np.nonzero(values)
                if len(at):
                    columns = [at // size, at % size, component[c]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in columns], pa.array(values[at, c])], ["part", "entry", "component", "value"])

        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                piece = batch.slice(at, _BLOCK)
                x = matrix(piece.column("x"), parts * width).reshape(piece.num_rows, parts, width)
                held += int(np.abs(x).max(initial=0)) * len(x)
                if held >= 1 << 62:  # else the sums might leave the longs
                    yield from out()
                    sums[:], counts[:], held = 0, 0, int(np.abs(x).max(initial=0)) * len(x)
                code = matrix(piece.column("code"), parts)
                old = piece.column("was")
                was = np.full_like(code, -1)
                was[np.flatnonzero(np.asarray(old.is_valid()))] = old.drop_null().flatten().to_numpy().reshape(-1, parts)
                row, part = np.nonzero(code != was)
                for entry, sign in ((code, 1), (was, -1)):
                    there = entry[row, part] >= 0
                    key = part[there] * size + entry[row[there], part[there]]
                    np.add.at(sums, key, sign * x[row[there], part[there]])
                    counts += sign * np.bincount(key, minlength=len(counts))
        yield from out()

    moved = state.where("was IS NULL OR was <> code").select("x", "was", "code").mapInArrow(run, "part int, entry int, component int, value long")
    return moved.groupBy("part", "entry", "component").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row per kept row: id, label, code (array of ``parts`` indexes), error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    with scratch(spark):
        rows, d = integer_vectors(vectors, {"id": id_col, "label": label_col}, vector_col, scale)
        kinds = dict(rows.dtypes)
        result = f"{id_col} {kinds['id']}, {label_col} {kinds['label']}, code array<int>, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string"
        if not d:
            return spark.createDataFrame([], result)
        fill = -d % parts
        if fill:
            rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), fill)))
        first = rows.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
        books = Codebooks.of(np.array([r["x"] for r in first], dtype=np.int64), parts)
        state, place = rows.withColumn("code", F.lit(None).cast("array<int>")), None
        for _ in range(rounds):
            path = shared_folder(spark)
            following = _assigned(state, books.entries, d + fill, last=False)
            following.write.parquet(path)
            if place:
                delete(spark, place)
            state, place = spark.read.schema(following.schema).parquet(path), path
            got = changes(state, books.entries.shape).collect()
            books.apply((r["part"], r["entry"], r["component"], int(r["value"])) for r in got)
        coded = materialize(_assigned(state, books.entries, d + fill, last=True))
        if place:
            delete(spark, place)
        # A null label is a label: the two columns tell it from every other.
        named = coded.withColumns({"no_label": F.col("label").isNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))})
        sums = named.groupBy("no_label", "name").agg(F.sum("error").cast("decimal(38,0)").alias("label_error"), F.count("*").alias("n"))
        joined = join_counted(named, materialize(sums), ["no_label", "name"], "n", F.col("id"))
        out = joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
        return materialize(out, outer=True)


def digest(coded: DataFrame) -> DataFrame:
    """The columns of the registered query: the code as two hex digits a part, errors as longs (null where no long can hold one)."""
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    whole = [F.expr(f"try_cast({c} AS long)").alias(c) for c in ("error", "label_error")]
    return coded.select("vec_id", code.alias("code"), *whole, "codebooks_sha256")


def oracle_sql(rounds: int = 4) -> str:
    """The digest in SQL, for tables whose entries are small enough for exact products in doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM ("
            f"SELECT v.vec_id, v.p, b.e, CAST(v.s + b.s - 2 * list_inner_product(v.x, b.x) AS BIGINT) AS dist FROM v JOIN b{r} b USING (p)) GROUP BY 1, 2)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT p, e, list(CAST(floor(y) AS DOUBLE) ORDER BY i) AS x FROM ("
                f"SELECT p, e, i, sum(c) // count(*) - CASE WHEN sum(c) % count(*) < 0 THEN 1 ELSE 0 END AS y FROM ("
                f"SELECT v.p, a.e, unnest(range(len(v.x))) AS i, CAST(unnest(v.x) AS BIGINT) AS c FROM v JOIN a{r} a USING (vec_id, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2), "
                f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x, list_inner_product(coalesce(m.x, b.x), coalesce(m.x, b.x)) AS s FROM b{r} b LEFT JOIN m{r} m USING (p, e))"
            )
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x, list_inner_product(x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4], x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4]) AS s
      FROM (SELECT vec_id, x, unnest(range(4)) AS p FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 256),
b0 AS MATERIALIZED (SELECT p, e, x, s FROM v JOIN f USING (vec_id)),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ',') AS t FROM b{rounds})),
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM r JOIN k USING (vec_id), h
"""
