"""Shared pieces of the corpus operators: row identity, shared-folder tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: A key with more than one in HEAVY of all rows is heavy, so there are fewer than HEAVY of these.
HEAVY = 1000
#: Heavy keys are split into parts of about one in PARTS of all rows.
PARTS = 4096


def fresh(name: str = "c") -> str:
    """A column name that no caller's table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, outer: bool = False) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) a folder below the warehouse is taken; a
    cluster without the setting is an error. Within :func:`scratch` the path is deleted at its end; ``outer``: at
    the end of the scope around it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(path)
    return path


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is run in the block as soon as it is done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffles behind it are no longer needed and are deleted.
    """
    path = shared_folder(df.sparkSession, outer)
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """``df`` as a table dealt into ``buckets`` by ``key``, which joins on the key read without a shuffle; dropped at the end.

    ``df`` is partitioned by ``key`` into as many partitions, so each task writes one file.
    """
    spark, name = df.sparkSession, fresh("bucketed")
    path = shared_folder(spark)
    with _shuffles_deleted(spark):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, when the block ends, what was written to the shared folder in it.

    A result that is used after the block is written with ``materialize(result, outer=True)``.
    """
    written: list[str] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in written:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, spread: Column, how: str = "inner") -> DataFrame:
    """``left`` joined on ``keys`` with ``right``, which has one row for a key and is read three times.

    ``n`` is right's number of rows of the key in ``left``. A heavy key's rows are dealt by ``spread`` over parts in
    proportion to its share, and its row of ``right`` is copied to each part. Heavy keys are fewer than ``HEAVY``,
    by their definition, so they are broadcast to mark the rows.
    """
    salt = fresh("salt")
    total = right.agg(F.sum(n)).first()[0] or 0
    parts = F.when(F.col(n) * HEAVY > total, F.ceil(F.col(n) * PARTS / F.lit(max(total, 1)))).otherwise(1).cast("int")
    heavy = right.where(F.col(n) * HEAVY > total).select(*keys, parts.alias(salt))
    dealt = left.join(F.broadcast(heavy), keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread), F.coalesce(salt, F.lit(1))).cast("int"))
    copied = right.withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copied, [*keys, salt], how).drop(salt)


def heavy_values(rows: DataFrame, name: str, support: int = HEAVY) -> DataFrame:
    """The values of the long column ``name`` that more than one row in ``support`` holds, by an exact rule; at most 2 * ``support``.

    Each task keeps the frequent items of its rows by Misra-Gries counters, whose error is at most one row in
    2 * ``support``; a value above one in ``support`` in all is above one in 2 * ``support`` after the errors, so none
    is missed. What a task sends has at most 2 * ``support`` rows.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), 0
        for batch in batches:
            n += batch.num_rows
            value, count = np.unique(batch.column(0).to_numpy(), return_counts=True)
            value, at = np.unique(np.concatenate([held[0], value]), return_inverse=True)
            count = np.bincount(at, np.concatenate([held[1], count]), len(value)).astype(np.int64)
            if len(count) > 2 * support:
                count = count - np.partition(count, len(count) - 2 * support - 1)[len(count) - 2 * support - 1]
            held = value[count > 0], count[count > 0]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(np.where(np.arange(len(held[0])) == 0, n, 0))] if len(held[0]) else [pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], ["v", "n", "rows"])

    got = rows.select(F.col(name).cast("long").alias("v")).mapInArrow(frequent, "v long, n long, rows long").groupBy("v").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    got = materialize(got)
    total = got.agg(F.sum("rows")).first()[0] or 0
    return got.where(F.col("n") * 2 * support > total).select(F.col("v").alias(name))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII texts take the faster ``lower``, which is the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def same_row(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of several key columns."""
    cond = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the undirected ``edges`` (a long, b long); component is the smallest node.

    Alternating large-star and small-star rounds; each round is a grouped minimum and one join, so a hub is
    pre-aggregated before its shuffle and never gathered into one task. Every round is written to the shared
    folder. Nodes without an edge do not appear. Rounds grow with the logarithm of the longest chain; should
    ``max_rounds`` not be enough, it fails rather than return components that are cut in two.
    """
    spark = edges.sparkSession
    with scratch(spark):
        cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        mark = None
        for _ in range(max_rounds):
            both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low2 = large.groupBy("u").agg(F.min("v").alias("m"))
            linked = large.join(low2, "u")
            small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(linked.select("u", F.col("m").alias("v")))
            cur = materialize(small.where("u <> v").distinct())
            now = cur.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1000003).cast("long")), F.countDistinct("u")).first()
            if now == mark or now[0] == 0:
                break
            if now[0] == now[2] and cur.join(cur.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
                break
            mark = now
        else:
            raise RuntimeError(f"components are not stable after {max_rounds} rounds")
        roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
        return materialize(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).distinct(), outer=True)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal ``keys`` from sorted Arrow batches, each run as one table."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                piece, key = batch.slice(start, i - start), rows[start]
                if held and key != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(piece)
                start = i
    if held:
        yield last, pa.Table.from_batches(held)


def per_group(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each group of rows, many small groups per Arrow batch.

    The rows are dealt by hash of ``keys`` and sorted, so a task streams its groups one after the other and
    holds one at a time. Callers bound the size of a group.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for key, table in runs_of(batches, keys):
            got = fn(key, table)
            if got is not None and got.num_rows:
                held.append(got.cast(out))
                n += got.num_rows
            if n >= 20_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``gone`` (id, tk); all their columns stay.

    ``gone`` is written first, so that Spark knows its size: where it is small it is broadcast and no text is shuffled.
    """
    i, t, k = fresh("id"), fresh("tk"), fresh("tk")
    gone = materialize(gone.select(F.col("id").alias(i), F.col("tk").alias(t)).distinct(), outer=True)
    keyed = docs.withColumn(k, F.xxhash64(text_col))
    return keyed.join(gone, keyed[id_col].eqNullSafe(gone[i]) & (keyed[k] == gone[t]), "left_anti").drop(k)
