"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group is all rows of one text; it goes to one shard whole. Differencing keeps partial partitions: each holds one
subset for each shard. The two with the largest spread (largest minus smallest subset) are combined, the largest
subset of one with the smallest of the other, until one is left; its subsets are the shards.

Differencing is sequential, so it runs over at most ``2 * BINS`` items, whatever the size of the table: a group of
more than one in ``BINS`` of all bytes is an item of its own (there are fewer than ``BINS`` of these, by definition),
and all smaller groups fall into ``BINS`` lumps by the hash of their text. A lump holds about one in ``BINS`` of the
bytes, and combining the most uneven ones first leaves a spread far below one lump. A group above a shard's fair
share gets a shard with little else. Group sizes come from one pre-aggregated shuffle of hashes; the items (a few
thousand sums) go to the driver; their shards are broadcast back, so a row learns its shard without a shuffle.

Slots number the rows of a shard from 0 in the order (bucket, id, text hash): counts by (shard, bucket) give the
offsets, rows are numbered within their bucket. Rows that repeat each other are counted first and dealt out in
pieces afterwards, so that neither a hot text nor a hot row meets in one task.

Defined results: a null text has no bytes, the CRC of no bytes, and is in one group with the empty text; a null id
is a value like any other; repeated rows are rows of their own in one shard with slots of their own, and ties fall
by hash; an empty table gives no rows. Other columns are ignored by :func:`assign_shards` and kept by
:func:`with_shard`, where they may have any name but ``shard``. Equal texts are told by 128 bits of hash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import fresh, materialize, scratch

#: Lumps of small groups, and the bytes' share above which a group is an item of its own.
BINS = 4096
#: Rows of a shard are numbered within so many buckets.
BUCKETS = 4096
#: Rows that repeat each other are dealt out in pieces of so many.
PIECE = 1000


def difference(sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each item by differencing; ties fall to the earlier item."""
    if not sizes:
        return []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    # A partial partition: subset sums in falling order, and which subset of which two parts each was made of.
    sums: list[np.ndarray | None] = []
    made: list[tuple[int, int, np.ndarray, np.ndarray] | None] = []
    heap: list[tuple[int, int]] = []
    for i in order:
        sums.append(np.array([sizes[i]] + [0] * (n_shards - 1), dtype=np.int64))
        made.append(None)
        heap.append((-sizes[i], len(heap)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        falling = np.argsort(-joined, kind="stable")
        sums.append(joined[falling])
        made.append((a, b, falling, n_shards - 1 - falling))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    shard = [0] * len(sizes)
    todo = [(heap[0][1], np.arange(n_shards))]  # subset s of the node is in shard names[s]
    while todo:
        node, names = todo.pop()
        if made[node] is None:
            shard[order[node]] = int(names[0])
            continue
        a, b, from_a, from_b = made[node]
        in_a, in_b = np.empty_like(names), np.empty_like(names)
        in_a[from_a], in_b[from_b] = names, names
        todo += [(a, in_a), (b, in_b)]
    return shard


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _text_keys(text: Column) -> tuple[Column, Column]:
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(1), whole)


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _items(rows: DataFrame, n_shards: int, bins: int) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, shard) of the large groups and (lump, shard) of the lumps, each of at most ``bins`` rows; rows: h1, h2, size."""
    spark = rows.sparkSession
    if not 1 <= n_shards <= bins // 8:
        raise ValueError(f"1 to {bins // 8} shards, not {n_shards}")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") > F.lit(total / bins)
    lump = F.when(large, -1).otherwise(F.pmod("h1", F.lit(bins))).cast("int")
    items = groups.select(lump.alias("lump"), F.when(large, F.col("h1")).alias("h1"), F.when(large, F.col("h2")).alias("h2"), "bytes")
    found = items.groupBy("lump", "h1", "h2").agg(F.sum("bytes").alias("bytes")).collect()
    found.sort(key=lambda r: (r["lump"], r["h1"] or 0, r["h2"] or 0))
    shards = difference([r["bytes"] for r in found], n_shards)
    own = [(r["h1"], r["h2"], s) for r, s in zip(found, shards, strict=True) if r["lump"] < 0]
    lumped = [(r["lump"], s) for r, s in zip(found, shards, strict=True) if r["lump"] >= 0]
    column = lambda values, i, kind: pa.array([v[i] for v in values], kind)
    own_table = pa.table({"h1": column(own, 0, pa.int64()), "h2": column(own, 1, pa.int64()), "own_shard": column(own, 2, pa.int32())})
    lump_table = pa.table({"lump": column(lumped, 0, pa.int32()), "lump_shard": column(lumped, 1, pa.int32())})
    return spark.createDataFrame(own_table), spark.createDataFrame(lump_table)


def _placed(rows: DataFrame, own: DataFrame, lumps: DataFrame, h1: str, h2: str, bins: int) -> DataFrame:
    """``rows`` with own_shard and lump_shard, one of which is not null. Both tables have at most ``bins`` rows, so they are broadcast."""
    a, b, lump = fresh("h1"), fresh("h2"), fresh("lump")
    own = own.withColumnsRenamed({"h1": a, "h2": b})
    lumps = lumps.withColumnRenamed("lump", lump)
    placed = rows.join(F.broadcast(own), (rows[h1] == own[a]) & (rows[h2] == own[b]), "left").drop(a, b)
    return placed.join(F.broadcast(lumps), F.pmod(placed[h1], F.lit(bins)).cast("int") == lumps[lump], "left").drop(lump)


def with_shard(docs: DataFrame, n_shards: int, *, text_col: str = "text", bins: int = BINS) -> DataFrame:
    """``docs`` with all its columns and ``shard`` (0 to n_shards - 1), ready for ``write.partitionBy("shard")``."""
    h1, h2 = fresh("h1"), fresh("h2")
    first, second = _text_keys(F.col(text_col))
    keyed = docs.withColumns({h1: first, h2: second})
    rows = docs.select(first.alias("h1"), second.alias("h2"), _size(F.col(text_col)).alias("size"))
    own, lumps = (t.withColumnRenamed(n, f"_{n}_") for t, n in zip(_items(rows, n_shards, bins), ("own_shard", "lump_shard"), strict=True))
    placed = _placed(keyed, own, lumps, h1, h2, bins)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("_own_shard_", "_lump_shard_").alias("shard"))


def assign_shards(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot."""
    with scratch(docs.sparkSession):
        first, second = _text_keys(F.col(text_col))
        narrow = docs.select(F.col(id_col).alias("id"), _size(F.col(text_col)).alias("size"), F.crc32(_bytes(F.col(text_col))).alias("text_crc32"), first.alias("h1"), second.alias("h2"))
        rows = materialize(narrow)
        own, lumps = _items(rows, n_shards, bins)
        placed = _placed(rows, own, lumps, "h1", "h2", bins).select("id", "size", "text_crc32", "h1", "h2", F.coalesce("own_shard", "lump_shard").alias("shard"))
        placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "h1", "h2"), F.lit(BUCKETS)).cast("int"))
        # Rows that repeat each other count as one row with a number until they have their slots.
        counted = materialize(placed.groupBy("shard", "bucket", "id", "h1", "h2", "size", "text_crc32").agg(F.count("*").alias("n")))
        inside = Window.partitionBy("shard", "bucket").orderBy("id", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        held = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))
        offsets = held.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
        numbered = counted.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
        numbered = materialize(numbered.select("id", "size", "text_crc32", "shard", "h1", (F.col("at") + F.col("offset")).alias("slot"), "n"))
        few = numbered.where(F.col("n") <= PIECE)
        # The pieces of a row that repeats often are dealt over the tasks before they become rows.
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("from")
        pieces = numbered.where(F.col("n") > PIECE).select("id", "size", "text_crc32", "shard", "h1", "slot", "n", piece).repartition("h1", "from")
        many = pieces.select("id", "size", "text_crc32", "shard", (F.col("slot") + F.col("from")).alias("slot"), F.least(F.lit(PIECE), F.col("n") - F.col("from")).alias("n"))
        rows = few.select("id", "size", "text_crc32", "shard", "slot", "n").unionAll(many)
        nth = rows.select("id", "size", "text_crc32", "shard", "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
        return materialize(nth.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot") + F.col("nth")).alias("slot")), outer=True)


def digest(sharded: DataFrame) -> DataFrame:
    """The columns of the registered query: this operator follows the law ``bytes``, under which no shard grows."""
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
