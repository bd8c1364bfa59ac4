"""Mixing sources to target weights, in DataFrame functions alone.

Each source's documents, in the order (bucket, id), are one stream of words, cut into blocks of ``block`` words;
only a source's last block may be shorter. A source's target is so many draws of blocks: whole passes over its blocks
and one part of a pass. The output has as many slots as there are draws, in shards of ``shard_slots``. Each slot draws
its source by the sources' shares, so the counts of sources in a shard are a multinomial draw; ``Mix.counts`` holds
them. Running sums of these counts number the slots of each source. The few slots that a source was given above its
draws (about the square root of them) go to the sources that fell short, so that taken words equal the target
(rounded) and no word is taken more often than the passes. Slot r of a source then takes the block that a pseudorandom
permutation of the source's full blocks (one per source and pass) gives for r; the short block comes last in its pass,
and the last draw takes only as many words of its block as the target still needs. Blocks are joined by index.

Permutations are swap-or-not shuffles in integer arithmetic: stateless, over any number of blocks, the same on
every run. A source's stream positions come from sums per (source, bucket), so that a source with most of the
rows is spread over many tasks; the number of buckets is fixed, so a document's place among its like does not
depend on the size of the table. One row per source meets in one task, and so do a source's counts by shard and its
sums by bucket.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source of its own, the
last; repeated rows are separate documents; a null id comes last in its bucket's order; an empty table gives no
rows. Other columns are ignored, so clashing names cannot occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import materialize

WEIGHTS = (5, 2, 1)
PRIME = 2147483647
ROUNDS = 24
#: Parts of a source's stream whose sizes are summed before its documents are placed.
BUCKETS = 8192
#: Steps of the grid by which slots find their source.
GRID = 1024


def uniform_steps(x: str, n: str, seed: int, div: str) -> list[str]:
    """Projections, one after the other, that end in ``_u``: a pseudorandom number from 0 to n - 1 for each ``x``; plain SQL."""
    return [
        f"((({x}) % {PRIME}) * 48271 + (({x}) {div} {PRIME}) * 69621 + {seed * 7919 + 1}) % {PRIME} AS _u0",
        f"(_u0 * _u0 + _u0 * 40692 + 1299709) % {PRIME} AS _u1",
        f"(_u1 * _u1 + _u1 * 16807 + 15485863) % {PRIME} AS _u2",
        f"(_u2 * _u2 + _u2 * 69621 + 32452843) % {PRIME} AS _u3",
        f"least(({n}) - 1, CAST(floor(CAST(_u3 AS DOUBLE) * ({n}) / {PRIME}) AS BIGINT)) AS _u",
    ]


def permute(df: DataFrame, x: str, n: str, key: str, out: str, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``out``: the image of ``x`` (0 <= x < n) under the permutation of 0..n-1 that ``key`` names."""
    cols = df.columns
    df = df.selectExpr("*", f"{x} AS _x0")
    for sql in permute_steps(n, key, rounds):
        df = df.selectExpr(*cols, *sql)
    return df.selectExpr(*cols, f"_x{rounds} AS {out}")


def permute_steps(n: str, key: str, rounds: int = ROUNDS) -> list[list[str]]:
    """The columns that each projection adds to those before; plain SQL, the same for other engines."""
    steps = []
    for r in range(rounds):
        c = f"((({key}) % {PRIME} * 48271 + {(r + 1) * 1299709}) % {PRIME})"
        partner = f"((({c} * 2147483629 + {(r + 1) * 7919}) % ({n}) - _x{r} + ({n})) % ({n}))"
        steps.append([f"_x{r}", f"{partner} AS _p{r}"])
        high = f"greatest(_x{r}, _p{r})"
        steps.append([f"CASE WHEN (({high} % {PRIME}) * {69621 + 2 * r} + {c}) % {PRIME} % 2 = 1 THEN _p{r} ELSE _x{r} END AS _x{r + 1}"])
    return steps


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) gets rank, weight and target.

    Sources by code point, null last, take the weights in turn; the targets share the sum of all sizes by weight,
    none above ``most`` times its source's size. With the sources sorted by cap per weight, the capped ones come
    first, and the level of the rest follows from running sums.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("cap_per_weight", "rank")
    everything = Window.partitionBy()
    df = totals.withColumn("rank", F.row_number().over(by_name).cast("long"))
    df = df.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("cap", F.col("source_size") * most).withColumn("cap_per_weight", F.col("cap").cast("double") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.sum("cap").over(by_cap) + F.col("cap")).cast("double") / (F.sum("weight").over(everything) - F.sum("weight").over(by_cap) + F.col("weight"))
    df = df.withColumn("level", level).withColumn("capped", F.col("level") > F.col("cap_per_weight"))
    final = F.coalesce(F.max(F.when(~F.col("capped"), F.col("level"))).over(everything), F.lit(0.0))
    return df.select("source", "source_size", "rank", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(final * F.col("weight")).alias("target"))


@dataclass
class Mix:
    """``documents``: one row per document with its place in its source's stream; ``sources``: one per source;
    ``counts``: the multinomial draw (shard, rank, n); ``draws``: one per output slot (slot, shard, rank, epoch, block, words)."""

    documents: DataFrame
    sources: DataFrame
    counts: DataFrame
    draws: DataFrame
    block: int

    def taken(self) -> DataFrame:
        """One row per document: size, source_size, target, taken and the number of output shards it is in."""
        b = self.block
        rows = self.documents.select("doc_id", "source", "rank", "bucket", "pos", "size", "start", "source_size", "target", (F.col("start") + F.col("size")).alias("end"))
        first, last = F.expr(f"start div {b}"), F.expr(f"(end - 1) div {b}")
        spread = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        met = spread.join(self.draws.select("rank", "block", "words", "shard"), ["rank", "block"], "left")
        overlap = F.greatest(F.lit(0), F.least("end", F.col("block") * b + F.col("words")) - F.greatest("start", F.col("block") * b))
        keys = ["doc_id", "source", "rank", "bucket", "pos", "size", "source_size", "target"]
        got = met.withColumn("overlap", F.when(F.col("words").isNotNull(), overlap).otherwise(F.lit(0))).groupBy(*keys).agg(F.sum("overlap").alias("taken"), F.collect_set(F.when(F.col("overlap") > 0, F.col("shard"))).alias("s"))
        return got.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("s").cast("long").alias("n_shards"))


def _numbered(spark: SparkSession, sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the counts of each shard, one row (slot, shard, rank, r) per slot: draw r of the source of that rank)."""
    total = int(sources.agg(F.sum("n_draws")).first()[0] or 0)
    slots = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // 4_000_000)).selectExpr("id AS slot", f"id div {shard_slots} AS shard")
    for step in uniform_steps("slot", f"{total}L", seed, "div"):
        slots = slots.selectExpr("*", step)
    slots = slots.selectExpr("slot", "shard", "_u", f"_u * {GRID} div {max(total, 1)} AS cell")
    spans = sources.where("n_draws > 0").selectExpr("rank", "first_draw AS lo", "first_draw + n_draws AS hi")
    spans = spans.selectExpr("*", f"explode(sequence(lo * {GRID} div {max(total, 1)}, (hi - 1) * {GRID} div {max(total, 1)})) AS cell")
    drawn = materialize(slots.join(materialize(spans), "cell").where("lo <= _u AND _u < hi").select("slot", "shard", "rank"))
    counts = materialize(drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("rank").orderBy("shard")) - F.col("n")).drop("n")
    at = F.row_number().over(Window.partitionBy("shard", "rank").orderBy("slot")) - 1  # at most shard_slots rows
    given = counts.groupBy("rank").agg(F.sum("n").alias("given"))
    balance = sources.select("rank", "n_draws").join(given, "rank", "left").selectExpr("rank", "n_draws", "coalesce(given, 0L) AS given")
    running = Window.orderBy("rank")
    balance = balance.selectExpr("*", "greatest(given - n_draws, 0L) AS above", "greatest(n_draws - given, 0L) AS short")
    balance = materialize(balance.withColumn("above_from", F.sum("above").over(running) - F.col("above")).withColumn("short_from", F.sum("short").over(running) - F.col("short")).coalesce(1))
    placed = drawn.withColumn("at", at).join(before, ["shard", "rank"]).join(balance, "rank").selectExpr("slot", "shard", "rank", "CAST(before + at AS BIGINT) AS r", "n_draws", "above_from")
    placed = materialize(placed)
    open_draws = balance.where("short > 0").selectExpr("rank", "given", "short_from", "explode(sequence(0L, short - 1)) AS k").selectExpr("short_from + k AS j", "rank", "given + k AS r")
    moved = placed.where("r >= n_draws").selectExpr("slot", "shard", "above_from + r - n_draws AS j").join(open_draws, "j").select("slot", "shard", "rank", "r")
    return counts, placed.where("r < n_draws").select("slot", "shard", "rank", "r").unionAll(moved)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 1024, shard_slots: int = 1024, seed: int = 1) -> Mix:
    """Plan the mix of ``docs``; see the module's text."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("tk"), word_count(F.col(text_col)).alias("size"))
    number = F.col("doc_id").cast("long") if dict(sized.dtypes)["doc_id"] != "string" else F.xxhash64("doc_id")
    sized = materialize(sized.withColumn("bucket", F.pmod(F.coalesce(number, F.lit(0)), F.lit(BUCKETS))))
    per_bucket = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    sources = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    sources = sources.withColumn("aim", F.floor(F.col("target") + 0.5)).withColumn("n_full", F.expr(f"source_size div {block}"))
    sources = sources.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("aim div greatest(source_size, 1)")).otherwise(F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.col("aim") - F.col("epochs") * F.col("source_size")).withColumn("n_draws", F.col("epochs") * F.col("n_blocks") + F.expr(f"(rest + {block - 1}) div {block}"))
    sources = materialize(sources.withColumn("first_draw", F.sum("n_draws").over(Window.orderBy("rank")) - F.col("n_draws")).coalesce(1))
    # The place of each document in its source's stream: sums before its bucket, then within.
    in_source = Window.partitionBy("rank").orderBy("bucket")
    offsets = per_bucket.join(sources.select("source", "source_size", "rank", "target"), per_bucket["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    offsets = materialize(offsets.withColumn("before", F.sum("bucket_size").over(in_source) - F.col("bucket_size")).drop("bucket_size"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "tk", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("within", F.sum("size").over(in_bucket) - F.col("size")).withColumn("pos", F.row_number().over(in_bucket))
    documents = placed.join(offsets, placed["source"].eqNullSafe(offsets["source"]) & (placed["bucket"] == offsets["bucket"])).select(
        "doc_id", placed["source"], "rank", placed["bucket"], "pos", "size", (F.col("before") + F.col("within")).alias("start"), "source_size", "target"
    )
    counts, draws = _numbered(spark, sources, shard_slots, seed)
    draws = draws.join(sources.select("rank", "n_full", "n_blocks", "epochs", "rest"), "rank")
    draws = draws.selectExpr("slot", "shard", "rank", "n_full", "epochs", "rest", "r div n_blocks AS epoch", "r % n_blocks AS i")
    draws = draws.selectExpr("*", "least(i, greatest(n_full - 1, 0L)) AS spot", "greatest(n_full, 1L) AS n_perm", f"rank * 7919 + epoch * 104729 + {seed} AS key1")
    draws = permute(draws, "spot", "n_perm", "key1", "image")
    draws = draws.selectExpr("slot", "shard", "rank", "epoch", "CASE WHEN i < n_full THEN image ELSE n_full END AS block", f"CASE WHEN epoch < epochs THEN {block}L ELSE least({block}L, rest - i * {block}) END AS words")
    # Written once: a filter that a join infers on the block must not be pushed through the permutation's steps.
    return Mix(documents, sources, counts, materialize(draws), block)


def digest(m: Mix) -> DataFrame:
    return m.taken().select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def oracle_sql(block: int = 1024, shard_slots: int = 1024, seed: int = 1) -> str:
    """The same rows in plain SQL (one id per document)."""
    image = "SELECT *, CAST(spot AS BIGINT) AS _x0 FROM (SELECT * FROM dr)"
    for cols in permute_steps("n_perm", "key1"):
        image = f"SELECT slot, shard, rank, n_full, epochs, rest, epoch, i, n_perm, key1, {', '.join(cols)} FROM ({image})"
    drawn = "SELECT slot, slot // {0} AS shard, total FROM (SELECT unnest(range(total)) AS slot, total FROM (SELECT CAST(sum(n_draws) AS BIGINT) AS total FROM s))".format(shard_slots)
    for step in uniform_steps("slot", "total", seed, "//"):
        drawn = f"SELECT *, {step} FROM ({drawn})"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, ((doc_id % {BUCKETS}) + {BUCKETS}) % {BUCKETS} AS bucket FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM t),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap FROM r),
c AS (SELECT *, CAST(cap AS DOUBLE) / weight AS cpw FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - sum(cap) OVER (ORDER BY cpw, rank) + cap AS DOUBLE) / CAST(sum(weight) OVER () - sum(weight) OVER (ORDER BY cpw, rank) + weight AS DOUBLE) AS level FROM c),
g AS (SELECT source, source_size, rank, CASE WHEN level > cpw THEN CAST(cap AS DOUBLE) ELSE coalesce(max(CASE WHEN NOT level > cpw THEN level END) OVER (), 0.0) * weight END AS target FROM l),
a AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS aim, source_size // {block} AS n_full, (source_size + {block - 1}) // {block} AS n_blocks FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN aim // greatest(source_size, 1) ELSE 0 END AS epochs FROM a),
q AS (SELECT *, aim - epochs * source_size AS rest, epochs * n_blocks + (aim - epochs * source_size + {block - 1}) // {block} AS n_draws FROM e),
s AS (SELECT *, CAST(sum(n_draws) OVER (ORDER BY rank) - n_draws AS BIGINT) AS first_draw FROM q),
u AS ({drawn}),
x AS (SELECT slot, shard, rank, n_draws, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS r FROM u JOIN s ON first_draw <= _u AND _u < first_draw + n_draws),
v AS (SELECT s.rank, n_draws, coalesce(n, 0) AS given FROM s LEFT JOIN (SELECT rank, count(*) AS n FROM x GROUP BY rank) y ON y.rank = s.rank),
y AS (SELECT *, sum(greatest(given - n_draws, 0)) OVER (ORDER BY rank) - greatest(given - n_draws, 0) AS above_from, sum(greatest(n_draws - given, 0)) OVER (ORDER BY rank) - greatest(n_draws - given, 0) AS short_from FROM v),
o AS (SELECT short_from + k AS j, rank, given + k AS r FROM (SELECT *, unnest(range(n_draws - given)) AS k FROM y WHERE n_draws > given)),
n AS (SELECT slot, shard, rank, r FROM x WHERE r < n_draws UNION ALL SELECT slot, shard, o.rank, o.r FROM (SELECT slot, shard, above_from + r - x.n_draws AS j FROM x JOIN y ON y.rank = x.rank WHERE r >= x.n_draws) m JOIN o ON o.j = m.j),
dr AS (SELECT slot, shard, n.rank, n_full, epochs, rest, r // n_blocks AS epoch, r % n_blocks AS i, least(r % n_blocks, greatest(n_full - 1, 0)) AS spot, greatest(n_full, 1) AS n_perm, n.rank * 7919 + (r // n_blocks) * 104729 + {seed} AS key1 FROM n JOIN s ON s.rank = n.rank),
im AS (SELECT *, _x{ROUNDS} AS image FROM ({image})),
draws AS (SELECT rank, CASE WHEN i < n_full THEN image ELSE n_full END AS block, CASE WHEN epoch < epochs THEN {block} ELSE least({block}, rest - i * {block}) END AS words, shard FROM im),
p AS (SELECT d.*, s.rank, s.source_size, s.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY bucket, doc_id) - size AS BIGINT) AS st FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, unnest(range(st // {block}, (st + size - 1) // {block} + 1)) AS block FROM p WHERE size > 0),
h AS (SELECT doc_id, shard, greatest(0, least(st + size, b.block * {block} + words) - greatest(st, b.block * {block})) AS overlap FROM b JOIN draws USING (rank, block)),
z AS (SELECT doc_id, sum(overlap) AS taken, count(DISTINCT shard) FILTER (WHERE overlap > 0) AS n_shards FROM h GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(n_shards, 0) AS BIGINT) AS n_shards FROM p LEFT JOIN z ON p.doc_id = z.doc_id
"""
