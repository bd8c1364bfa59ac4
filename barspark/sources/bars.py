"""Bar frames: schema, builders from tick tables, readers, writers and the read-through cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barspark.session import stages

BAR_SCHEMA = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume bigint, trade_count bigint, vwap double"


def build_bars(ticks: DataFrame, symbol: Column, bar_time: Column, price: Column, order: list[Column], volume: Column | None = None, vwap: Column | None = None) -> DataFrame:
    """One bar per (symbol, time): a single hash aggregation. ``order`` breaks ties for open and close."""
    rows = ticks.select(symbol.alias("symbol"), bar_time.cast("timestamp_ntz").alias("timestamp"), price.alias("p"), F.struct(*order).alias("o"), (F.lit(1) if volume is None else volume).alias("v"), (price if vwap is None else vwap).alias("w"))
    mean = F.avg("w") if vwap is None else F.sum("w").cast("double") / F.sum("v")
    return rows.groupBy("symbol", "timestamp").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.sum("v").cast("bigint").alias("volume"), F.count("*").alias("trade_count"), mean.alias("vwap"),
    )


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return build_bars(e, F.col("event_type"), F.date_trunc(unit, "ts"), F.col("value"), [F.col("ts"), F.col("event_id")])


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return build_bars(t, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), order, F.col("l_quantity"), F.col("l_extendedprice").cast("decimal(18,2)"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return build_bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), [F.col("o_orderkey")])


def read_csv(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> DataFrame:
    """Bars from CSV with a declared schema; times without a zone are UTC in a UTC session."""
    return spark.read.schema(schema).csv(path, header=True)


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by symbol, so that a symbol's filter prunes directories."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.mode("overwrite").partitionBy("symbol").parquet(path)


def write_csv(frame: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header below ``path``: as many files as the frame has partitions, or ``files``."""
    (frame if files is None else frame.coalesce(files)).write.mode(mode).csv(path, header=True)


def validated_pair(spark: SparkSession, raw: str, cleaned: str, clean: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], None], schema: str = BAR_SCHEMA) -> DataFrame:
    """The clean bars of a raw CSV: those at ``cleaned``, checked again, or the raw ones cleaned, checked, kept and checked as read.

    ``check`` raises where bars are not fit (``validate.assert_clean`` with its options).
    """
    if _exists(spark, cleaned):
        found = read_csv(spark, cleaned, schema)
        check(found)
        return found
    ready = clean(read_csv(spark, raw, schema))
    check(ready)
    write_csv(ready, cleaned)
    found = read_csv(spark, cleaned, schema)
    check(found)
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a reader finds anything at ``path``; other errors than a missing path are raised."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def cache_path(root: str, prefix: str, start: str, end: str) -> str:
    """Where the clean bars of a range are kept; symbols are partitions below it."""
    return f"{root.rstrip('/')}/{prefix}_{start}_{end}_clean"


def read_through(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cached bars at ``path``; where there are none, ``clean(fetch())`` is written there first."""
    if not _exists(spark, path):
        write_bars(clean(fetch()), path)
    return spark.read.parquet(path)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """MERGE: rows of ``source`` replace those of ``target`` with the same keys; others are inserted or stay.

    Keys are unique in ``source``; :func:`merge_into` checks that and touches only what changes.
    """
    values = [c for c in target.columns if c not in keys]
    t, s = target.withColumn("_t", F.lit(True)), source.withColumn("_s", F.lit(True)).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], "_s")
    joined = t.join(s, keys, "full_outer")
    return joined.select(*keys, *[F.when(F.col("_s"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def merge_into(path: str, source: DataFrame, keys: Sequence[str], by: Sequence[str]) -> list[Row]:
    """MERGE into the Parquet table at ``path``, partitioned by the columns ``by``, which are among ``keys``; the partitions that were rewritten.

    Only the partitions that ``source`` has rows for are read, joined and rewritten; the files of all others stay as
    they are. The new partitions are written to the shared folder first and then put in place by one dynamic partition
    overwrite, so a run that fails before that leaves the table as it was. A key that ``source`` repeats is a
    ValueError, as is one with a null partition value. A table that is not there yet is created. ``source`` is written
    once, so it may stand on the table itself.
    """
    keys, by = list(keys), list(by)
    if not by or not set(by) <= set(keys):
        raise ValueError("a table is partitioned by some of its keys")
    spark = source.sparkSession
    with stages(spark) as keep, stages(spark) as keep_new:
        new = keep(source)
        nothing = " OR ".join(f"`{c}` IS NULL" for c in by)
        if not new.where(nothing).isEmpty():
            raise ValueError("a key has no partition")
        if not new.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("the source repeats a key")
        # A row per partition: folders of the table, which the driver lists anyway.
        touched = new.select(*by).distinct().collect()
        if not touched:
            return []
        merged = new
        if _exists(spark, path):
            old = spark.read.parquet(path)
            few = spark.createDataFrame(touched, new.select(*by).schema)
            merged = merge_upsert(old.join(F.broadcast(few), by, "left_semi").select(*old.columns), new.select(*old.columns), keys).select(*old.columns)
        staged = keep_new(merged)
        staged.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return touched
