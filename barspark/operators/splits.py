"""Chronological splits, balancing and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.selection import with_smallest
from barspark.operators.windows import running_sum


def ordinal(frame: DataFrame, order: list[str], name: str = "ordinal", block: Column | None = None) -> DataFrame:
    """A global 0-based row number without a single-task window, by blocks that grow with the order (days of its first column)."""
    numbered = running_sum(frame, name, F.lit(1), order, F.to_date(order[0]) if block is None else block)
    return numbered.withColumn(name, F.col(name) - 1)


def chrono_split(frame: DataFrame, val: float, test: float, order: tuple[str, ...] = ("timestamp", "symbol")) -> DataFrame:
    """Adds split: the last int(n * test) rows are test, the int(n * val) before them val, the rest train.

    ValueError if one would be empty (``val`` of 0 gives a two-way split, and then ``test`` may be empty).
    """
    n = frame.count()
    n_test, n_val = int(n * test), int(n * val)
    n_train = n - n_test - n_val
    if val and min(n_test, n_val, n_train) < 1:
        raise ValueError(f"a split would be empty: {n_train}, {n_val}, {n_test}")
    i = F.col("_ordinal")
    return ordinal(frame, list(order), "_ordinal").withColumn("split", F.when(i < n_train, "train").when(i < n_train + n_val, "val").otherwise("test")).drop("_ordinal")


def split_stats(frame: DataFrame, target: str) -> DataFrame:
    """Per split: rows, positives, percent, first and last time, years of 365.25 days."""
    span = (F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 1e6 / 86400 / 365.25
    return frame.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(F.col(target) == 1).alias("n_positive"), (100.0 * F.count_if(F.col(target) == 1) / F.count("*")).alias("pct_positive"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), span.alias("years"))


def downsample(frame: DataFrame, label: str, keys: list[str], seed: int = 42, only_negatives: bool = False, lone: bool = True) -> DataFrame:
    """As many rows of the larger class as the smaller has, picked by a hash of the keys and the seed.

    A threshold on the hash is found digit by digit, so that no class is sorted in one task; only the few rows on the
    border are ranked. ``only_negatives``: positives are never dropped. Where one class has no row
    nothing changes; without ``lone`` the other is cut to no row, too.
    """
    counts = {r[0]: r[1] for r in frame.groupBy(label).count().collect()}
    neg, pos = counts.get(0, 0), counts.get(1, 0)
    big, keep = (0, pos) if neg > pos else (1, neg)
    if (lone and not min(neg, pos)) or neg == pos or (only_negatives and big == 1):
        return frame
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    # Rows without a label were never picked from: they stay out, as rows of neither class.
    return with_smallest(frame, digest, keep, F.col(label) == big, keys).where((F.col(label) != big) | F.col("_in")).drop("_in")


def zscore_splits(frame: DataFrame, features: list[str]) -> DataFrame:
    """Features minus the train split's mean over its population std (1 where that is 0): one aggregation."""
    stats = frame.where("split = 'train'").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    joined = frame.join(F.broadcast(stats))
    return joined.select(*[((F.col(f) - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}"))).alias(f) if f in features else F.col(f) for f in frame.columns])


def class_ratio(frame: DataFrame, label: str) -> DataFrame:
    """n_neg, n_pos and their ratio, 1.0 without positives."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return frame.agg(neg.alias("n_neg"), pos.alias("n_pos"), F.coalesce(F.try_divide(neg, pos), F.lit(1.0)).alias("ratio"))


def balanced_weights(frame: DataFrame, label: str, name: str = "weight", classes: int | None = None) -> DataFrame:
    """Adds n / (classes * n of the row's class); rows without a label stay, without a weight, and do not count.

    ``classes`` is their number, also where one of them has no row; those with rows, if it is not given.
    """
    counts = frame.where(F.col(label).isNotNull()).groupBy(label).count()
    whole = counts.agg(F.sum("count").alias("_n"), (F.count("*") if classes is None else F.lit(classes)).alias("_k"))
    weights = counts.join(F.broadcast(whole)).select(label, (F.col("_n") / (F.col("_k") * F.col("count"))).alias(name))
    return frame.join(F.broadcast(weights), label, "left").select(*frame.columns, name)  # one row per class


def positive_weights(frame: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds n0 / n1 (1.0 without positives) for rows of class 1 and 1.0 for others."""
    ratio = float(class_ratio(frame, label).first()["ratio"])
    return frame.withColumn(name, F.when(F.col(label) == 1, ratio).otherwise(1.0))
