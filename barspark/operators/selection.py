"""Values and rows by rank without a sort of all rows.

A rank is found digit by digit: counts by the leading digits show which bucket holds it, the next pass counts only
that bucket by its next digits, until few enough rows are left to be looked at one by one. A pass sends a bounded
number of counts, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So few rows are looked at one by one.
FEW = 10_000
_BITS = 16


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; NaN is above everything, the two zeros are one."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)


def doubles(bits: np.ndarray) -> np.ndarray:
    """The inverse of :func:`ordered_bits`."""
    b = bits.view(np.int64)
    return np.where(b < 0, b & np.int64((1 << 63) - 1), ~b).view(np.float64)


def _counts(frame: DataFrame, column: str, prefix: int | None, known: int) -> DataFrame:
    """(digit, n): rows of ``column`` by their bits after the ``known`` leading ones, of those that start with ``prefix``."""
    shift, mask = np.uint64(64 - known - _BITS), np.uint64((1 << _BITS) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << _BITS, dtype=np.int64)
        for batch in batches:
            bits = ordered_bits(batch.column(0).drop_null().to_numpy())
            if prefix is not None:
                bits = bits[bits >> np.uint64(64 - known) == np.uint64(prefix)]
            held += np.bincount((bits >> shift & mask).astype(np.int64), minlength=1 << _BITS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["digit", "n"])

    parts = frame.select(F.col(column).cast("double").alias("v")).mapInArrow(run, "digit int, n long")
    return parts.groupBy("digit").agg(F.sum("n").alias("n"))


def _few(frame: DataFrame, column: str, prefix: int, known: int) -> np.ndarray:
    """The sorted bits of the rows that start with ``prefix``; the caller knows that they are few."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = ordered_bits(batch.column(0).drop_null().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bits[bits >> np.uint64(64 - known) == np.uint64(prefix)].view(np.int64))], ["bits"])

    got = frame.select(F.col(column).cast("double").alias("v")).mapInArrow(run, "bits long").collect()
    return np.sort(np.array([r["bits"] for r in got], dtype=np.int64).view(np.uint64))


class _Digits:
    """The buckets that have been counted, so that ranks near each other share passes."""

    def __init__(self, frame: DataFrame, column: str, few: int) -> None:
        self.frame, self.column, self.few, self.seen, self.rows = frame, column, few, {}, {}
        self.n = sum(c for _, c in self.buckets(None, 0))

    def buckets(self, prefix: int | None, known: int) -> list[tuple[int, int]]:
        if (prefix, known) not in self.seen:
            self.seen[prefix, known] = sorted((r["digit"], r["n"]) for r in _counts(self.frame, self.column, prefix, known).collect())
        return self.seen[prefix, known]

    def value(self, rank: int) -> float:
        """The value of ``rank`` (from 0)."""
        prefix, known, left = None, 0, rank
        while known < 64:
            for digit, n in self.buckets(prefix, known):
                if left < n:
                    break
                left -= n
            prefix, known = ((prefix or 0) << _BITS) + digit, known + _BITS
            if n <= self.few and known < 64:
                if (prefix, known) not in self.rows:
                    self.rows[prefix, known] = _few(self.frame, self.column, prefix, known)
                return float(doubles(self.rows[prefix, known][left : left + 1])[0])
        return float(doubles(np.array([prefix], dtype=np.uint64))[0])


def exact_quantiles(frame: DataFrame, column: str, shares: Sequence[float], few: int = FEW) -> list[float | None]:
    """The quantiles of a numeric column, between two values by proportion; None without a value. Nulls do not count, NaN is the largest.

    Two to four passes over the column, in which a task sends at most 65,536 counts, or in the last one the ``few``
    rows around a rank.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    digits = _Digits(frame, column, few)
    if not digits.n:
        return [None] * len(shares)
    out = []
    for share in shares:
        place = share * (digits.n - 1)
        low = digits.value(math.floor(place))
        high = digits.value(math.ceil(place)) if place > math.floor(place) else low
        out.append(low if low == high else low + (place - math.floor(place)) * (high - low))
    return out


def exact_median(frame: DataFrame, column: str) -> float | None:
    return exact_quantiles(frame, column, [0.5])[0]


def with_smallest(frame: DataFrame, digest: Column, keep: int, among: Column, ties: Sequence[str], few: int = FEW, width: int = 3) -> DataFrame:
    """``frame`` with _in, true for the ``keep`` rows with the smallest ``digest`` (a text of hex digits, 32 say) of those that are ``among``.

    Only the rows of the last bucket, at most ``few`` unless digests repeat, are ranked, with ``ties`` after the digest.
    """
    from pyspark.sql import Window

    hashed = frame.withColumns({"_h": digest, "_among": F.coalesce(among, F.lit(False))})
    prefix, left, n = "", keep, None
    while left > 0 and len(prefix) < 32 and (n is None or n > few):
        inside = hashed.where("_among").where(F.col("_h").startswith(prefix)) if prefix else hashed.where("_among")
        edge, n = None, 0
        for r in inside.groupBy(F.substring("_h", len(prefix) + 1, width).alias("d")).count().orderBy("d").collect():  # 16 ** width at most
            edge, n = r["d"], r["count"]
            if n >= left:
                break
            left -= n
        if edge is None or n < left:
            return hashed.withColumn("_in", F.col("_among")).drop("_h", "_among")  # there are not so many
        prefix += edge
    if left <= 0:
        return hashed.withColumn("_in", F.lit(False)).drop("_h", "_among")
    border = F.col("_among") & F.col("_h").startswith(prefix)
    ranked = hashed.where(border).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", *ties))).withColumn("_in", F.col("_r") <= left).drop("_r")
    rest = hashed.where(~border).withColumn("_in", F.col("_among") & (F.col("_h") < prefix))
    return rest.unionByName(ranked).drop("_h", "_among")
