"""Vectors of integers made of vectors of floats: what the exact operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of this size and more have no exact integer.
LARGEST = float(1 << 52)


def integer_vectors(vectors: DataFrame, columns: dict[str, str], vector_col: str, scale: int, offset: int = 0) -> tuple[DataFrame, int]:
    """``columns`` (new name: old name) and ``x`` (array of long, floor(scale * entry) + offset), and the length of ``x``.

    Rows whose vector is null or empty, or holds an entry that is null, not finite or (times ``scale``) at or above
    2 to the 52, are dropped. Vectors have one length, the most frequent one (of equally frequent ones the longer);
    rows of another length are dropped. With no row left the length is 0.
    """
    rows = vectors.select(*[F.col(old).alias(new) for new, old in columns.items()], F.col(vector_col).cast("array<double>").alias("v"))
    exact = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LARGEST))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(exact, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    whole = F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(offset).cast("long"))
    return rows.where(F.size("v") == d).select(*columns, whole.alias("x")), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of ``d`` longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)
