"""Columns and Arrow helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vector: str) -> Column:
    """The vector holds one entry at least and none that is null, NaN or infinite."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & usable, F.lit(False))


def of_common_length(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has the commonest length (ties: the shortest); others cannot be compared with them."""
    lengths = df.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    return df.filter(F.size(vector) == (most["length"] if most else 0))


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)
