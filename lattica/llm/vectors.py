"""Helpers on embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_keys(*cols: Column) -> list[Column]:
    """Two 64-bit hashes of the columns as k1 and k2: together they stand for equal vectors."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(17), *reversed(cols)).alias("k2")]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def count(df: DataFrame) -> int:
    return df.count()
