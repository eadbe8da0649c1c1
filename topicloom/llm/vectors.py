"""Vector columns: rows that count, and their entries as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beyond this a scaled entry is no exact integer in the sums that follow.
LARGEST = 1 << 40


def whole_rows(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null nor holds a null or non-finite entry."""

    def fine(x: Column) -> Column:
        value = x.cast("double")
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))

    return vectors.where(F.col(column).isNotNull() & F.forall(column, fine))


def scaled_entries(column: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * entry)`` of every vector of a batch, one row each.

    Vectors of different lengths and entries too large to be exact raise ``ValueError``.
    """
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if sizes.size > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} entries in one table")
    entries = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if entries.size and np.abs(entries).max() > LARGEST:
        raise ValueError(f"entries beyond {LARGEST // scale} are not supported")
    return entries.astype(np.int64).reshape(len(column), -1)
