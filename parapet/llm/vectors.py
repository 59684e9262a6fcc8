"""Vector columns: which vectors take part, and matrices from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def picked(rows: DataFrame, most: int) -> np.ndarray:
    """A bounded sample of the column ``v``: the lowest by hash. Only vectors of the most common length count."""
    got = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(most).collect()
    sizes: dict[int, int] = {}
    for row in got:
        sizes[len(row["v"])] = sizes.get(len(row["v"]), 0) + 1
    if not sizes:
        return np.zeros((0, 0))
    size = max(sizes, key=lambda k: (sizes[k], k))
    return np.array([row["v"] for row in got if len(row["v"]) == size], np.float64)
