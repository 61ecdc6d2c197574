"""Vectors as rows of float32 bytes, and the measure of nearness.

A vector takes part if it is not null or empty, holds no null and only finite
components, and is not all zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    floats = vector.cast("array<double>")
    finite = F.forall(floats, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(floats, lambda x: x != 0), F.lit(False))


def read(vectors: DataFrame) -> DataFrame:
    """The usable rows of vec_id, embedding, with ids that are not null."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))


def by_width(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a list column for each length that occurs."""
    at = column.offsets.to_numpy()
    width = np.diff(at)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    out = []
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out.append((rows, flat[at[rows][:, None] + np.arange(w)]))
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal values wherever they stand."""
    x, y = np.ascontiguousarray(x, dtype=np.float64), np.ascontiguousarray(y, dtype=np.float64)
    return (x * y).sum(axis=1) / (norms(x) * norms(y))


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / norms(x)[:, None]
