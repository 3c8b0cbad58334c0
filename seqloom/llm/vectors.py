"""Embedding columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    x = v.cast("array<double>")
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return v.isNotNull() & F.coalesce(ok, F.lit(False))


def width(vectors: DataFrame, col: str) -> int:
    """The largest number of components; shorter vectors count as padded with zeros."""
    return vectors.agg(F.max(F.size(col))).first()[0] or 0


def matrix(col: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column, in double precision by default, padded with zeros."""
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=kind)
    size = np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), kind)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out
