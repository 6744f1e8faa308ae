"""Vectors in Arrow columns of arrays, as numpy matrices, and which of them can be used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector has components, none of them null, infinite or not a number."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column without nulls, all of dim components, in their own type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x, none of them zero, at length 1 and in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x
