"""Helpers for tables of vectors: valid rows, integer components, exact
integer products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Integer components are kept as 32-bit numbers.
COMPONENT_LIMIT = 1 << 31


def valid_vectors(df: DataFrame, vec_col: str, *cols: Column) -> DataFrame:
    """``cols`` and the vector as ``v array<double>``; rows whose vector is
    null or holds a null or non-finite component are left out."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(*cols, v.alias("v")).filter(F.col("v").isNotNull() & ~bad)


def integer_matrix(col: pa.Array, scale: int) -> np.ndarray:
    """Rows of an Arrow list column as integers ``floor(scale * x)``."""
    n = len(col)
    if not n:
        return np.zeros((0, 0), np.int64)
    sizes = np.diff(col.offsets.to_numpy())
    if len(set(sizes.tolist())) != 1:
        raise ValueError("vectors of different lengths")
    x = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= COMPONENT_LIMIT:
        raise ValueError("a component is too large for exact integer arithmetic")
    return x.astype(np.int64).reshape(n, int(sizes[0]))


def from_bytes(cells: list[bytes], dim: int) -> np.ndarray:
    """The int64 matrix of cells written by :func:`to_bytes`."""
    return np.frombuffer(b"".join(cells), "<i4").reshape(-1, dim).astype(np.int64)


def to_bytes(x: np.ndarray) -> list[bytes]:
    """One cell of little-endian 32-bit integers per row."""
    raw, wide = x.astype("<i4").tobytes(), 4 * x.shape[1]
    return [raw[k * wide:(k + 1) * wide] for k in range(len(x))]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices (int64).

    Doubles hold every partial sum exactly below 2**53, and matrix products
    of doubles are the fast ones; larger values take the integer product."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 61:
        return a @ b.T
    raise ValueError("components are too large for exact integer products")
