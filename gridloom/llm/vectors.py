"""Vectors as whole numbers, and exact squared distances between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beyond this a squared distance of some dozens of components does not fit 64 bits.
LARGEST = 1 << 27
# Up to this, products and sums of some hundred components are whole numbers that a double holds.
PRODUCTS = 1 << 22


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(vector), finite), F.lit(False))


def whole_numbers(vector: str, scale: int) -> Column:
    """Each component ``e`` as ``floor(scale * e)``, with ``e`` as a double."""
    return F.transform(vector, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors of one length as rows of a matrix."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)
    if len(x) and max(int(x.max(initial=0)), -int(x.min(initial=0))) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}: squared distances would not fit 64 bits")
    return x


def list_column(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of vectors."""
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1)))


def all_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row of ``x`` to every row of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= PRODUCTS and x.shape[1] <= 128:
        product = x.astype(np.float64) @ c.T.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * product.astype(np.int64)
    return np.stack([((x - own) ** 2).sum(axis=1) for own in c], axis=1)


def pair_squares(x: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Exact squared distances between the rows ``x[i]`` and ``c[j]``, pair by pair."""
    out = np.empty(len(i), dtype=np.int64)
    for a in range(0, len(i), step):
        d = x[i[a : a + step]] - c[j[a : a + step]]
        out[a : a + step] = np.einsum("ij,ij->i", d, d)
    return out


def kept_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``df`` with the column ``x`` of whole numbers, without vectors that are not usable."""
    return df.where(usable(vector)).withColumn("x", whole_numbers(vector, scale))
