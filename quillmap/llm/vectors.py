"""Integer vectors for the operators on embeddings: exact whatever the size of a component.

A component becomes floor(scale * x). Such a number is always a double, so vectors travel as doubles; arithmetic is done in
doubles where no result can lose a digit, and in Python's integers beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results beyond 64 bits are returned, and ranked, as the nearest of these.
MOST = (1 << 63) - 1


def scaled(vector: str, scale: int) -> Column:
    """The vector as doubles times ``scale``; floors are taken by ``matrix``, as Spark's would end at 64 bits."""
    return F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda e: e * float(scale))


def usable(x: str) -> Column:
    """No null, NaN or infinity among the scaled components, and a vector at all."""
    return F.col(x).isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Floors of a list column whose vectors all have this length, as doubles."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return np.floor(flat.reshape(len(column), length))


def integers(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    return np.array([int(e) for e in x.ravel()], dtype=object).reshape(x.shape)


def largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0.0))


def clipped(x) -> np.ndarray:
    """Integers as 64-bit ones, ended at both sides."""
    if x.dtype != object:
        return x.astype(np.int64)
    return np.array([max(-MOST, min(MOST, int(e))) for e in x.ravel()], dtype=np.int64).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, as 64-bit integers."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    return clipped(integers(a) @ integers(b).T)


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the same rows of b, as 64-bit integers."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < 2.0 ** 53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return clipped((integers(a) * integers(b)).sum(axis=1))


def commonest_length(rows: DataFrame, x: str) -> tuple[int, float] | None:
    """(length, largest absolute component) of the vectors of the commonest length, the shorter of equally common ones."""
    widest = F.coalesce(F.array_max(F.transform(x, lambda e: F.abs(e))), F.lit(0.0))
    found = rows.groupBy(F.size(x).alias("length")).agg(F.count("*").alias("n"), F.max(widest).alias("widest"))
    best = found.orderBy(F.desc("n"), "length").limit(1).collect()
    return (best[0]["length"], best[0]["widest"]) if best else None
