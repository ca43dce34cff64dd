"""Vector expressions (JVM side) and the Arrow kernels used where a matrix product pays off."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is.

    The norm enters as a one-element array that is unfolded with the vector, because a lambda
    would compute an outer expression again for every element.
    """
    return F.flatten(
        F.transform(
            F.array(F.struct(as_doubles(v).alias("v"), l2_norm(v).alias("n"))),
            lambda s: F.transform(
                s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)
            ),
        )
    )


def cosine(a: Column, b: Column) -> Column:
    """NULL when either side has no direction."""
    return F.try_divide(dot(a, b), F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )


def fuse(a: Column, b: Column) -> Column:
    """Element-wise mean of the vectors that exist; NULL when neither does."""
    a, b = as_doubles(a), as_doubles(b)
    return (
        F.when(a.isNull(), b)
        .when(b.isNull(), a)
        .otherwise(F.zip_with(a, b, lambda x, y: (x + y) / 2))
    )


# --- Arrow kernels ----------------------------------------------------------

def arrow_once(fn, return_type: str):
    """Arrow UDF that the optimizer may move but never evaluates a second time.

    A deterministic Python function would be copied into every filter that Spark derives from its
    result (the non-empty check of an explode, for one) and run again there.
    """
    return F.arrow_udf(fn, return_type).asNondeterministic()


def list_array_to_matrix(arr: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the usable vectors of an Arrow list column.

    NULL and empty vectors are left out; a vector of another size than ``dim`` (without it, than
    the first) is an error.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lengths = np.asarray(arr.value_lengths().fill_null(-1))
    if dim is None:
        used = lengths[lengths > 0]
        dim = int(used[0]) if len(used) else 0
    rows = np.flatnonzero(lengths > 0) if dim else np.empty(0, dtype=np.int64)
    if len(rows) and (lengths[rows] != dim).any():
        raise ValueError(f"vectors of {set(lengths[rows].tolist()) - {dim}} components among those of {dim}")
    if not len(rows):
        return rows, np.empty((0, dim))
    picked = arr if len(rows) == len(arr) else arr.take(pa.array(rows))
    flat = np.asarray(picked.flatten(), dtype=np.float64)
    return rows, flat.reshape(len(rows), dim)


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and the mask of rows that have a direction."""
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    ok = norms > 0
    return matrix / np.where(ok, norms, 1.0)[:, None], ok


def matrix_to_list_array(rows: np.ndarray, matrix: np.ndarray, n: int) -> pa.Array:
    """Arrow list column of length ``n`` that is NULL outside ``rows``."""
    width = matrix.shape[1] if matrix.ndim == 2 else 0
    lengths = np.zeros(n, dtype=np.int64)
    lengths[rows] = width
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    missing = np.ones(n, dtype=bool)
    missing[rows] = False
    return pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.array(matrix.reshape(-1).astype(np.float64)),
        mask=pa.array(missing) if missing.any() else None,
    )


def cosine_scores(vector: Column, references: np.ndarray) -> Column:
    """Cosine of a vector column with every row of a small matrix, as ``array<double>``.

    One matrix product per Arrow batch; NULL for a NULL or zero vector. ``references`` must already
    be size-checked, since it is shipped with the task.
    """
    refs, _ = unit_rows(np.asarray(references, dtype=np.float64))
    dim = refs.shape[1]

    def scores(v: pa.Array) -> pa.Array:
        rows, matrix = list_array_to_matrix(v, dim)
        unit, ok = unit_rows(matrix)
        return matrix_to_list_array(rows[ok], unit[ok] @ refs.T, len(v))

    return arrow_once(scores, "array<double>")(vector)
