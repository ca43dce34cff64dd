"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.session import write_scratch

__all__ = ["maybe_among", "only", "read_table", "row_slices", "sample_by_hash", "string_column", "without", "write_scratch"]

#: Bits for each key in the map that ``maybe_among`` broadcasts, and the most it has (4 MB, in rows of 64).
BITS_PER_KEY, MAX_BITS = 16, 1 << 25


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Views of at most ``rows`` rows, so that only few texts are Python objects at a time.

    Memory that Arrow keeps for later goes back after each batch, as workers live on for other jobs.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def string_column(name: str, alias: str | None = None):
    return F.col(f"`{name}`").cast("string").alias(alias or name)


def _marked(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """With ``__marked``, false only where the value in the one column of ``keys`` is not there; told by a broadcast map of
    hashed keys of a bounded size. An inner join leaves out most of those rows at once."""
    (key,) = keys.columns
    bits = min(MAX_BITS, 1 << max(10, (BITS_PER_KEY * keys.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(bits)).alias("__place")
    marks = keys.select(place).groupBy(F.expr("__place div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__place % 64 AS int)))").alias("__bits"))
    placed = df.select("*", place).join(F.broadcast(marks), F.expr("__place div 64 = __word"), how)
    return placed.withColumn("__marked", F.expr("coalesce(getbit(__bits, cast(__place % 64 AS int)) = 1, false)")).drop("__place", "__word", "__bits")


def maybe_among(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose value in the one column of ``keys`` is there, and a few others.

    Meant for what goes into a join that keeps a small part of it: rows are told by a broadcast map of hashed keys,
    so that the others are never shuffled. The map has a bounded size; beyond it more of the others pass. ``keys`` comes
    from a written table and has the type of the column in ``df``. The join that follows is an inner or an outer one: Spark
    moves semi- and anti-joins below that with the map, where they shuffle all rows; ``only`` and ``without`` stand for them.
    """
    return _marked(df, keys, "inner").where("__marked").drop("__marked")


def only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose value in the one column of ``keys`` is there: an exact semi-join behind ``maybe_among``."""
    return maybe_among(df, keys).join(keys.distinct(), keys.columns[0]).select(*[F.col(f"`{c}`") for c in df.columns])


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose value in the one column of ``keys`` is not there, or null: an exact anti-join.

    Meant for wide rows of which most stay: those that ``maybe_among`` leaves out stay where they are, only the others
    are joined. ``df`` is read twice, so it comes from a table, as ``keys`` does.
    """
    doubtful = maybe_among(df, keys).join(keys.distinct().withColumn("__there", F.lit(True)), keys.columns[0], "left").where("__there IS NULL")
    return _marked(df, keys, "left").where("NOT __marked").drop("__marked").unionByName(doubtful.drop("__there"))


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the key: the same ones in every run."""
    total = df.count()
    if total <= rows:
        return df
    modulus = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(f"`{key}`")), F.lit(modulus)) < int(modulus * rows / total))
