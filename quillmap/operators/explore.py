"""Data behind the 3-D explorer: a repeatable sample, its first three components, its colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import constants as K
from quillmap.functions.text import basename, capitalize, pastel_color
from quillmap.functions.vectors import arrow_once, list_array_to_matrix, matrix_to_list_array
from quillmap.session import write_scratch


def sample_points(catalog: DataFrame, id_col: str = "doc_id", n: int = K.EXPLORER_POINTS
                  ) -> DataFrame:
    """At most ``n`` rows in digest order: the same rows on every run and any partitioning."""
    return catalog.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n)


def _project(vector: Column, axes: np.ndarray, mean: np.ndarray) -> Column:
    def project(v: pa.Array) -> pa.Array:
        rows, matrix = list_array_to_matrix(v, len(mean))
        return matrix_to_list_array(rows, (matrix - mean) @ axes, len(v))

    return arrow_once(project, "array<double>")(vector)


def covariance(catalog: DataFrame, vector: str = "vector") -> DataFrame:
    """(i, j, cov) for i <= j: sample covariance of the vectors' components, which decides their principal axes.

    A task sends one row for each pair of components, whatever it reads: products around its own mean, which
    are moved to the common mean where they are added.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, None, None
        for batch in batches:
            _, x = list_array_to_matrix(batch.column(0), None if mean is None else len(mean))
            if not len(x):
                continue
            m, own = len(x), x.mean(axis=0)
            part = (x - own).T @ (x - own)
            if mean is None:
                n, mean, products = m, own, part
                continue
            off = own - mean
            products += part + np.outer(off, off) * n * m / (n + m)
            mean, n = mean + off * m / (n + m), n + m
        if n:
            i, j = np.triu_indices(len(mean))
            yield pa.record_batch({
                "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "n": pa.array(np.full(len(i), n)),
                "a": pa.array(mean[i]), "b": pa.array(mean[j]), "p": pa.array(products[i, j])})

    parts = catalog.where(F.col(vector).isNotNull()).select(vector).mapInArrow(
        run, "i int, j int, n bigint, a double, b double, p double")
    n, a, b = F.sum("n"), F.sum(F.col("n") * F.col("a")), F.sum(F.col("n") * F.col("b"))
    added = parts.groupBy("i", "j").agg(
        n.alias("n"), (F.sum(F.col("p") + F.col("n") * F.col("a") * F.col("b")) - a * b / n).alias("s"))
    return added.where("n > 1").select("i", "j", (F.col("s") / (F.col("n") - 1)).alias("cov"))


def pca_points(catalog: DataFrame, vector: str = "vector", id_col: str = "doc_id",
               n: int = K.EXPLORER_POINTS) -> DataFrame:
    """(id, x, y, z, source_name, domain_display, label, domain_score, type) of the sample.

    The components come from Spark ML, which leaves the projection uncentred, so the mean is taken
    off here. Each axis points to where its largest weight is positive.
    """
    keep = [c for c in ("label", "domain_score", "type") if c in catalog.columns]
    known = catalog.where(F.col(vector).isNotNull())
    # at most n rows, read several times below
    points = write_scratch(
        sample_points(known.select(id_col, vector, "source", "domain", *keep), id_col, n), "points")
    features = points.select(array_to_vector(F.col(vector).cast("array<double>")).alias("f"))
    model = PCA(k=3, inputCol="f", outputCol="p").fit(features)
    axes = model.pc.toArray()
    at = np.abs(axes).argmax(axis=0)
    axes = axes * np.sign(axes[at, np.arange(axes.shape[1])])
    mean = np.asarray(features.select(_mean(F.col("f"))).head()[0].toArray())
    placed = points.withColumn("_p", _project(F.col(vector), axes, mean))
    return placed.select(
        id_col, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), F.col("_p")[2].alias("z"),
        basename(F.col("source")).alias("source_name"),
        capitalize(F.col("domain")).alias("domain_display"), *keep)


def _mean(features: Column) -> Column:
    from pyspark.ml.stat import Summarizer

    return Summarizer.mean(features)


def domain_palette(catalog: DataFrame) -> DataFrame:
    """(domain_display, color) of every domain."""
    return catalog.select("domain").distinct().select(
        capitalize(F.col("domain")).alias("domain_display"),
        pastel_color(F.col("domain")).alias("color"))
