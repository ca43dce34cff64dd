"""Connected components of an edge list by alternating large and small stars.

No component is ever gathered: each step takes the smallest neighbour of every node by an aggregation and
hangs neighbours onto it by a join. Stars need a few steps, chains a logarithmic number. Every step is cut
by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import write_scratch


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b; large: also seen from the smaller end."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not the smallest of its component; root is that."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = write_scratch(edges, "edges")
    mark = _fingerprint(edges)
    while True:
        edges = write_scratch(_star(_star(edges, True), False), "edges")
        now = _fingerprint(edges)
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
