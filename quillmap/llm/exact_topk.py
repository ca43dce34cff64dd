"""Exact top-k by inner product through distributed histogram selection.

Components become integers, so scores are integers and every result is exact. All candidates are scored
against all queries in a grid: candidates are dealt to groups, queries to blocks of bounded size, and a
task streams the candidates of a group past a block of queries, one such cell after the other. The number of cells
is bounded, so however many rows there are, a pass copies a candidate once for each block and no more. A pass counts, for each query, the scores
by bins of its current range; the counts of all tasks are added, the bin that holds the k-th score becomes the
new range, and the next pass looks into it, until no more than a few rows beyond k lie at or above its lower
edge, or the range is a single score. A range knows its last score, so rows above it, which are counted already, are not
counted again by bins that reach beyond it. A last pass emits what reaches that edge; of equal scores a task
emits no more of the smallest ids than the query can need.

Defined results: rows without an id, without a vector, or with a null, NaN or infinite component take no
part. Vectors are compared with those of their own length. A repeated row is a candidate as often as it
occurs; a query is asked once for each id, with its smallest vector, and never meets rows of its own id. Fewer
candidates than k give all of them. Scores beyond 64 bits are returned, and ranked, as the nearest 64-bit number; up to there
they are exact, however large a component is. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm import vectors as V
from quillmap.llm.common import write_scratch

BINS = 512
#: Rows beyond k that may reach the edge before the search for a narrower range ends.
SLACK = 22
QUERIES_IN_BLOCK, CANDIDATES_IN_GROUP, TILE = 2048, 16384, 1024
#: Cells of a pass, and partitions they are dealt to.
CELLS, PARTITIONS = 16384, 4096
#: Scores end here on both sides; differences of two fit 64 bits without a sign.
MOST = V.MOST


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, x (scaled doubles, whose floors are the components), norm; only rows that take part."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), V.scaled(vector, scale).alias("x")).where(F.col("id").isNotNull() & V.usable("x"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + F.pow(F.abs(e) + 1, F.lit(2.0)))))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, (queries, candidates)."""
    return V.products(q, c)


class _Block:
    """The queries of one block and length, and what a task gathers for them."""

    def __init__(self, k: int, bins: int):
        self.k, self.bins, self.parts = k, bins, []

    def add(self, ids, vectors, low, last, width) -> None:
        self.parts.append((ids, vectors, low, last, width))

    def close(self) -> None:
        self.ids, self.vectors, self.low, self.last, self.width = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.hits = [], []
        self.counts = np.zeros((len(self.ids), self.bins), dtype=np.int64) if self.bins else None

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), TILE):
            some = ids[at:at + TILE]
            score = _scores(self.vectors, vectors[at:at + TILE])
            other = self.ids[:, None] != some[None, :]
            if self.bins:
                other &= (score >= self.low[:, None]) & (score <= self.last[:, None])
                bin_of = ((score - self.low[:, None]).view(np.uint64) // self.width[:, None].astype(np.uint64)).view(np.int64)
                bin_of += np.arange(len(self.ids))[:, None] * self.bins
                self.counts += np.bincount(bin_of[other], minlength=self.counts.size).reshape(self.counts.shape)
            else:
                q, c = np.nonzero(other & (score >= self.low[:, None]))
                self.hits.append(np.stack([q, score[q, c], some[c]]))
                if sum(h.shape[1] for h in self.hits) > 4 * self.k * len(self.ids) + 100_000:
                    self.hits = [self._best()]

    def _best(self) -> np.ndarray:
        """The first k hits of each query in the final order; the rest cannot be among the results."""
        q, score, ids = np.concatenate(self.hits, axis=1) if self.hits else np.zeros((3, 0), dtype=np.int64)
        order = np.lexsort((ids, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        order = order[place < self.k]
        return np.stack([q[place < self.k], score[order], ids[order]])

    def rows(self) -> pa.RecordBatch:
        if self.bins:
            # bins below the task's own k-th score can never hold the k-th score of all
            above = np.cumsum(self.counts[:, ::-1], axis=1)[:, ::-1] - self.counts
            q, b = np.nonzero((self.counts > 0) & (above < self.k))
            return pa.record_batch({"query_id": self.ids[q], "item": b.astype(np.int64), "amount": self.counts[q, b]})
        q, score, ids = self._best()
        return pa.record_batch({"query_id": self.ids[q], "item": ids, "amount": score})


def _pass(candidates: DataFrame, queries: DataFrame, groups: int, blocks: int, k: int, bins: int) -> DataFrame:
    """All candidates against all queries: (query_id, bin, count), or with bins=0 (query_id, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, open_ = None, {}, False
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            lengths = np.diff(batch.column("x").offsets.to_numpy())
            # sorted by cell and kind; a stretch has one cell, kind and length
            cut = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(lengths) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if a == b:
                    continue
                part, length = batch.slice(a, b - a), int(lengths[a])
                if cells[a] != cell:
                    if open_:
                        yield from (x.rows() for x in held.values())
                    cell, held, open_ = cells[a], {}, False
                ids, vectors = part.column("id").to_numpy(), V.matrix(part.column("x"), length)
                if kinds[a] == 0:
                    held.setdefault(length, _Block(k, bins)).add(ids, vectors, *(part.column(c).to_numpy() for c in ("low", "last", "width")))
                    continue
                if not open_:
                    for x in held.values():
                        x.close()
                    open_ = True
                if length in held:
                    held[length].meet(ids, vectors)
        if open_:
            yield from (x.rows() for x in held.values())

    zero = F.lit(0).cast("bigint")
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", "id", "x", "low", "last", "width").select(
        (F.col("g") * blocks + F.col("block")).cast("int").alias("cell"), F.lit(0).alias("kind"), "id", "x", "low", "last", "width")
    right = candidates.select(F.pmod("slot", F.lit(groups)).alias("g"), "id", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(
        (F.col("g") * blocks + F.col("block")).cast("int").alias("cell"), F.lit(1).alias("kind"), "id", "x", *(zero.alias(c) for c in ("low", "last", "width")))
    parts = min(groups * blocks, PARTITIONS)
    cells = left.unionByName(right).repartitionById(parts, F.pmod("cell", F.lit(parts))).sortWithinPartitions("cell", "kind")
    return cells.mapInArrow(run, "query_id bigint, item bigint, amount bigint")


def exact_top_k(vectors: DataFrame, asked, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: for the rows where ``asked`` (a column over ``id``) holds, against all rows."""
    rows = integer_vectors(vectors, key, vector, scale).withColumn("slot", F.monotonically_increasing_id())
    rows = write_scratch(rows, "vectors")
    total, widest = rows.agg(F.count("*"), F.max("norm")).first()
    queries = rows.where(asked).groupBy("id").agg(F.min("x").alias("x"), F.min_by("norm", "x").alias("norm"))
    blocks = max(1, -(-queries.count() // QUERIES_IN_BLOCK))
    groups = max(1, min(-(-total // CANDIDATES_IN_GROUP), CELLS // blocks))
    # no score lies beyond the product of the norms
    product = F.col("norm") * F.lit(widest or 0.0) * 1.000001
    edge = F.when(product < 2.0 ** 62, F.ceil(product) + 1).otherwise(F.lit(MOST)).cast("bigint")
    state = queries.withColumn("edge", edge).select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "x",
        (-F.col("edge")).alias("low"), F.col("edge").alias("last"), F.expr(f"2 * (edge div {BINS}) + 2").alias("width"), F.lit(0).cast("bigint").alias("above"), F.lit(False).alias("done"))
    state = write_scratch(state, "ranges")
    while state.where("NOT done").limit(1).count():
        counts = _pass(rows, state.where("NOT done"), groups, blocks, k, BINS).groupBy("query_id", "item").agg(F.sum("amount").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("item"))
        reach = counts.withColumn("upto", F.sum("n").over(down))
        # the first bin from above at which k is reached; without one all candidates are results
        found = reach.join(state.select(F.col("id").alias("query_id"), F.col("above").alias("had")), "query_id").where(F.col("upto") + F.col("had") >= k)
        found = found.groupBy("query_id").agg(F.max("item").alias("item"), F.max_by("upto", "item").alias("upto"), F.max_by("n", "item").alias("n"))
        step = state.join(found.withColumnRenamed("query_id", "id"), "id", "left")
        now = ~F.col("done") & F.col("item").isNotNull()
        # sums and products on the way may not fit 64 bits, though the edges of ranges do
        wide = {c: F.col(c).cast("decimal(20,0)") for c in ("low", "last", "item", "width")}
        start = wide["low"] + wide["item"] * wide["width"]
        low = F.when(now, start.cast("bigint")).otherwise(F.col("low"))
        last = F.when(now, F.least(wide["last"].cast("decimal(38,0)"), (start + wide["width"] - 1).cast("decimal(38,0)")).cast("bigint")).otherwise(F.col("last"))
        upto = F.col("above") + F.col("upto")
        ended = F.col("done") | F.col("item").isNull() | (F.col("width") == 1) | (upto <= k + SLACK)
        state = write_scratch(step.select(
            "block", "id", "x", low.alias("low"), last.alias("last"),
            F.when(now & ~ended, F.expr(f"(width - 1) div {BINS} + 1")).otherwise(F.col("width")).alias("width"),
            F.when(now, F.col("above") + F.col("upto") - F.col("n")).otherwise(F.col("above")).alias("above"), ended.alias("done")), "ranges")
    hits = _pass(rows, state, groups, blocks, k, 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("amount"), "item")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("item").alias(key), F.col("amount").alias("score"))
