"""Indexes that let a search skip most vectors and still return the exact nearest rows.

Cells (inverted file): KMeans cells with their radii. The nearest cells give a first k-th distance;
by the triangle inequality every other cell can be skipped unless its border is nearer than that.

Codes (product quantisation): each vector is stored as a few bytes and its own reconstruction error.
Distance to the reconstruction +- the error brackets the true distance, so only rows whose lower
bound is within the k-th upper bound are read in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmap import constants as K
from quillmap.functions.vectors import arrow_once, l2_normalize, list_array_to_matrix, unit_rows
from quillmap.operators.search import (
    DIST_DIGITS,
    QuerySide,
    SearchPass,
    best_k,
    hit_schema,
    query_columns,
    scan_sides,
    top_k,
)
from quillmap.session import collect_bounded, write_scratch

# slack of the bounds: rounding of stored distances and of the expanded square
SLACK = 2e-6


def _train(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """KMeans centres of a column ``v``, trained on every row."""
    features = vectors.select(array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10, initMode="random").fit(features)
    return np.array(model.clusterCenters())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]
    return np.maximum(d, 0.0)


# --- cells ------------------------------------------------------------------

@dataclass(frozen=True)
class CellIndex:
    rows: DataFrame            # catalog columns + cell, cell_dist
    vector: str
    centres: np.ndarray        # cells x dim
    radii: np.ndarray          # farthest member of each cell; -1 for an empty cell


def _assign(vector: Column, centres: np.ndarray) -> Column:
    dim = centres.shape[1]

    def nearest(v: pa.Array) -> pa.Array:
        rows, matrix = list_array_to_matrix(v, dim)
        unit, ok = unit_rows(matrix)
        cell = np.full(len(v), -1, dtype=np.int32)
        dist = np.zeros(len(v))
        if ok.any():
            d = _squares(unit[ok], centres)
            at = d.argmin(axis=1)
            cell[rows[ok]] = at
            dist[rows[ok]] = np.sqrt(d[np.arange(len(at)), at])
        missing = pa.array(cell < 0)
        return pa.StructArray.from_arrays(
            [pa.array(cell), pa.array(dist)], names=["cell", "cell_dist"], mask=missing)

    return arrow_once(nearest, "struct<cell:int,cell_dist:double>")(vector)


def build_cells(
    catalog: DataFrame, vector: str, n_cells: int = K.INDEX_CELLS,
    min_rows: int = K.INDEX_MIN_ROWS, path: str | None = None, seed: int = 17,
) -> CellIndex | None:
    """Index of the rows that have a vector; None for tables too small to need one.

    With ``path`` the rows are written partitioned by cell, so that a search prunes whole
    directories. Rows are spread by the rebalance hint: a cell may hold most of the table.
    """
    known = catalog.where(F.col(vector).isNotNull())
    if known.limit(min_rows + 1).count() <= min_rows:
        return None
    centres = _train(known.select(l2_normalize(F.col(vector)).alias("v")), n_cells, seed)
    rows = known.withColumn("_a", _assign(F.col(vector), centres)).withColumns(
        {"cell": F.col("_a.cell"), "cell_dist": F.col("_a.cell_dist")}
    ).drop("_a").where("cell IS NOT NULL")
    if path is not None:
        rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        rows = catalog.sparkSession.read.parquet(path)
    else:
        rows = write_scratch(rows, "cells")
    radii = np.full(len(centres), -1.0)
    for r in rows.groupBy("cell").agg(F.max("cell_dist").alias("r")).collect():   # <= n_cells rows
        radii[r["cell"]] = r["r"]
    return CellIndex(rows, vector, centres, radii)


# --- cells that are kept ----------------------------------------------------

def create_index(catalog: DataFrame, vector: str, path: str, batch: str, n_cells: int = K.INDEX_CELLS,
                 id_col: str = "doc_id", seed: int = 17) -> None:
    """Train cells on the catalog and store its rows in them, below ``path``."""
    known = catalog.where(F.col(vector).isNotNull())
    centres = _train(known.select(l2_normalize(F.col(vector)).alias("v")), n_cells, seed)
    spark = catalog.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    append_index(catalog, vector, path, batch, id_col)


def append_index(rows: DataFrame, vector: str, path: str, batch: str, id_col: str = "doc_id") -> None:
    """Store new rows in the cells there are, and how far they reach in each.

    Nothing that is stored is read or changed. A batch that is written again replaces itself.
    """
    spark = rows.sparkSession
    centres = _centres(spark, path)
    kept = [c for c in (id_col, vector, "domain", "label") if c in rows.columns]
    placed = rows.where(F.col(vector).isNotNull()).select(*kept, _assign(F.col(vector), centres).alias("_a"))
    placed = placed.select(*kept, F.col("_a.cell").alias("cell"), F.col("_a.cell_dist").alias("cell_dist"))
    to = f"{path}/rows/batch={batch}"
    placed.where("cell IS NOT NULL").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(to)
    stored = spark.read.schema("cell int, cell_dist double").parquet(to)
    stored.groupBy("cell").agg(F.max("cell_dist").alias("radius")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/radii/batch={batch}")


def _centres(spark, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()      # a row for each cell
    return np.array([r["centre"] for r in rows])


def open_index(spark, path: str, vector: str) -> CellIndex:
    """The stored cells; a radius is the farthest of all batches."""
    centres = _centres(spark, path)
    radii = np.full(len(centres), -1.0)
    reach = spark.read.option("basePath", f"{path}/radii").parquet(f"{path}/radii").groupBy("cell").agg(F.max("radius").alias("r"))
    for r in reach.collect():                                                  # a row for each cell
        radii[r["cell"]] = r["r"]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return CellIndex(rows, vector, centres, radii)


class _ProbeSide(QuerySide):
    """Query side that compares a row only with the queries that visit its cell."""

    def __init__(self, table: pa.Table, spec: SearchPass, visits: np.ndarray, digits: int):
        super().__init__(table, spec, digits)
        self.visits = {int(c): np.flatnonzero(visits[:, c]) for c in range(visits.shape[1])
                       if visits[:, c].any()}

    def allowed(self, batch, rows):
        cells = np.asarray(batch.column("cell"))[rows]
        for members, at in super().allowed(batch, rows):
            for cell in np.unique(cells[at]):
                visiting = self.visits.get(int(cell))
                some = members if visiting is None else members[np.isin(members, visiting)]
                if visiting is not None and len(some):
                    yield some, at[cells[at] == cell]


def search_cells(
    index: CellIndex, queries: DataFrame, query_vector: str, k: int = 10, n_probe: int = 4,
    pass_no: int = 2, id_col: str = "doc_id", exact: bool = True, digits: int = DIST_DIGITS,
    filtered: bool = False,
) -> DataFrame:
    """k nearest rows per query, of those that meet its predicate if ``filtered``.

    ``exact=False`` stops after the ``n_probe`` nearest cells.
    """
    spec = SearchPass(pass_no, index.vector, query_vector, filtered)
    asked = query_columns(queries, (spec,))
    table = collect_bounded(asked)
    if table is None:
        return top_k(index.rows, queries, (spec,), k, id_col, digits=digits)
    side = QuerySide(table, spec, digits)
    schema = hit_schema(index.rows, asked, id_col)
    to_centre = np.sqrt(_squares(side.unit, index.centres))
    filled = index.radii >= 0
    order = np.argsort(np.where(filled, to_centre, np.inf), axis=1)[:, :n_probe]
    first = np.zeros_like(to_centre, dtype=bool)
    np.put_along_axis(first, order, True, axis=1)
    first &= filled

    def visit(visits: np.ndarray) -> DataFrame:
        cells = [int(c) for c in np.flatnonzero(visits.any(axis=0))]
        slim = index.rows.where(F.col("cell").isin(cells)).select(
            id_col, index.vector, "cell", *(["domain", "label"] if filtered else []))
        return scan_sides(slim, [_ProbeSide(table, spec, visits, digits)], k, id_col, schema)

    near = best_k(visit(first), k, id_col)
    if not exact:
        return near
    near = write_scratch(near.drop("rk"), "near")
    kth = {r["qid"]: r["d"] for r in near.groupBy("qid").agg(     # one row per query
        F.max("dist").alias("d"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
    reach = np.array([np.sqrt(2 * (max(kth[q], 0.0) + SLACK)) if q in kth else np.inf
                      for q in side.qids])
    rest = (to_centre - index.radii[None, :] - SLACK <= reach[:, None]) & filled & ~first
    if not rest.any():
        return best_k(near, k, id_col)
    return best_k(near.unionByName(visit(rest)), k, id_col)


# --- codes ------------------------------------------------------------------

@dataclass(frozen=True)
class CodeIndex:
    codes: DataFrame           # id, code (one byte per sub-vector), error
    catalog: DataFrame
    vector: str
    book: np.ndarray           # entries x sub-vector length


def _encode(vector: Column, book: np.ndarray, n_sub: int) -> Column:
    width = book.shape[1]

    def encode(v: pa.Array) -> pa.Array:
        rows, matrix = list_array_to_matrix(v, n_sub * width)
        unit, ok = unit_rows(matrix)
        rows, unit = rows[ok], unit[ok]
        parts = unit.reshape(-1, width)
        at = _squares(parts, book).argmin(axis=1) if len(parts) else np.empty(0, dtype=int)
        error = np.sqrt(((parts - book[at]) ** 2).reshape(len(rows), -1).sum(axis=1))
        codes: list = [None] * len(v)
        errors = np.zeros(len(v))
        for r, code, e in zip(rows, at.reshape(len(rows), n_sub).astype(np.uint8), error):
            codes[r], errors[r] = code.tobytes(), e
        missing = pa.array([c is None for c in codes])
        return pa.StructArray.from_arrays(
            [pa.array(codes, pa.binary()), pa.array(errors)], names=["code", "error"],
            mask=missing)

    return arrow_once(encode, "struct<code:binary,error:double>")(vector)


def build_codes(
    catalog: DataFrame, vector: str, n_sub: int = K.INDEX_SUB_VECTORS, entries: int = 256,
    id_col: str = "doc_id", seed: int = 17,
) -> CodeIndex:
    """One byte per sub-vector from a codebook that all sub-vectors share, and the exact error."""
    known = catalog.where(F.col(vector).isNotNull())
    dim = known.select(F.size(vector)).head()[0]
    if dim % n_sub:
        raise ValueError(f"{n_sub} sub-vectors do not divide {dim} dimensions")
    width = dim // n_sub
    unit = known.select(l2_normalize(F.col(vector)).alias("u"))
    parts = unit.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(n_sub - 1)),
        lambda i: F.slice("u", i * width + 1, F.lit(width)))).alias("v"))
    book = _train(parts, min(entries, 256), seed)
    coded = known.select(id_col, _encode(F.col(vector), book, n_sub).alias("_c")).where(
        "_c IS NOT NULL").select(id_col, "_c.code", "_c.error")
    return CodeIndex(write_scratch(coded, "codes"), known, vector, book)


class _CodeSide(QuerySide):
    """Distances to reconstructions, looked up per byte of the code."""

    def __init__(self, table: pa.Table, spec: SearchPass, book: np.ndarray):
        super().__init__(table, spec)
        n_sub = self.unit.shape[1] // book.shape[1]
        parts = self.unit.reshape(len(self.qids), n_sub, book.shape[1])
        self.tables = np.stack([_squares(p, book) for p in parts]) if len(self.qids) else None
        self.n_sub = n_sub

    def brackets(self, batch) -> tuple[np.ndarray, np.ndarray]:
        """(distance to the reconstruction, error): queries x rows, rows."""
        raw = b"".join(batch.column("code").to_pylist())
        codes = np.frombuffer(raw, dtype=np.uint8).reshape(batch.num_rows, self.n_sub)
        at = np.arange(self.n_sub)[None, :]
        dist = np.stack([np.sqrt(t[at, codes].sum(axis=1)) for t in self.tables])
        return dist, np.asarray(batch.column("error"))

    def tiles(self, batch):
        dist, error = self.brackets(batch)
        yield np.arange(len(self.qids)), np.arange(batch.num_rows), dist + error[None, :]


def search_codes(index: CodeIndex, queries: DataFrame, query_vector: str, k: int = 10,
                 pass_no: int = 2, id_col: str = "doc_id", digits: int = DIST_DIGITS) -> DataFrame:
    """Exact k nearest rows: filter by code brackets, refine the survivors on full vectors."""
    spec = SearchPass(pass_no, index.vector, query_vector)
    asked = query_columns(queries, (spec,))
    table = collect_bounded(asked)
    if table is None:
        return top_k(index.catalog, queries, (spec,), k, id_col, digits=digits)
    schema = hit_schema(index.catalog, asked, id_col)
    side = _CodeSide(table, spec, index.book)
    if not side.qids:
        return top_k(index.catalog, queries, (spec,), k, id_col, digits=digits)
    upper = best_k(scan_sides(index.codes, [side], k, id_col, schema), k, id_col)
    kth = {r["qid"]: r["d"] for r in upper.groupBy("qid").agg(       # one row per query
        F.max("dist").alias("d"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
    reach = np.array([kth.get(q, np.inf) for q in side.qids]) + SLACK
    shared = index.codes.sparkSession.sparkContext.broadcast((side, reach))
    wanted = index.codes.select(id_col).schema.add("_q", T.ArrayType(T.IntegerType()))
    wanted_arrow = to_arrow_schema(wanted)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, limit = shared.value
        for batch in batches:
            if batch.num_rows:
                dist, error = s.brackets(batch)
                keep = dist - error[None, :] <= limit[:, None]
                rows = np.flatnonzero(keep.any(axis=0))
                yield pa.RecordBatch.from_pydict({
                    id_col: batch.column(id_col).take(pa.array(rows)),
                    "_q": [np.flatnonzero(keep[:, r]).astype(np.int32) for r in rows],
                }, schema=wanted_arrow)

    # one row per surviving document, never one per pair
    refined = index.codes.mapInArrow(survivors, wanted).join(
        index.catalog.select(id_col, index.vector), id_col)
    return best_k(
        scan_sides(refined, [_WantedSide(table, spec, digits)], k, id_col, schema), k, id_col)


class _WantedSide(QuerySide):
    """Exact distances, only for the queries a row was kept for."""

    def tiles(self, batch):
        for queries, rows, dist in super().tiles(batch):
            wanted = np.full((len(self.qids), len(rows)), False)
            for at, r in enumerate(rows):
                wanted[batch.column("_q")[int(r)].as_py(), at] = True
            yield queries, rows, np.where(wanted[queries], dist, np.inf)
