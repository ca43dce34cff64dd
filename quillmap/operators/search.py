"""Exact vector search and hybrid ranking over many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema

from quillmap import constants as K
from quillmap.functions.text import decode_extra, grams, text_match_ratio
from quillmap.functions.vectors import fuse, list_array_to_matrix, unit_rows
from quillmap.session import MAX_BROADCAST_ROWS, collect_bounded, write_scratch

# distances are ranked at the precision of doubles; these digits only make equal vectors tie
DIST_DIGITS = 12
# distances that a task holds at a time: 16 MB
TILE_QUERIES, TILE_ROWS = 1_024, 2_048
# a sample is this part of the next one; the smallest has so many rows at least
SAMPLE_STEP, LEAST_SAMPLE = 64, 65_536
# more domains, or files with hits, than this are not named to a scan
MAX_DOMAINS, MAX_FILES = 1_000, 10_000


@dataclass(frozen=True)
class SearchPass:
    """One retrieval: which catalog vector is compared with which query vector."""

    pass_no: int
    catalog_vector: str
    query_vector: str
    filtered: bool = False     # apply the query's domain / label predicate before the distance


VISUAL_PASS = SearchPass(1, "visual", "visual")
FUSED_PASS = SearchPass(2, "vector", "vector")
LABEL_PASS = SearchPass(3, "vector", "vector", filtered=True)
ALL_PASSES = (VISUAL_PASS, FUSED_PASS, LABEL_PASS)


def intent(value: Column) -> Column:
    """A usable filter value: 'unknown' and '' mean no filter."""
    return F.when((value != "unknown") & (value != ""), value)


def has_filter() -> Column:
    return intent(F.col("f_domain")).isNotNull() | intent(F.col("f_label")).isNotNull()


class _RunningTopK:
    """Best k catalog rows per query over the batches of one task; ties go to the lower id.

    ``bound`` holds what is known of each query's k-th distance beforehand; rows beyond it are never kept.
    """

    def __init__(self, bound: np.ndarray, k: int):
        self.k = k
        self.worst = bound.copy()
        self.held = np.zeros(len(bound), dtype=np.int64)
        self.dist = np.full((len(bound), k), np.inf)
        self.at: dict[str, np.ndarray] = {}      # columns of the rows held, (queries, k)

    def add(self, queries: np.ndarray, dist: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        """``dist`` is queries x rows with inf for 'not allowed'; the first column is the sorted id."""
        limit = self.worst[queries]
        if dist.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        q, r = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
        if not len(q):
            return
        if not self.at:
            self.at = {n: np.empty((len(self.worst), self.k), dtype=c.dtype) for n, c in columns.items()}
        # both parts are cut to k before they are merged, however many rows tie
        found = dist[q, r]
        order = np.lexsort((r, found, q))
        order = order[_place(q[order]) < self.k]
        q, found = queries[q[order]], found[order]
        new = {n: c[r[order]] for n, c in columns.items()}
        touched = np.unique(q)
        had = np.arange(self.k)[None, :] < self.held[touched, None]
        q = np.concatenate([np.repeat(touched, self.held[touched]), q])
        found = np.concatenate([self.dist[touched][had], found])
        new = {n: np.concatenate([self.at[n][touched][had], c]) for n, c in new.items()}
        _, rank = np.unique(next(iter(new.values())), return_inverse=True)
        order = np.lexsort((rank, found, q))
        q = q[order]
        place = _place(q)
        kept = place < self.k
        order, q, place = order[kept], q[kept], place[kept]
        self.dist[q, place] = found[order]
        for n, c in new.items():
            self.at[n][q, place] = c[order]
        self.held[touched] = np.bincount(np.searchsorted(touched, q), minlength=len(touched))
        full = touched[self.held[touched] == self.k]
        self.worst[full] = np.minimum(self.worst[full], self.dist[full, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(query, distance, columns) of all that is held."""
        q, place = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return q, self.dist[q, place], {n: c[q, place] for n, c in self.at.items()}


def _place(q: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its query; ``q`` is sorted."""
    return np.arange(len(q)) - np.searchsorted(q, q, side="left")


class QuerySide:
    """Query vectors and predicates of one pass, as plain arrays that ship with the tasks."""

    def __init__(self, table: pa.Table, spec: SearchPass, digits: int = DIST_DIGITS):
        self.digits = digits
        rows, matrix = list_array_to_matrix(table[spec.query_vector])
        unit, ok = unit_rows(matrix)
        rows, self.unit = rows[ok], unit[ok]
        self.spec = spec
        self.groups = None
        if spec.filtered:
            domains = table["f_domain"].to_pylist()
            labels = table["f_label"].to_pylist()
            pairs = [(domains[r], labels[r]) for r in rows]
            keep = [i for i, p in enumerate(pairs) if p != (None, None)]
            rows, self.unit = rows[keep], self.unit[keep]
            self.groups = {}
            for at, i in enumerate(keep):
                self.groups.setdefault(pairs[i], []).append(at)
        self.qids = table["qid"].take(pa.array(rows, type=pa.int64())).to_pylist()
        self.bound = np.full(len(self.qids), np.inf)

    def allowed(self, batch: pa.RecordBatch | pa.Table, rows: np.ndarray
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, places in ``rows``) that may meet: all, or those of each filter."""
        if self.groups is None:
            yield np.arange(len(self.qids)), np.arange(len(rows))
            return
        in_domain: dict = {None: np.ones(len(rows), dtype=bool)}
        has_label = dict(in_domain)
        for (f_domain, f_label), members in self.groups.items():
            if f_domain not in in_domain:
                hit = pc.fill_null(pc.equal(batch.column("domain"), f_domain), False)
                in_domain[f_domain] = np.asarray(hit)[rows]
            if not in_domain[f_domain].any():
                continue
            if f_label not in has_label:
                hit = pc.fill_null(pc.match_substring(batch.column("label"), f_label), False)
                has_label[f_label] = np.asarray(hit)[rows]
            at = np.flatnonzero(in_domain[f_domain] & has_label[f_label])
            if len(at):
                yield np.array(members), at

    def tiles(self, batch: pa.RecordBatch | pa.Table
              ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, row numbers of the batch, their cosine distances), a bounded tile at a time."""
        rows, matrix = list_array_to_matrix(batch.column(self.spec.catalog_vector),
                                            self.unit.shape[1])
        unit, ok = unit_rows(matrix)
        rows, unit = rows[ok], unit[ok]
        for members, at in self.allowed(batch, rows):
            for i in range(0, len(members), TILE_QUERIES):
                some = members[i:i + TILE_QUERIES]
                for j in range(0, len(at), TILE_ROWS):
                    here = at[j:j + TILE_ROWS]
                    yield some, rows[here], np.round(1.0 - self.unit[some] @ unit[here].T, self.digits) + 0.0


def _sorted_ids(batch, id_col: str):
    ids = np.asarray(batch.column(id_col).to_numpy(zero_copy_only=False)
                     if isinstance(batch, pa.RecordBatch) else batch.column(id_col).to_numpy())
    order = np.argsort(ids, kind="stable")
    return ids, order


def _scan_block(batches, sides: list[QuerySide], k: int, carried: list[str]):
    """Running top-k of every pass over the batches of one task; ``carried``: the id and what comes along."""
    tops = [_RunningTopK(s.bound, k) for s in sides]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, order = _sorted_ids(batch, carried[0])
        batch = batch.take(pa.array(order))
        columns = {carried[0]: ids[order]}
        for name in carried[1:]:
            columns[name] = np.asarray(batch.column(name).to_numpy(zero_copy_only=False))
        for side, top in zip(sides, tops):
            if side.qids:
                for queries, rows, dist in side.tiles(batch):
                    top.add(queries, dist, {n: c[rows] for n, c in columns.items()})
    out = {name: [] for name in ("pass_no", "qid", *carried, "dist")}
    for side, top in zip(sides, tops):
        q, dist, columns = top.rows()
        if len(q):
            out["pass_no"] += [side.spec.pass_no] * len(q)
            out["qid"] += [side.qids[i] for i in q]
            out["dist"] += dist.tolist()
            for name in carried:
                out[name] += columns[name].tolist()
    return out


def hit_schema(catalog: DataFrame, queries: DataFrame, id_col: str, carry: list[str] = ()) -> T.StructType:
    return T.StructType([
        T.StructField("pass_no", T.IntegerType()),
        T.StructField("qid", queries.schema["qid"].dataType),
        *[T.StructField(c, catalog.schema[c].dataType) for c in (id_col, *carry)],
        T.StructField("dist", T.DoubleType()),
    ])


def _columns(passes, id_col: str) -> tuple[list[str], list[str]]:
    cat = [id_col] + sorted({p.catalog_vector for p in passes})
    qry = ["qid"] + sorted({p.query_vector for p in passes})
    if any(p.filtered for p in passes):
        cat += ["domain", "label"]
        qry += ["f_domain", "f_label"]
    return cat, qry


def query_columns(queries: DataFrame, passes=ALL_PASSES) -> DataFrame:
    """Only what the retrieval reads of the queries, with 'unknown' filters as NULL."""
    _, wanted = _columns(passes, "-")
    picked = queries
    if "f_domain" in wanted:
        picked = picked.withColumns(
            {"f_domain": intent(F.col("f_domain")), "f_label": intent(F.col("f_label"))}
        )
    return picked.select(*wanted)


def top_k(
    catalog: DataFrame,
    queries: DataFrame,
    passes=ALL_PASSES,
    k: int = 10,
    id_col: str = "doc_id",
    max_query_rows: int | None = None,
    block_queries: int = MAX_BROADCAST_ROWS // 2,
    digits: int = DIST_DIGITS,
    carry: list[str] = (),
    least_sample: int = LEAST_SAMPLE,
) -> DataFrame:
    """Exact k nearest catalog rows per query and pass: (pass_no, qid, id, carried columns, dist, rk).

    All passes share one scan that reads the id, the vectors and the predicate columns only. Samples
    of the catalog, each ``SAMPLE_STEP`` times as large as the one before, first bound every query's
    k-th distance, and tasks send on only rows within the bound: about ``SAMPLE_STEP`` x k a query,
    however many tasks there are. Distances are made in tiles, so a task's memory does not depend on the
    number of queries. Queries ship with the tasks when they are within the broadcast bounds; more of
    them go block by block, each in a scan of its own, and the catalog is never shuffled.
    """
    cat_cols, _ = _columns(passes, id_col)
    asked = query_columns(queries, passes)
    slim = catalog.select(*cat_cols, *carry)
    schema = hit_schema(slim, asked, id_col, carry)
    table = collect_bounded(asked, max_query_rows)
    tables = [table] if table is not None else query_blocks(asked, block_queries)
    samples, found = None, []
    for block in tables:
        sides = [QuerySide(block, p, digits) for p in passes]
        if not any(s.qids for s in sides):
            continue
        if samples is None:
            samples = sample_levels(slim, id_col, least_sample)
        scan = _in_domains(slim, sides)
        for sample in samples:
            tighten(sides, scan_sides(_in_domains(sample, sides), sides, k, id_col, schema, carry), k, digits)
        hits = scan_sides(scan, sides, k, id_col, schema, carry)
        found.append(hits if table is not None else write_scratch(hits, "hits"))
    if not found:
        found = [catalog.sparkSession.createDataFrame([], schema)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return best_k(hits, k, id_col)


def sample_levels(slim: DataFrame, id_col: str, least: int = LEAST_SAMPLE) -> list[DataFrame]:
    """Samples by a hash of the id, the smallest first, each a written ``SAMPLE_STEP``-th of the next.

    None for catalogs of fewer than ``SAMPLE_STEP`` times the least sample.
    """
    levels, rows, total = [], slim, slim.count()
    while total >= least * SAMPLE_STEP:
        step = SAMPLE_STEP ** (len(levels) + 1)
        rows = write_scratch(rows.where(F.pmod(F.xxhash64(F.lit(id_col), id_col), F.lit(step)) == 0), "sample")
        levels.insert(0, rows)
        total //= SAMPLE_STEP
    return levels


def tighten(sides: list[QuerySide], hits: DataFrame, k: int, digits: int) -> None:
    """Lower each query's bound to its k-th distance among ``hits`` of a part of the catalog."""
    kth = best_k(hits, k, hits.columns[2]).where(F.col("rk") == k).select("pass_no", "qid", "dist").collect()
    of = {(r["pass_no"], r["qid"]): r["dist"] for r in kth}    # a row per query of a bounded block
    slack = 2 * 10.0 ** -digits                                # the same distance may be rounded apart
    for side in sides:
        new = np.array([of.get((side.spec.pass_no, q), np.inf) for q in side.qids]) + slack
        side.bound = np.minimum(side.bound, new)


def query_blocks(asked: DataFrame, rows: int) -> Iterator[pa.Table]:
    """The queries in Arrow tables within the broadcast bounds, about ``rows`` in each.

    A block with too many bytes is halved. Rows are dealt by their place in a written table, so
    queries that share an id cannot make a block hot.
    """
    asked = write_scratch(asked.withColumn("_slot", F.xxhash64(F.monotonically_increasing_id())), "queries")
    n = max(1, math.ceil(asked.count() / max(1, rows)))
    left = [(n, i) for i in range(n)]
    while left:
        n, i = left.pop()
        if n > 1 << 40:
            raise ValueError("a query is too large to be shipped")
        table = collect_bounded(asked.where(F.pmod("_slot", F.lit(n)) == i).drop("_slot"))
        if table is None:
            left += [(2 * n, i), (2 * n, i + n)]
        elif table.num_rows:
            yield table


def _in_domains(slim: DataFrame, sides: list[QuerySide]) -> DataFrame:
    """Only the domains asked for, if every pass filters by one; prunes a catalog that is laid out by domain."""
    if any(s.groups is None for s in sides):
        return slim
    domains = {d for s in sides for d, _ in s.groups}
    if None in domains or len(domains) > MAX_DOMAINS:
        return slim
    return slim.where(F.col("domain").isin(sorted(domains)))


def best_k(hits: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Global cut of task-local hits, per pass and query; Spark cuts on the map side as well."""
    w = Window.partitionBy("pass_no", "qid").orderBy("dist", id_col)
    return hits.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def scan_sides(slim: DataFrame, sides: list[QuerySide], k: int, id_col: str,
               schema: T.StructType, carry: list[str] = ()) -> DataFrame:
    """Task-local top-k of every side over one scan."""
    shared = slim.sparkSession.sparkContext.broadcast(sides)
    arrow_schema = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict(
            _scan_block(batches, shared.value, k, [id_col, *carry]), schema=arrow_schema
        )

    return slim.mapInArrow(scan, schema)


def visual_top_k(catalog: DataFrame, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Nearest rows by the image vector; rows without an image take no part."""
    return top_k(catalog, queries, (VISUAL_PASS,), k, **kw)


def fused_top_k(catalog: DataFrame, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
    return top_k(catalog, queries, (FUSED_PASS,), k, **kw)


def filtered_top_k(catalog: DataFrame, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Nearest rows by the fused vector among those that meet the query's predicate."""
    return top_k(catalog, queries, (LABEL_PASS,), k, **kw)


# --- merge, score, rank -----------------------------------------------------

def with_files(catalog: DataFrame) -> DataFrame | None:
    """The catalog with the file of each row as ``_file``; None if it is not a plain scan of files."""
    try:
        return catalog.withColumn("_file", F.col("_metadata.file_path"))
    except AnalysisException:
        return None


def attach_payload(
    hits: DataFrame, catalog: DataFrame, columns: list[str], id_col: str = "doc_id",
    max_hits: int | None = None,
) -> DataFrame:
    """Bring catalog columns to the hits; only now are wide columns read.

    Hits that carry the ``_file`` they were found in name the files to be read; up to ``MAX_FILES`` of
    them prune the scan. ``max_hits`` is the proven size of the hits (queries x passes x k): within the
    broadcast bound the hits travel to the catalog scan, beyond it Catalyst joins by shuffle.
    """
    payload = catalog
    if "_file" in hits.columns:
        files = collect_bounded(hits.select("_file").distinct(), MAX_FILES)
        if files is not None:
            payload = catalog.where(F.col("_metadata.file_path").isin(files["_file"].to_pylist()))
        hits = hits.drop("_file")
    payload = payload.select(id_col, *columns)
    if max_hits is not None and max_hits <= MAX_BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return payload.join(hits, id_col)


def merge_passes(
    hits: DataFrame, hash_col: str = "doc_hash", id_col: str = "doc_id",
    best_distance: bool = False,
) -> DataFrame:
    """One row per (query, document hash): the first pass wins, or the best distance."""
    keys = ["dist", "pass_no"] if best_distance else ["pass_no", "rk"]
    w = Window.partitionBy("qid", hash_col).orderBy(*keys, id_col)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trust_columns(
    dist: Column, ocr_text: Column, target: Column, domain: Column, f_domain: Column,
    unknown_matches: bool = True,
) -> dict[str, Column]:
    """The three proofs and their weighted mean in percent.

    Without query text its weight leaves the sum. 'unknown' equals 'unknown' unless
    ``unknown_matches`` is off.
    """
    has_text = F.coalesce(ocr_text, F.lit("")) != ""
    visual = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.coalesce(dist, F.lit(1.0))))
    textual = F.when(has_text, text_match_ratio(ocr_text, target)).otherwise(F.lit(0.0))
    same = F.coalesce(domain == f_domain, F.lit(False))
    if not unknown_matches:
        same = same & (domain != "unknown")
    return {
        "s_visual": visual,
        "s_text": textual,
        "s_intent": F.when(same, 1.0).otherwise(0.0),
        "_w_text": F.when(has_text, K.WEIGHT_TEXT).otherwise(0.0),
    }


def trust_score(scored: DataFrame) -> DataFrame:
    """``confidence_raw`` in percent from the columns of ``trust_columns``."""
    total = F.lit(K.WEIGHT_VISUAL + K.WEIGHT_INTENT) + F.col("_w_text")
    weighted = (
        F.col("s_visual") * K.WEIGHT_VISUAL
        + F.col("s_text") * F.col("_w_text")
        + F.col("s_intent") * K.WEIGHT_INTENT
    )
    return scored.withColumn("confidence_raw", weighted / total * 100).drop("_w_text")


def score_hits(merged: DataFrame, queries: DataFrame, unknown_matches: bool = True) -> DataFrame:
    """Add the trust score; ``merged`` carries label, snippet and domain of the hits.

    The join has no hint: query texts have no size bound of their own, so their measured size
    decides, and the scoring stays spread as the hits are. A hit whose query is not among ``queries``
    keeps its row and is scored without query text and domain.
    """
    asked = queries.select(
        "qid", "ocr_text", F.coalesce(F.col("f_domain"), F.lit("unknown")).alias("_f_domain")
    )
    target = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("snippet", F.lit("")))
    cols = trust_columns(
        F.col("dist"), F.col("ocr_text"), target, F.col("domain"), F.col("_f_domain"),
        unknown_matches,
    )
    joined = merged.join(asked, "qid", "left")
    return trust_score(joined.withColumns(cols)).drop("_f_domain")


def rank_hits(scored: DataFrame, id_col: str = "doc_id", limit_per_query: int | None = None
              ) -> DataFrame:
    """Order by confidence; equal scores keep pass order, then distance order."""
    ranked = scored.withColumns({
        "confidence": F.round("confidence_raw", 2),
        "_key": F.round("confidence_raw", 4),
    })
    w = Window.partitionBy("qid").orderBy(F.desc("_key"), "pass_no", "rk", id_col)
    ranked = ranked.withColumn("rank", F.row_number().over(w)).drop("_key")
    return ranked if limit_per_query is None else ranked.where(F.col("rank") <= limit_per_query)


def compose_response(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: status, query text, count and the ordered result structs."""
    entry = F.struct(
        F.col("rank"),
        F.coalesce("domain", F.lit("unknown")).alias("domain"),
        F.coalesce("label", F.lit("unknown")).alias("label"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence_score"),
        decode_extra(F.col("extra")).alias("metadata_enriched"),
        F.coalesce("source", F.lit("unknown")).alias("source_file"),
        F.struct("s_visual", "s_text", "s_intent").alias("match_details"),
    )
    # entries hold a map, which has no order of its own; a query's ranks are distinct
    grouped = ranked.groupBy("qid").agg(F.array_sort(
        F.collect_list(entry), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("results"))
    return (
        queries.select("qid", F.col("ocr_text").alias("query_ocr"))
        .join(grouped, "qid", "left")
        .select(
            "qid",
            F.when(F.col("results").isNull(), "no_results").otherwise("success").alias("status"),
            "query_ocr",
            F.coalesce(F.size("results"), F.lit(0)).alias("count"),
            "results",
        )
    )


# --- queries ----------------------------------------------------------------

def prepare_queries(
    raw: DataFrame, visual: Column, ocr_text: Column, text_vector: Column,
    f_domain: Column, f_label: Column,
) -> DataFrame:
    """(qid, visual, vector, ocr_text, f_domain, f_label) from raw query rows.

    The intent counts only for texts of at least five characters; the fused vector is the mean of
    the text and image vectors that exist.
    """
    readable = F.length(ocr_text) >= K.INTENT_MIN_CHARS
    unknown = F.lit("unknown")
    return (
        raw.withColumns({"_txt": text_vector, "_img": visual})
        .select(
            "qid",
            F.col("_img").cast("array<double>").alias("visual"),
            fuse(F.col("_txt"), F.col("_img")).alias("vector"),
            F.coalesce(ocr_text, F.lit("")).alias("ocr_text"),
            F.when(readable, F.coalesce(f_domain, unknown)).otherwise(unknown).alias("f_domain"),
            F.when(readable, F.coalesce(f_label, unknown)).otherwise(unknown).alias("f_label"),
        )
    )


# --- predicate alone --------------------------------------------------------

def count_matching(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n): catalog rows that meet each query's predicate, for queries that have one.

    Rows are first reduced to (domain, label) counts and queries to distinct filters. Which labels
    contain which filter text is decided once per distinct label; the rest are equi-joins.
    """
    cells = catalog.groupBy("domain", "label").agg(F.count("*").alias("n"))
    asked = queries.select(
        "qid", intent(F.col("f_domain")).alias("f_domain"),
        intent(F.col("f_label")).alias("f_label"))
    contained = labels_containing(cells.select("label").distinct(),
                                  asked.select("f_label").where("f_label IS NOT NULL").distinct())
    by_text = cells.join(contained, "label")
    both = by_text.groupBy(F.col("domain").alias("f_domain"), "f_label").agg(F.sum("n").alias("n"))
    domain_only = cells.groupBy(F.col("domain").alias("f_domain")).agg(F.sum("n").alias("n"))
    label_only = by_text.groupBy("f_label").agg(F.sum("n").alias("n"))
    has_d, has_l = F.col("f_domain").isNotNull(), F.col("f_label").isNotNull()
    parts = [
        asked.where(has_d & has_l).join(both, ["f_domain", "f_label"], "left"),
        asked.where(has_d & ~has_l).join(domain_only, "f_domain", "left"),
        asked.where(~has_d & has_l).join(label_only, "f_label", "left"),
    ]
    out = None
    for part in parts:
        one = part.select("qid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


def labels_containing(labels: DataFrame, needles: DataFrame) -> DataFrame:
    """(label, f_label) for every needle that is a substring of a label.

    Every substring of a label that has the length of some needle is looked up by an equi-join;
    labels are short names, so the fan-out is a few rows per distinct label.
    """
    lengths = needles.agg(F.collect_set(F.length("f_label")).alias("n")).head()["n"]
    if not lengths:
        return labels.select("label", F.lit(None).cast("string").alias("f_label")).where("false")
    parts = [grams(F.col("label"), n) for n in lengths]
    cut = labels.select(
        "label", F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("f_label"))
    return cut.join(needles, "f_label")
