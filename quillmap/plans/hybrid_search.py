"""The complete hybrid search: three retrieval passes, merge, score, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmap.operators import search as S
from quillmap.operators.ann import CellIndex, search_cells
from quillmap.session import write_scratch


def hybrid_search(
    catalog: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "doc_id",
    best_distance: bool = False,
    unknown_matches: bool = True,
    limit_per_query: int | None = None,
    max_query_rows: int | None = None,
    digits: int = S.DIST_DIGITS,
    index: dict[str, CellIndex] | None = None,
) -> DataFrame:
    """Ranked hits of every query.

    ``catalog`` needs id, doc_hash, visual, vector, domain, label, snippet, source, extra;
    ``queries`` is the output of ``prepare_queries``. The first scan reads vectors and predicate
    columns of all rows and notes where each hit lies; the second reads the wide columns of the files
    that hold one. ``index`` names stored cells by catalog vector (``ann.open_index``); passes that have one
    visit only the cells that can hold a hit, with the same result.
    """
    index = index or {}
    scanned = tuple(p for p in S.ALL_PASSES if p.catalog_vector not in index)
    located = S.with_files(catalog)
    parts = []
    if scanned:
        parts.append(S.top_k(catalog if located is None else located, queries, scanned, k, id_col, max_query_rows,
                             digits=digits, carry=[] if located is None or index else ["_file"]))
    for p in S.ALL_PASSES:
        if p not in scanned:
            parts.append(search_cells(index[p.catalog_vector], queries, p.query_vector, k, pass_no=p.pass_no,
                                      id_col=id_col, digits=digits, filtered=p.filtered))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    # texts are embedded and scanned here, in the small batches of a scratch table
    hits = write_scratch(hits, "hits")
    bound = S.MAX_BROADCAST_ROWS if max_query_rows is None else max_query_rows
    n_queries = queries.select("qid").limit(bound + 1).count()
    max_hits = n_queries * len(S.ALL_PASSES) * k if n_queries <= bound else None
    full = S.attach_payload(
        hits, catalog, ["doc_hash", "domain", "label", "snippet", "source", "extra"], id_col,
        max_hits,
    )
    merged = S.merge_passes(full, "doc_hash", id_col, best_distance)
    scored = S.score_hits(merged, queries.select("qid", "ocr_text", "f_domain"), unknown_matches)
    return S.rank_hits(scored, id_col, limit_per_query)


def respond(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Responses, one per query, also for queries that found nothing."""
    return S.compose_response(ranked, queries)


__all__ = ["hybrid_search", "respond"]
