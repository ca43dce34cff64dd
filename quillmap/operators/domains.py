"""Domain classification: centroids, fused scores, softmax, short list, precedence."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap import constants as K
from quillmap.functions.embedders import HashingTextEmbedder, embed_text
from quillmap.functions.text import basename, schema_text
from quillmap.functions.vectors import (
    arrow_once,
    l2_normalize,
    list_array_to_matrix,
    matrix_to_list_array,
    unit_rows,
)
from quillmap.session import collect_bounded


def domain_prompts(spark: SparkSession, domains: list[str]) -> DataFrame:
    """(domain, seq, prompt): every template filled with every domain name."""
    rows = [(d, i, t.format(d)) for i, d in enumerate(domains) for t in K.DOMAIN_PROMPTS]
    return spark.createDataFrame(rows, "domain string, seq int, prompt string")


def domain_centroids(prototypes: DataFrame, key: str = "domain", vector: str = "vector"
                     ) -> DataFrame:
    """(key, centroid): normalised mean of the prototype vectors of each key.

    Means are taken per (key, position), so partial sums leave the map side with at most
    keys x dimensions rows and no key is gathered before it is reduced.
    """
    means = (
        prototypes.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x"))
        .groupBy(key, "p").agg(F.avg("x").alias("x"))
    )
    ordered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c"))
    return ordered.select(key, l2_normalize(F.transform("c", lambda s: s["x"])).alias("centroid"))


def prompt_centroids(
    spark: SparkSession, domains: list[str], make: Callable = HashingTextEmbedder
) -> DataFrame:
    """Centroids of the domains from their prompts, with the prompt embedder plugged in."""
    prompts = domain_prompts(spark, domains).withColumn("vector", embed_text(F.col("prompt"), make))
    return domain_centroids(prompts)


def reference_matrix(
    refs: DataFrame, key: str, vector: str, order: list | None = None
) -> tuple[list, np.ndarray] | None:
    """Names and their matrix; None when the table is too large to ship.

    With ``order`` the rows are those of a list that the caller holds already, so its size is the bound.
    Names follow ``order`` where given (the first of equals wins), else the alphabet.
    """
    chosen = refs.select(key, vector).orderBy(key)
    table = collect_bounded(chosen) if order is None else chosen.toArrow()
    if table is None:
        return None
    rows, matrix = list_array_to_matrix(table[vector])
    names = table[key].to_pylist()
    names = [names[i] for i in rows]
    if order is not None:
        by_rank = sorted(range(len(names)), key=lambda i: order.index(names[i]))
        names, matrix = [names[i] for i in by_rank], matrix[by_rank]
    return names, matrix


def context_text(path: Column, record_json: Column | None = None) -> Column:
    """File name and record keys as words: the text behind the context vector."""
    parts = [F.translate(basename(path), "_-", "  ")]
    if record_json is not None:
        parts.append(schema_text(record_json))
    return F.concat_ws(" ", *parts)


def _score_kernel(refs: np.ndarray, context_weight: float, content_weight: float, factor: float):
    unit_refs, _ = unit_rows(np.asarray(refs, dtype=np.float64))
    n_refs, dim = unit_refs.shape

    def one_side(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, matrix = list_array_to_matrix(vectors, dim)
        unit, ok = unit_rows(matrix)
        scores = np.zeros((len(vectors), n_refs))
        scores[rows[ok]] = unit[ok] @ unit_refs.T
        known = np.zeros(len(vectors), dtype=bool)
        known[rows[ok]] = True
        return scores, known

    def scores(context: pa.Array, content: pa.Array) -> pa.Array:
        ctx, has_ctx = one_side(context)
        doc, has_doc = one_side(content)
        logits = factor * (context_weight * ctx + content_weight * doc)
        weights = np.exp(logits - logits.max(axis=1, keepdims=True))
        probs = weights / weights.sum(axis=1, keepdims=True)
        n = len(context)
        some = np.flatnonzero(has_ctx | has_doc)
        return pa.StructArray.from_arrays(
            [
                matrix_to_list_array(np.flatnonzero(has_ctx), ctx[has_ctx], n),
                matrix_to_list_array(np.flatnonzero(has_doc), doc[has_doc], n),
                matrix_to_list_array(some, probs[some], n),
                # nine digits: equal evidence must tie exactly, then the first domain wins
                pa.array(np.round(ctx, 9).argmax(axis=1).astype(np.int32)),
                pa.array(np.round(probs, 9).argmax(axis=1).astype(np.int32)),
            ],
            names=["context", "content", "probs", "best_context", "best"],
        )

    return arrow_once(
        scores, "struct<context:array<double>,content:array<double>,probs:array<double>,"
                "best_context:int,best:int>")


def domain_scores(
    context: Column, content: Column, refs: np.ndarray,
    context_weight: float = K.CONTEXT_WEIGHT, content_weight: float = K.CONTENT_WEIGHT,
    factor: float = K.SOFTMAX_FACTOR,
) -> Column:
    """Context cosines, content cosines and the softmax of their weighted sum, per domain.

    A missing side scores zero; when both are missing the probabilities are NULL. One matrix
    product per Arrow batch, nothing is shuffled.
    """
    return _score_kernel(refs, context_weight, content_weight, factor)(context, content)


def detect_domains(
    df: DataFrame,
    names: list[str],
    refs: np.ndarray,
    context: Column,
    content: Column,
    force_threshold: float = K.CONTEXT_FORCE_THRESHOLD,
    gap: float = K.SHORTLIST_GAP,
    floor: float = K.SHORTLIST_FLOOR,
    low_confidence: float = K.LOW_CONFIDENCE,
    rejection: float = K.REJECTION,
) -> DataFrame:
    """Add det_domain, det_score, det_method, probs, max_prob, shortlist and confused."""
    labels = F.array(*[F.lit(n) for n in names])
    scored = df.withColumn("_s", domain_scores(context, content, refs))
    scored = scored.withColumns({
        "probs": F.col("_s.probs"),
        "max_prob": F.array_max("_s.probs"),
        "_ctx": F.array_max("_s.context"),
    })
    best = F.get(labels, F.col("_s.best"))
    forced = F.get(labels, F.col("_s.best_context"))
    pairs = F.zip_with(labels, F.col("probs"), lambda d, p: F.struct(d.alias("domain"),
                                                                     p.alias("prob")))
    near = F.filter(
        pairs, lambda s: ((F.col("max_prob") - s["prob"]) < gap) & (s["prob"] > floor))
    is_forced = F.coalesce(F.col("_ctx") > force_threshold, F.lit(False))
    rejected = F.coalesce(F.col("max_prob") < rejection, F.lit(True))
    out = scored.withColumns({
        "shortlist": F.transform(
            near, lambda s: F.struct(s["domain"].alias("domain"),
                                     F.round(s["prob"], 4).alias("prob"))),
        "det_domain": F.when(is_forced, forced).when(rejected, "unknown").otherwise(best),
        "det_score": F.when(is_forced, F.col("_ctx")).when(rejected, 0.0)
        .otherwise(F.col("max_prob")),
        "det_method": F.when(is_forced, "structural_context_forced")
        .when(rejected, "low_confidence_rejection").otherwise("semantic_fusion"),
    })
    confused = (F.col("max_prob") < low_confidence) | (F.size("shortlist") > 1)
    return out.withColumn("confused", ~is_forced & F.coalesce(confused, F.lit(True))).drop(
        "_s", "_ctx")


def resolve_precedence(
    docs: DataFrame,
    contracts: DataFrame,
    decisions: DataFrame | None = None,
    session: DataFrame | None = None,
    arbitrate_below: float = K.ARBITRATION_BELOW,
) -> DataFrame:
    """Contract, then session decision, then detection (replaced by an arbitration result).

    ``docs`` has doc_id, archive, det_domain, det_score, det_method. ``contracts`` is keyed by
    folder_path, ``session`` by archive (domain, score), ``decisions`` by doc_id (final_domain,
    confidence, justification). A session with ``since`` counts only for documents whose ``seq`` is later.
    """
    known = contracts.where(F.col("assigned_domain") != "unknown").select(
        F.col("folder_path").alias("archive"), F.col("assigned_domain").alias("_c_domain"),
        F.col("confidence").cast("double").alias("_c_score"))
    out = docs.join(known, "archive", "left")
    if session is not None:
        ordered = "since" in session.columns
        out = out.join(session.select(
            "archive", F.col("domain").alias("_s_domain"), F.col("score").cast("double").alias("_s_score"),
            *([F.col("since").alias("_since")] if ordered else [])), "archive", "left")
        if ordered:
            later = F.col("seq") > F.col("_since")
            out = out.withColumns({c: F.when(later, F.col(c)) for c in ("_s_domain", "_s_score")})
    else:
        out = out.withColumns({"_s_domain": F.lit(None).cast("string"),
                               "_s_score": F.lit(None).cast("double")})
    if decisions is not None:
        out = out.join(decisions.select("doc_id", F.col("final_domain").alias("_a_domain"),
                                        F.col("confidence").alias("_a_score"), "justification"),
                       "doc_id", "left")
    else:
        out = out.withColumns({"_a_domain": F.lit(None).cast("string"),
                               "_a_score": F.lit(None).cast("double"),
                               "justification": F.lit(None).cast("string")})
    has_c, has_s = F.col("_c_domain").isNotNull(), F.col("_s_domain").isNotNull()
    asks = F.col("det_score") < arbitrate_below
    ruled = asks & F.col("_a_domain").isNotNull()
    return out.select(
        *[c for c in docs.columns],
        F.when(has_c, F.col("_c_domain")).when(has_s, F.col("_s_domain"))
        .when(ruled, F.col("_a_domain")).otherwise(F.col("det_domain")).alias("domain"),
        F.when(has_c | has_s, 1.0)
        .when(ruled, F.coalesce("_a_score", "det_score")).otherwise(F.col("det_score"))
        .alias("domain_score"),
        F.when(has_c, F.col("_c_score")).when(has_s, F.col("_s_score"))
        .when(ruled, F.coalesce("_a_score", "det_score")).otherwise(F.col("det_score"))
        .alias("actual_score"),
        F.when(has_c, "contract_trust").when(has_s, "session_cache")
        .when(ruled, "model_arbitration").otherwise(F.col("det_method")).alias("method"),
        F.when(~has_c & ~has_s & ruled, F.col("justification")).alias("justification"),
        (~has_c & ~has_s & asks).alias("needs_arbitration"),
    )


def session_decisions(arbitrated: DataFrame) -> DataFrame:
    """(archive, domain, score, since): the first arbitrated document (by seq) of each archive decides for
    those behind it."""
    return arbitrated.groupBy("archive").agg(
        F.min_by(F.struct("domain", "score", F.col("seq").alias("since")), "seq").alias("_d")
    ).select("archive", "_d.domain", "_d.score", "_d.since")


def archive_domain(docs: DataFrame, mode: str = "last") -> DataFrame:
    """(archive, domain, score): the last known domain by seq, or the most frequent one."""
    known = F.col("domain") != "unknown"
    if mode == "last":
        picked = docs.groupBy("archive").agg(
            F.max_by(F.when(known, F.struct("domain", "score")),
                     F.when(known, F.col("seq"))).alias("_d"))
    else:
        counts = docs.groupBy("archive", "domain").agg(
            F.count("*").alias("n"), F.max("score").alias("score"))
        picked = counts.groupBy("archive").agg(
            F.max_by(F.when(known, F.struct("domain", "score")),
                     F.when(known, F.struct("n", "domain"))).alias("_d"))
    return picked.select(
        "archive",
        F.coalesce("_d.domain", F.lit("unknown")).alias("domain"),
        F.coalesce("_d.score", F.lit(0.0)).alias("score"),
    )
