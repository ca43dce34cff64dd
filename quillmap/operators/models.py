"""Model-assisted columns: prompts as expressions, one call per distinct prompt, tolerant parsing.

The model is a plug-in: a factory whose product maps a prompt to a reply text. It runs inside tasks,
is loaded once per task and retried there. Replies are written before they are used, so a lost
executor or a second use of the frame never repeats a call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillmap import constants as K
from quillmap.functions.text import basename, json_salvage
from quillmap.session import spread_nulls, write_scratch

Model = Callable[[str], str]

ARBITRATION = "final_domain string, confidence double, justification string"
COLUMN_MAPPING = "label_column string, image_path_column string, reason string"
REFINEMENT = "refined_label string, is_document boolean"
METADATA = ("date string, entities array<string>, keywords array<string>, summary string, "
            "confidence double")
ANSWER = "answer string, sources_used array<string>, confidence double, found boolean"
INTENT = "domain string, label string, type string"
EXTRACTION_PLAN = "type string, key string, pattern string"


def _text(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def _prompt(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- prompts ----------------------------------------------------------------

def scores_text(shortlist: Column) -> Column:
    """``name=score`` list of an array of (domain, prob)."""
    return F.array_join(F.transform(
        shortlist, lambda s: F.concat_ws("=", s["domain"], F.format_number(s["prob"], 4))), ", ")


def arbitration_prompt(path: Column, text: Column, scores: Column) -> Column:
    name = F.coalesce(basename(path), F.lit("unknown file"))
    return _prompt(
        "Decide the domain of a document.\nFILE: ", name, "\nTEXT: ",
        _text(text, K.DOMAIN_PROMPT_CHARS), "\nSCORES: ", scores,
        '\nReply in JSON: {"final_domain": string, "confidence": number, "justification": string}')


def mapping_prompt(sample: Column) -> Column:
    return _prompt(
        "Rows of a table, as JSON:\n", sample,
        "\nName the column with the main name and the column with image paths, if any."
        '\nReply in JSON: {"label_column": string, "image_path_column": string or null, '
        '"reason": string}')


def refinement_prompt(text: Column, label: Column) -> Column:
    return _prompt(
        "Give this document a label of three to five words.\nTEXT: ",
        _text(text, K.REFINE_PROMPT_CHARS), "\nCURRENT LABEL: ", F.coalesce(label, F.lit("")),
        '\nReply in JSON: {"refined_label": string, "is_document": boolean}')


def metadata_prompt(text: Column, domain: Column) -> Column:
    return _prompt(
        "You know the domain ", F.coalesce(domain, F.lit("general")),
        ". Extract date, entities, keywords and a summary.\nTEXT: ",
        _text(text, K.EXTRACT_PROMPT_CHARS),
        '\nReply in JSON: {"date": string, "entities": [], "keywords": [], "summary": string, '
        '"confidence": number}')


def intent_prompt(ocr_text: Column) -> Column:
    return _prompt(
        "What does this scanned text look for?\nTEXT: ", ocr_text,
        '\nReply in JSON: {"domain": string, "label": string, "type": string}')


def answer_prompt(question: Column, context: Column) -> Column:
    return _prompt(
        "Answer from the context only.\nCONTEXT:\n", context, "QUESTION: ", question,
        '\nReply in JSON: {"answer": string, "sources_used": [], "confidence": number, '
        '"found": boolean}')


def extraction_prompt(sample: Column, ext: Column) -> Column:
    tabular = ext.isin(".csv", ".tsv")
    return _prompt(
        "Start of a ", ext, " file:\n", sample,
        F.when(tabular, '\nWhich column holds the label?\nReply in JSON: {"type": "column", '
                        '"key": string}')
        .otherwise('\nWhere is the label: on the first line or behind a pattern?\nReply in JSON: '
                   '{"type": "txt_strategy", "key": "first_line" or "pattern", '
                   '"pattern": string or null}'))


def file_samples(records: DataFrame, rows: int = K.PLAN_SAMPLE_ROWS) -> DataFrame:
    """(file, sample): the first rows of each file as JSON lines, the input of a mapping prompt."""
    w = Window.partitionBy("file").orderBy("row_no")
    return (
        records.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
        .select("file", "_r", F.to_json("record").alias("_j"))
        .groupBy("file").agg(
            F.expr("listagg(_j, '\n') WITHIN GROUP (ORDER BY _r)").alias("sample"))
    )


def rag_context(ranked: DataFrame, chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """(qid, context): numbered blocks of the ranked hits' texts."""
    block = F.concat(
        F.lit("--- DOC ["), F.col("rank").cast("string"), F.lit("] ---\n"),
        _text(F.col("snippet"), chars), F.lit("\n\n"))
    return ranked.select("qid", "rank", block.alias("_b")).groupBy("qid").agg(
        F.expr("listagg(_b) WITHIN GROUP (ORDER BY rank)").alias("context"))


# --- calls ------------------------------------------------------------------

def call_model(
    df: DataFrame, prompt: Column, make: Callable[[], Model], schema: str, out: str = "reply",
    attempts: int = 2,
) -> DataFrame:
    """Add ``out`` (struct) and ``<out>_error`` for every row whose prompt is not NULL.

    Distinct prompts are called once. A reply that stays unreadable after ``attempts`` gives a NULL
    struct and the error; callers put their default behind it with ``coalesce``.
    """
    spark_out = "_k string, _raw string, _error string"
    keyed = df.withColumn("_prompt", prompt).withColumn(
        "_k", F.md5(F.col("_prompt").cast("binary")))
    distinct = keyed.where("_prompt IS NOT NULL").groupBy("_k").agg(
        F.any_value("_prompt").alias("_prompt"))
    arrow_out = pa.schema([(n, pa.string()) for n in ("_k", "_raw", "_error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            raws, errors = [], []
            for text in batch.column("_prompt").to_pylist():
                raw, error = None, None
                for _ in range(attempts):
                    try:
                        raw = model(text)
                        found = re.search(r"\{.*\}", raw or "", re.DOTALL)
                        json.loads(found.group(0) if found else "")
                        error = None
                        break
                    except Exception as e:        # noqa: BLE001 - the error becomes a column
                        raw, error = None, f"{type(e).__name__}: {e}"
                raws.append(raw)
                errors.append(error)
            yield pa.RecordBatch.from_pydict(
                {"_k": batch.column("_k"), "_raw": raws, "_error": errors}, schema=arrow_out)

    replies = write_scratch(distinct.mapInArrow(run, spark_out), "replies").select(
        "_k", json_salvage(F.col("_raw"), schema).alias(out), F.col("_error").alias(f"{out}_error"))
    # rows without a prompt, often most of them, must not meet in one task
    return spread_nulls(keyed, "_k", "_k").join(replies, "_k", "left").drop("_k", "_prompt")


def arbitrate_domains(df: DataFrame, make: Callable[[], Model], domains: list[str],
                      attempts: int = 2) -> DataFrame:
    """(doc_id, final_domain, confidence, justification) of rows marked ``confused``.

    ``df`` has doc_id, path, text, shortlist, confused. Replies outside the domain list are dropped.
    """
    asked = df.where("confused").select(
        "doc_id", "path", _text(F.col("text"), K.DOMAIN_PROMPT_CHARS).alias("text"), "shortlist")
    asked = write_scratch(asked, "asked")          # for the prompts and for the join; detection runs once
    replied = call_model(
        asked, arbitration_prompt(F.col("path"), F.col("text"), scores_text(F.col("shortlist"))),
        make, ARBITRATION, attempts=attempts)
    return replied.select(
        "doc_id", "reply.final_domain", "reply.confidence", "reply.justification"
    ).where(F.col("final_domain").isin([*domains, "unknown"]))


def refine_labels(df: DataFrame, make: Callable[[], Model], needs: Column, text: str = "text",
                  attempts: int = 2) -> DataFrame:
    """Replace the label of rows that need it by the model's, where it gives one."""
    prompt = F.when(needs, refinement_prompt(F.col(text), F.col("label")))
    replied = call_model(df, prompt, make, REFINEMENT, attempts=attempts)
    better = F.nullif(F.col("reply.refined_label"), F.lit(""))
    return replied.withColumn("label", F.coalesce(better, "label")).drop("reply", "reply_error")


def query_intents(queries: DataFrame, make: Callable[[], Model], attempts: int = 2) -> DataFrame:
    """(qid, domain, label, type); texts under five characters are not asked about."""
    readable = F.length(F.coalesce("ocr_text", F.lit(""))) >= K.INTENT_MIN_CHARS
    replied = call_model(queries.select("qid", "ocr_text"),
                         F.when(readable, intent_prompt(F.col("ocr_text"))), make, INTENT,
                         attempts=attempts)

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(f"reply.{name}"), F.lit("")), default).alias(name)

    unknown = F.lit("unknown")
    return replied.select(
        "qid", field("domain", unknown), field("label", unknown),
        field("type", F.when(readable, unknown).otherwise("image")))


def extract_metadata(docs: DataFrame, make: Callable[[], Model], domains: list[str],
                     attempts: int = 2) -> DataFrame:
    """(doc_id, status, meta): 'no_content' for empty texts."""
    known = F.when(F.col("domain").isin(domains), F.col("domain"))
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    replied = call_model(docs.select("doc_id", "text", "domain"),
                         F.when(has_text, metadata_prompt(F.col("text"), known)), make, METADATA,
                         out="meta", attempts=attempts)
    return replied.select(
        "doc_id", F.when(~has_text, "no_content").when(F.col("meta").isNull(), "failed")
        .otherwise("ok").alias("status"), "meta")


def map_columns(records: DataFrame, make: Callable[[], Model], attempts: int = 2) -> DataFrame:
    """(file, label_key, path_key, reason) from one sample per file."""
    replied = call_model(file_samples(records), mapping_prompt(F.col("sample")), make,
                         COLUMN_MAPPING, attempts=attempts)
    return replied.select(
        "file", F.trim(F.col("reply.label_column"), F.lit("'\" ")).alias("label_key"),
        F.col("reply.image_path_column").alias("path_key"), F.col("reply.reason").alias("reason"))


def extraction_plans(samples: DataFrame, make: Callable[[], Model], attempts: int = 2) -> DataFrame:
    """(file, type, key, pattern) from (file, ext, sample)."""
    replied = call_model(samples, extraction_prompt(F.col("sample"), F.col("ext")), make,
                         EXTRACTION_PLAN, attempts=attempts)
    return replied.select("file", "reply.type", "reply.key", "reply.pattern")


def answer_questions(ranked: DataFrame, queries: DataFrame, make: Callable[[], Model],
                     attempts: int = 2) -> DataFrame:
    """(qid, answer, found) from the ranked hits of each query; no hits, nothing found."""
    asked = queries.select("qid", F.col("ocr_text").alias("question")).join(
        rag_context(ranked), "qid", "left")
    asked = write_scratch(asked, "questions")      # one row per query, used for prompts and join
    prompt = F.when(F.col("context").isNotNull(),
                    answer_prompt(F.col("question"), F.col("context")))
    replied = call_model(asked, prompt, make, ANSWER, attempts=attempts)
    return replied.select(
        "qid", F.coalesce("reply.answer", F.lit("Not found.")).alias("answer"),
        F.coalesce("reply.found", F.lit(False)).alias("found"))
