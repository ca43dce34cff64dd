"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm import (
    chat_format, exact_topk, hard_negatives, near_dup, packing, quality_rules, rans, resample, sentence_pieces, toxicity, url_filter, vector_codes, warc,
)
from quillmap.llm.common import read_table
from quillmap.session import scratch_dir

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
URL_GLOBS = [
    url_filter.Glob("block", "ads.*", "*"),
    url_filter.Glob("block", "*.ads.*", "*"),
    url_filter.Glob("block", "*", "*/wp-admin/*"),
    url_filter.Glob("block", "*", "*/cgi-bin/*"),
    url_filter.Glob("block", "*", "*/login*"),
    url_filter.Glob("block", "*", "*sessionid=*"),
    url_filter.Glob("block", "*", "*.exe"),
    url_filter.Glob("block", "*", "*.zip"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_and_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0, k=10, scale=1024)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(read_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    rans.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return rans.read_documents(spark, path)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read_table(spark, sf_dir, "conversations"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"), scale=1024)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"), scratch_dir(spark, "archives"), least=1000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine_hard_negatives(vectors, F.pmod("id", F.lit(50)) == 0, positives=5, negatives=3, low=50, high=95, scale=256)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dup": op2_near_dup,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_quality_resampling": op4_quality_resampling,
    "op5_exact_topk": op5_exact_topk,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op9_chat_format": op9_chat_format,
    "op10_url_filter": op10_url_filter,
    "op11_vector_codes": op11_vector_codes,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}
