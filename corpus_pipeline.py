"""From raw documents to packed sequences: each stage reads what the stage before it has written.

1. quality_rules: documents that a quality rule rejects go.
2. toxicity: documents that the classifier calls toxic go. It learns from ``labels`` and from the documents that are left.
3. near_dedup: of each component of near-duplicates (five-word shingles, similarity of 0.8 or more) the document of
   the smallest id stays.
4. best_fit_packing: token ids of what is left, packed into sequences of 4096.

All but the last return the columns of ``documents``. Empty tables give empty stages; rows with a null text go in the first
stage; rows without an id pass the third. ``run`` applies all stages to ``documents`` and returns the rows of the last.
SQL cannot express the trained stage, so there is no twin; tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmap.llm import near_dup, packing, quality_rules, toxicity
from quillmap.llm.common import read_table, write_scratch

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, size=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality_rules", quality), ("toxicity", clean), ("near_dedup", dedup), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_scratch(stage(spark, docs, sf_dir), name)
    return docs
