"""Each stage against brute force on what the stage before it has kept, and awkward rows through all of them."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillmap.llm import quality_rules, toxicity
from tests.llm.helpers import near_dup_brute
from tests.llm.test_tokens import check_packed, pack_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", None, 0), (900_002, "", None, "x", None), (None, docs.first()["text"], "en", "x", 1)], docs.schema)
    again = docs.where("doc_id % 17 = 0")
    docs = P.write_scratch(docs.unionByName(odd).unionByName(again), "input")
    for name, stage in P.STAGES[:-1]:
        before = docs.collect()
        docs = P.write_scratch(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS
        after = docs.collect()
        if name == "quality_rules":
            rules = [*quality_rules.BASE_RULES, *quality_rules.MORE_RULES]
            want = [r for r in before if quality_rules.first_rejection({"text": r.text or ""}, rules) is None]
        elif name == "toxicity":
            scores = {(r.doc_id): r.score for r in toxicity.score_documents(
                P.read_table(spark, sf, "documents"), toxicity.fit(P.write_scratch(spark.createDataFrame(before, docs.schema), "b"), P.read_table(spark, sf, "labels"))).collect()}
            want = [r for r in before if r.doc_id is None or scores[r.doc_id] < 0.5]
        else:
            parts = near_dup_brute([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            want = [r for r in before if r.doc_id is None] + list({r.doc_id: r for r in before if r.doc_id is not None and parts[r.doc_id][1] == r.doc_id}.values())
        assert 0 < len(after) <= len(before)
        assert sorted(map(repr, after)) == sorted(map(repr, want)), name
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == pack_brute([(r.doc_id, r.text) for r in docs.collect()], path, 1, 4096)
    assert check_packed(packed, 4096) <= -(-sum(r.length for r in packed) // 4096) + 1


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in P.STAGES:
        docs = P.write_scratch(stage(spark, docs, sf), "stage")
        assert docs.count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
