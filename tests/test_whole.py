"""Queries that answer for the whole of their tables, where ids of two tables share only a part."""

import re

import duckdb
import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"                                  # half the documents have no row of embeddings


@pytest.fixture(scope="module")
def docs():
    return {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", ["trust_score", "domain_precedence"])
def test_every_document(spark, docs, name):
    got = [r["doc_id"] for r in queries()[name](spark, SF).select("doc_id").collect()]
    assert len(got) == len(docs) and set(got) == docs


def test_archives_count_every_document(spark, docs):
    from quillmap.checks.queries import _detected_documents

    found = _detected_documents(spark, SF).select("doc_id", "archive", "probs").collect()
    assert len(found) == len(docs) and all(r["archive"] and r["probs"] for r in found)
    asked = queries()["arbitrate_domain"](spark, SF).select("doc_id").collect()
    known = {r[0] for r in duckdb.sql(f"SELECT vec_id FROM '{SF}/embeddings.parquet'").fetchall()}
    assert {r["doc_id"] for r in asked} - known


def test_short_words_are_labels(spark):
    from quillmap.constants import LABEL_MIN_LENGTH

    sf = "/root/testdata/sf0.001"
    words = {w for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()
             for w in re.split("[^a-z0-9]+", t.lower()) if len(w) >= LABEL_MIN_LENGTH}
    assert any(len(w) < 8 for w in words)
    got = {r["label"] for r in queries()["label_vectors"](spark, sf).select("label").distinct().collect()}
    assert got == words
    texts = dict(duckdb.sql(f"SELECT doc_id, lower(text) FROM '{sf}/documents.parquet'").fetchall())
    want = {k: max(((len(w), w) for w in words if w in t), default=(0, None))[1] for k, t in texts.items()}
    found = queries()["label_in_text"](spark, sf).collect()
    assert {r["doc_id"]: r["text_label"] for r in found} == want


def test_stream_keeps_all_records_of_a_file(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmap.operators import catalog as C
    from quillmap.streaming import watch as W

    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def rows_of(new):
        return C.catalog_rows(new.select("file_hash", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).select(
            "*", F.lit("x").alias("content"), *[F.lit(None).cast("array<double>").alias(c) for c in ("vector", "visual")]))

    for part in (["a", "b"], ["b", "c"]):                     # a known file is not loaded again
        spark.createDataFrame([(x,) for x in part], "file_hash string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("file_hash string").parquet(src)
        W.ingest_new(stream, out, str(tmp_path / "ck"), rows_of).awaitTermination()
    got = sorted((r["file_hash"], r["position"]) for r in C.read_catalog(spark, out).collect())
    assert got == [(x, i) for x in "abc" for i in (0, 1)]


def tables_with(path, **changed):
    """The smallest tables, some of them replaced: (select over the table's own file, as a folder or not)."""
    from quillmap.checks.fixtures import TABLES

    small = "/root/testdata/sf0.001"
    for name in TABLES:
        at = path / f"{name}.parquet"
        sql, folder = changed.get(name, (None, False))
        if sql is None:
            at.symlink_to(f"{small}/{name}.parquet")
            continue
        if folder:
            at.mkdir()
            at = at / "part-0.parquet"
        duckdb.sql(f"COPY ({sql.format(f'{small}/{name}.parquet')}) TO '{at}' (FORMAT parquet)")
    return str(path)


def test_documents_without_a_query_keep_their_row(spark, tmp_path):
    from check_oracles import compare, database

    sf = tables_with(
        tmp_path, benchmark=("SELECT 3 * item_id AS item_id, text FROM '{}'", False),
        embeddings=("SELECT * FROM '{}' WHERE vec_id % 2 = 0", False),
        documents=("SELECT * REPLACE (CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 5 THEN '' ELSE text END AS text) FROM '{}'", False))
    got = queries()["trust_score"](spark, sf).collect()
    assert {r["qid"] is None for r in got} == {True, False}
    ok, note = compare(spark, database(sf), sf, "trust_score")
    assert ok, note


def test_stream_of_a_table_in_a_folder(spark, tmp_path):
    sf = tables_with(tmp_path, documents=("SELECT * FROM '{}'", True))
    got = queries()["stream_ingest"](spark, sf).select("file_hash").collect()
    want = duckdb.sql(f"SELECT DISTINCT md5(text) FROM '{sf}/documents.parquet/*.parquet'").fetchall()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want)


def test_ranked_hits_become_ordered_responses(spark):
    from quillmap.operators.search import compose_response

    hits = [(1, r, "cars", "x", 50.0, '{"a": "1"}', f"f{r}", 0.5, 0.5, 0.0) for r in (3, 1, 10, 2)]
    ranked = spark.createDataFrame(hits, "qid bigint, rank int, domain string, label string, confidence double, extra string, "
                                         "source string, s_visual double, s_text double, s_intent double")
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid bigint, ocr_text string")
    got = {r["qid"]: r for r in compose_response(ranked, asked).collect()}
    assert [x["source_file"] for x in got[1]["results"]] == ["f1", "f2", "f3", "f10"]
    assert got[1]["results"][0]["metadata_enriched"] == {"a": "1"}
    assert (got[2]["status"], got[2]["count"], got[2]["results"]) == ("no_results", 0, None)
