"""What a task holds, and what crosses the network, does not grow with the table."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_label_similarities_come_in_tiles():
    from quillmap.operators.labels import _best_in_block

    rng = np.random.default_rng(1)
    vectors, refs = rng.normal(size=(10_000, 8)), rng.normal(size=(3_000, 8))
    keys = [("raw", f"w{i:04}") for i in range(len(refs))]
    tracemalloc.start()
    got = _best_in_block(np.arange(len(vectors)), vectors, ["raw"] * len(vectors), keys, refs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = vectors[:50] / np.linalg.norm(vectors[:50], axis=1)[:, None]
    assert len(got) == len(vectors) and [g[1] for g in got[:50]] == [keys[i][1] for i in (unit @ refs.T).argmax(axis=1)]
    assert peak < 100e6                                       # all at once: 240 MB, and as much for the rounded copy


def test_written_tables_go_through_python_in_small_batches(spark, tmp_path):
    from quillmap.operators import catalog as C
    from quillmap.session import write_scratch

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes])})

    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert write_scratch(wide.mapInArrow(sizes, "n bigint"), "sizes").agg(F.max("n")).head()[0] < 16e6
    rows = wide.mapInArrow(sizes, "n bigint").select(
        F.lit("a").alias("file_hash"), F.col("n").cast("string").alias("content"), F.lit(0).alias("position"),
        *[F.lit(None).cast("array<double>").alias(c) for c in ("vector", "visual")])
    C.append_catalog(C.catalog_rows(rows), str(tmp_path / "c"), "1")
    assert C.read_catalog(spark, str(tmp_path / "c")).agg(F.max(F.col("content").cast("bigint"))).head()[0] < 16e6


def test_search_results_are_written_before_they_are_used(spark, sf):
    """Texts are embedded and scanned in small batches, not in those of whoever reads the ranked hits."""
    from quillmap.checks import fixtures as X
    from quillmap.plans.hybrid_search import hybrid_search

    ranked = hybrid_search(X.catalog(spark, sf), X.queries(spark, sf).limit(5), 3)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan


def test_arbitration_detects_once_and_carries_prompts_only(spark):
    from quillmap.checks import fixtures as X
    from quillmap.checks.doubles import RuleModel
    from quillmap.constants import DOMAIN_PROMPT_CHARS
    from quillmap.operators.models import arbitrate_domains

    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def confused(_):
        seen.add(1)
        return True

    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.lit("a/b.txt").alias("path"), F.repeat(F.lit("word "), 5000).alias("text"),
        F.expr("array(named_struct('domain', 'd1', 'prob', 0.5D))").alias("shortlist"),
        confused.asNondeterministic()("id").alias("confused"))
    got = arbitrate_domains(docs, RuleModel, ["d1"]).collect()
    assert len(got) == 40 and {r["final_domain"] for r in got} == {"d1"}
    assert seen.value == 40
    longest = X.document_vectors(spark, "/root/testdata/sf0.01").agg(F.max(F.length("text"))).head()[0]
    assert longest == DOMAIN_PROMPT_CHARS


def test_records_of_one_file_are_classified_in_many_tasks(spark, tmp_path, monkeypatch):
    from quillmap.plans import ingest as P

    root = tmp_path / "in"
    (root / "cars").mkdir(parents=True)
    (root / "cars" / "list.csv").write_text("id,name\n" + "".join(f"{i},name {i}\n" for i in range(400)))
    seen, real = [], P.classify_documents

    def spied(docs, *args, **kw):
        seen.append(docs.groupBy(F.spark_partition_id().alias("p")).count().collect())
        return real(docs, *args, **kw)

    monkeypatch.setattr(P, "classify_documents", spied)
    P.ingest(spark, str(root), str(tmp_path / "cat"), str(tmp_path / "con"), "r", batch="1")
    counts = [r["count"] for r in seen[0]]
    assert sum(counts) == 400 and len(counts) >= 8 and max(counts) < 100
