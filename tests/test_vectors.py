"""Second implementations: numpy brute force against scans, grids and indexes."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.functions import vectors as V
from quillmap.operators import ann as A
from quillmap.operators import explore as N
from quillmap.operators import labels as L
from quillmap.operators import search as S
from quillmap.session import collect_bounded


@pytest.fixture(scope="module")
def data(spark):
    """Clustered vectors with a third of the rows being copies of one vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    rows = centres[rng.integers(0, 10, 900)] + 0.1 * rng.normal(size=(900, 16))
    rows[600:] = rows[0]
    asks = np.vstack([rows[[0, 50, 300]], rng.normal(size=(4, 16)), np.zeros((1, 16))])
    catalog = spark.createDataFrame(
        [(i, v.tolist(), f"d{i % 3}", "en" if i % 2 else "fr") for i, v in enumerate(rows)],
        "doc_id bigint, vector array<double>, domain string, label string").repartition(5)
    queries = spark.createDataFrame(
        [(q, v.tolist(), "d1" if q % 2 else "unknown", "e" if q % 3 else "unknown")
         for q, v in enumerate(asks)],
        "qid bigint, vector array<double>, f_domain string, f_label string")
    return rows, asks, catalog, queries


def brute(rows, asks, k, allowed=lambda q, i: True):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    out = set()
    for q, a in enumerate(asks):
        if not np.linalg.norm(a):
            continue
        d = np.round(1 - unit @ (a / np.linalg.norm(a)), 6)
        best = sorted((x, i) for i, x in enumerate(d) if allowed(q, i))[:k]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(best)}
    return out


def found(df):
    return {(r["qid"], r["doc_id"], r["rk"]) for r in df.collect()}


def test_scan_and_grid(data):
    rows, asks, catalog, queries = data
    want = brute(rows, asks, 7)
    assert found(S.fused_top_k(catalog, queries, 7)) == want
    assert found(S.fused_top_k(catalog, queries, 7, max_query_rows=2, block_queries=3)) == want


def test_filtered_pass(data):
    rows, asks, catalog, queries = data

    def allowed(q, i):
        filters = (q % 2, q % 3)
        return any(filters) and (not q % 2 or i % 3 == 1) and (not q % 3 or i % 2 == 1)

    want = brute(rows, asks, 5, allowed)
    assert found(S.filtered_top_k(catalog, queries, 5)) == want
    assert found(S.filtered_top_k(catalog, queries, 5, max_query_rows=2, block_queries=4)) == want
    assert found(S.filtered_top_k(catalog, queries, 5, least_sample=3)) == want


def test_bounds_from_samples(data, spark, monkeypatch):
    """Bounded tasks send on few rows, however many tasks there are, and lose none of the nearest."""
    rows, asks, catalog, queries = data
    monkeypatch.setattr(S, "SAMPLE_STEP", 4)
    levels = S.sample_levels(catalog.select("doc_id", "vector"), "doc_id", 20)
    sizes = [df.count() for df in levels]
    assert len(sizes) == 2 and sizes == sorted(sizes) and sizes[-1] < 450
    assert S.sample_levels(catalog.select("doc_id", "vector"), "doc_id", 300) == []
    for k in (1, 7):
        assert found(S.fused_top_k(catalog, queries, k, least_sample=20)) == brute(rows, asks, k)
    side = S.QuerySide(queries.select("qid", "vector").toArrow(), S.FUSED_PASS)
    slim = catalog.repartition(60).select("doc_id", "vector")
    schema = S.hit_schema(slim, queries, "doc_id")
    free = S.scan_sides(slim, [side], 3, "doc_id", schema).count()
    for level in levels:
        S.tighten([side], S.scan_sides(level, [side], 3, "doc_id", schema), 3, S.DIST_DIGITS)
    bounded = S.scan_sides(slim, [side], 3, "doc_id", schema).count()
    assert np.isfinite(side.bound).all() and bounded < free / 2


def test_tiles_bound_a_tasks_memory(spark, monkeypatch):
    """20,000 queries against one batch: the distances of all of them are never held together."""
    rng = np.random.default_rng(3)
    asks, rows = rng.normal(size=(20_000, 4)), rng.normal(size=(5_000, 4))
    table = pa.table({"qid": np.arange(len(asks)), "vector": pa.array(list(asks))})
    batch = pa.table({"doc_id": np.arange(len(rows)), "vector": pa.array(list(rows))})
    side = S.QuerySide(table, S.FUSED_PASS)
    tracemalloc.start()
    out = S._scan_block([batch], [side], 2, ["doc_id"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out["qid"]) == 40_000 and peak < 150e6      # the whole matrix would be 800 MB
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.argsort(-(unit(asks[:50]) @ unit(rows).T), axis=1)[:, :2]
    assert out["doc_id"][:100] == near.ravel().tolist()


def test_blocks_of_queries_stay_within_the_bounds(spark, monkeypatch):
    queries = spark.createDataFrame([(i % 7, [float(i)] * 50) for i in range(300)], "qid bigint, vector array<double>")
    monkeypatch.setattr(S, "collect_bounded", lambda df, rows=None, n=9_000: collect_bounded(df, rows, n))
    tables = list(S.query_blocks(queries, 100))
    assert sum(t.num_rows for t in tables) == 300 and max(t.nbytes for t in tables) <= 9_000


def test_scans_are_pruned(spark, data, tmp_path):
    """The filtered pass reads the domains asked for, the payload the files that hold a hit."""
    _, _, catalog, queries = data
    path = str(tmp_path / "catalog")
    extra = catalog.withColumns({"doc_hash": F.col("doc_id").cast("string"), "wide": F.repeat(F.lit("x"), 100)})
    extra.repartitionByRange(12, "doc_id").write.partitionBy("domain").parquet(path)
    stored = spark.read.parquet(path)
    plan = S.filtered_top_k(stored, queries.where("qid IN (1, 3)"), 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*domain#\d+ (=|IN|INSET) \(?d1", plan), plan
    hits = S.top_k(S.with_files(stored), queries, (S.FUSED_PASS,), 2, carry=["_file"]).cache()
    n_files = hits.select("_file").distinct().count()
    full = S.attach_payload(hits, stored, ["doc_hash", "wide"])
    assert sorted((r.qid, r.doc_hash) for r in full.collect()) == sorted((r.qid, str(r.doc_id)) for r in hits.collect())
    node = full._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in node and n_files < len(stored.inputFiles())
    assert S.with_files(catalog) is None


def test_a_kept_index_gives_the_rows_of_the_scan(spark, data, tmp_path):
    """All three passes through stored cells, after two appends with vectors beyond the first radii."""
    from quillmap.plans.hybrid_search import hybrid_search

    rows, _, catalog, queries = data
    rng = np.random.default_rng(8)
    full = catalog.withColumns({
        "visual": F.when(F.col("doc_id") % 4 > 0, F.reverse("vector")), "doc_hash": F.col("doc_id").cast("string"), "snippet": F.lit("s"),
        "source": F.lit("x"), "extra": F.lit('{"a": "b"}')})
    full.where("doc_id < 500").write.partitionBy("domain").parquet(str(tmp_path / "cat" / "batch=1"))
    first = spark.read.parquet(str(tmp_path / "cat"))
    paths = {v: str(tmp_path / v) for v in ("vector", "visual")}
    for v, path in paths.items():
        A.create_index(first, v, path, "1", n_cells=6)
    far = spark.createDataFrame([(2000 + i, x.tolist(), "d1", "en") for i, x in enumerate(rng.normal(size=(40, 16)))], "doc_id bigint, vector array<double>, domain string, label string")
    far = far.withColumns({c: e for c, e in zip(full.columns[4:], [F.col("vector"), F.col("doc_id").cast("string"), F.lit("s"), F.lit("x"), F.lit("{}")])})
    for batch, new in (("2", full.where("doc_id BETWEEN 500 AND 899")), ("3", far)):
        new.write.partitionBy("domain").parquet(str(tmp_path / "cat" / f"batch={batch}"))
        for v, path in paths.items():
            A.append_index(new, v, path, batch)
            A.append_index(new, v, path, batch)            # a batch that is tried again
    everything = spark.read.parquet(str(tmp_path / "cat"))
    asked = queries.withColumns({"visual": F.reverse("vector"), "ocr_text": F.lit("s words")})
    index = {v: A.open_index(spark, path, v) for v, path in paths.items()}
    assert index["vector"].rows.count() == 940 and (index["vector"].radii >= 0).sum() > 1
    pick = ["qid", "rank", "doc_id", "pass_no", "confidence"]
    scan = sorted(map(tuple, hybrid_search(everything, asked, 4).select(*pick).collect()))
    assert sorted(map(tuple, hybrid_search(everything, asked, 4, index=index).select(*pick).collect())) == scan
    some = {"vector": index["vector"]}
    assert sorted(map(tuple, hybrid_search(everything, asked, 4, index=some).select(*pick).collect())) == scan


def test_cells_are_exact(data):
    rows, asks, catalog, queries = data
    index = A.build_cells(catalog, "vector", n_cells=8, min_rows=10)
    want = brute(rows, asks, 6)
    for probes in (1, 3):
        assert found(A.search_cells(index, queries, "vector", 6, n_probe=probes)) == want
    near = found(A.search_cells(index, queries, "vector", 6, n_probe=3, exact=False))
    assert len({x[:2] for x in near} & {x[:2] for x in want}) >= 0.8 * len(want)
    assert A.build_cells(catalog, "vector", min_rows=1000) is None


def test_codes_are_exact(data):
    rows, asks, catalog, queries = data
    index = A.build_codes(catalog, "vector", n_sub=4, entries=16)
    assert found(A.search_codes(index, queries, "vector", 6)) == brute(rows, asks, 6)


def test_partition_count_does_not_matter(data):
    _, _, catalog, queries = data
    want = found(S.fused_top_k(catalog.coalesce(1), queries, 5))
    for n in (4, 17):
        assert found(S.fused_top_k(catalog.repartition(n), queries, 5)) == want


def test_normalize_and_fuse(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], None)],
                               "a array<double>, b array<double>")
    twice = V.l2_normalize(V.l2_normalize(F.col("a")))
    got = df.select(twice, V.fuse(F.col("a"), F.col("b")),
                    V.cosine(F.col("a"), F.col("b"))).collect()
    assert np.allclose(got[0][0], [0.6, 0.8]) and got[1][0] == [0.0, 0.0]
    assert got[0][1] == [2.0, 2.0] and got[1][1] == [0.0, 0.0]
    assert abs(got[0][2] - 0.6) < 1e-12 and got[1][2] is None


def test_scores_match_expressions(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(50)
    refs = np.random.default_rng(1).normal(size=(4, 64))
    lits = F.array(*[F.lit(float(x)) for x in refs[2]])
    rows = e.select(V.cosine_scores(F.col("embedding"), refs)[2],
                    V.cosine(F.col("embedding"), lits)).collect()
    assert all(abs(r[0] - r[1]) < 1e-9 for r in rows)


def test_label_matchers_agree(spark):
    texts = [(1, "The RED apple pie shop", "a"), (2, "apple pieces", "b"), (3, "", "a"),
             (4, None, "a"), (5, "constantinople", "a")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, archive string")
    labels = spark.createDataFrame(
        [("a", "apple"), ("a", "apple pie shop"), ("a", "ed"), ("b", "apple pie shop"),
         ("b", "pieces"), ("a", "constantin"), ("a", "antinople"), ("b", "constantinople")],
        "archive string, label string")
    want = {1: "apple pie shop", 2: "pieces", 3: None, 4: None, 5: "constantin"}

    def got(df):
        return {r["doc_id"]: r["text_label"] for r in df.collect()}

    args = (docs, "text", labels)
    assert got(L.longest_label_in_text(*args, scope_col="archive")) == want
    assert got(L.longest_label_in_text(*args, scope_col="archive", max_labels=2)) == want


def test_labels_do_not_depend_on_runs(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc "), n)) for n in (0, 5, 400, 3000, 50)] + [None]
    labels = ["ab", "abca", "bcabcabc", "cabcabcabca", "aaaaaa bbbb", "c b a c"]
    want = {i: max((x for x in labels if t and x in t), key=lambda x: (len(x), x), default=None) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    assert list(L._runs(["abcdef", None, "gh"], 1, 100)) == [([0, 2], ["abcdef", "gh"])]
    for size in (1, 7, 100, 1 << 20):
        runs = list(L._runs(texts, 12, size))
        assert all(sum(map(len, parts)) <= 2 * size + 12 for _, parts in runs)
        found = L._longest_by_hashes(F.col("text"), F.lit(""), [("", x) for x in labels], run_chars=size)
        got = {r["doc_id"]: r["l"] for r in docs.select("doc_id", found.alias("l")).collect()}
        assert got == want, size
    assert {r["doc_id"]: r["text_label"] for r in L.longest_label_in_text(docs, "text", names).collect()} == want


def test_labels_beyond_the_bound_are_sought_by_few_grams(spark, sf):
    """Both ways give the same labels; what is shuffled is a small part of the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = docs.where("doc_id % 20 = 0").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("label")).where("length(label) >= 9").distinct()
    labels = words.withColumn("_scope", F.lit(""))
    got = {r["doc_id"]: r["text_label"] for r in L.longest_label_in_text(docs, "text", words, max_labels=1).collect()}
    assert got == {r["doc_id"]: r["text_label"] for r in L.longest_label_in_text(docs, "text", words).collect()}
    assert sum(x is not None for x in got.values()) >= 30
    held = L.gram_filter(labels.select(F.substring("label", 1, 8).alias("g")).distinct())
    assert held.nbytes == 16 << 20
    rows = L.label_candidates(docs.withColumn("_scope", F.lit("")), "doc_id", F.lower("text"), [8], 30, 8, held)
    chars = docs.agg(F.sum(F.length("text"))).head()[0]
    assert rows.count() < 0.05 * chars


def test_nearest_label_beyond_the_bound(spark):
    docs = spark.createDataFrame(
        [(1, [1.0, 0.1], "a"), (2, [0.0, 1.0], "b"), (3, None, "a")],
        "doc_id bigint, v array<double>, archive string")
    labels = spark.createDataFrame(
        [("a", "x", [1.0, 0.0]), ("a", "y", [0.0, 1.0]), ("b", "z", [1.0, 0.2])],
        "archive string, label string, vector array<double>")

    def got(**kw):
        df = L.nearest_label(docs, "v", labels, 0.1, scope_col="archive", **kw)
        return {r["doc_id"]: r["vector_label"] for r in df.collect()}

    assert got() == got(max_labels=1) == {1: "x", 2: "z", 3: None}


def test_nearest_label_near_ties_and_odd_scopes(spark):
    """Equal and nearly equal labels, and scopes named like 'no filter', on both sides of the bound."""
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "unknown"), (3, [1.0, 0.0], ""), (4, [1.0, 0.0], "c")],
        "doc_id bigint, v array<double>, archive string")
    labels = spark.createDataFrame(
        [("a", "a", [1.0, 0.0001]), ("a", "b", [1.0, 0.0]), ("unknown", "x", [1.0, 0.5]),
         ("", "y", [1.0, 0.5]), ("c", "n", [2.0, 0.0]), ("c", "m", [1.0, 0.0])],
        "archive string, label string, vector array<double>")

    def got(**kw):
        df = L.nearest_label(docs, "v", labels, 0.1, scope_col="archive", **kw)
        return {r["doc_id"]: (r["vector_label"], r["similarity"]) for r in df.collect()}

    small = got()
    assert {d: x[0] for d, x in small.items()} == {1: "b", 2: "x", 3: "y", 4: "m"}
    assert small == got(max_labels=1) == got(max_labels=1, block_labels=2, block_rows=1)


def test_vectors_of_another_size_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<double>")
    with pytest.raises(Exception, match="components among those of"):
        df.select(V.cosine_scores(F.col("v"), np.eye(2))).collect()


def test_ranking_tells_distances_apart_that_six_digits_do_not(spark):
    catalog = spark.createDataFrame([(1, [1.0, 0.0010]), (2, [1.0, 0.0009])], "doc_id bigint, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "qid bigint, vector array<double>")
    assert S.fused_top_k(catalog, queries, 1).first()["doc_id"] == 2
    assert S.fused_top_k(catalog, queries, 1, digits=6).first()["doc_id"] == 1


def test_principal_axes(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(300, 6)) * np.array([9, 1, 5, 0.5, 3, 0.1]) + 4
    catalog = spark.createDataFrame(
        [(i, v.tolist(), f"a/b{i}.txt", "food") for i, v in enumerate(rows)],
        "doc_id bigint, vector array<double>, source string, domain string")
    got = {r["doc_id"]: (r["x"], r["y"], r["z"]) for r in N.pca_points(catalog, n=200).collect()}
    assert len(got) == 200
    ids = sorted(got)
    centred = rows[ids] - rows[ids].mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :3]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    assert np.allclose(np.array([got[i] for i in ids]), centred @ axes, atol=1e-6)


def test_covariance_of_many_tasks(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(300, 5)) * np.array([9, 1, 5, 0.5, 3]) + 400
    rows[:, 1] += rows[:, 0]
    df = spark.createDataFrame([(v.tolist(),) for v in rows] + [(None,)], "vector array<double>").repartition(7)
    got = {(r["i"], r["j"]): r["cov"] for r in N.covariance(df).collect()}
    want = np.cov(rows.T)
    assert set(got) == {(i, j) for i in range(5) for j in range(i, 5)}
    assert all(abs(c - want[k]) < 1e-7 for k, c in got.items())
    assert N.covariance(df.limit(0)).collect() == []
    # the explorer's axes are its first eigenvectors, whatever their sign
    catalog = spark.createDataFrame([(i, v.tolist(), "a", "b") for i, v in enumerate(rows)], "doc_id bigint, vector array<double>, source string, domain string")
    points = np.array([[r["x"], r["y"], r["z"]] for r in N.pca_points(catalog).collect()])
    assert np.allclose(np.cov(points.T), np.diag(np.linalg.eigvalsh(want)[::-1][:3]), atol=1e-6)
