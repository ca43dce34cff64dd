import random

import numpy as np
import pytest

from quillmap.llm import common
from quillmap.llm import near_dup as N
from quillmap.llm.common import maybe_among, only, without, write_scratch
from quillmap.llm.components import connected_components
from tests.llm.helpers import documents, near_dup_brute, prose


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "z" + str(rng.random())
    return " ".join(w)


def corpus():
    rng = random.Random(8)
    rows, base = [], [prose(rng, n) for n in (5, 12, 30, 60, 120, 300, 900, 3000)]
    for text in base:
        rows += [text, text, text.upper(), text.replace(" ", "\n\t")]
        rows += [changed(rng, text, k) for k in (1, 1, 2, 3, 5, 8)]
    line = prose(rng, 14)
    rows += [line + " " + prose(rng, rng.randint(1, 40)) for _ in range(150)]  # one line that many share
    hub = prose(rng, 200)
    rows += [changed(rng, hub, 2) for _ in range(60)] + [hub] * 40  # a large group of near and exact copies
    chain = prose(rng, 100).split(" ")
    for i in range(12):  # each is like the next only
        chain = chain[3:] + prose(rng, 3).split(" ")
        rows.append(" ".join(chain))
    rows += ["", " \n", None, "one", "one", "one two", "One Two", "one two three", "é à", "É à", "x y", "x y"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, size, percent):
    rows = corpus()
    docs = documents(spark, [(*r, 0, "x") for r in rows], "doc_id bigint, text string, kept int, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, size, percent).collect()}
    assert got == near_dup_brute(rows, size, percent)


def test_unlinked_members_of_one_bucket_are_all_compared(spark, monkeypatch):
    """With one register a band, buckets are full of strangers and the rounds must take them apart."""
    monkeypatch.setattr(N, "rows_per_band", lambda threshold, registers=252: 1)
    rng = random.Random(3)
    shared = prose(rng, 40)
    rows = list(enumerate([shared + " " + prose(rng, 25) for _ in range(25)] + [changed(rng, shared, 1) for _ in range(25)]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert got == near_dup_brute(rows, 3, 85)


def test_odd_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(6)
    for n, d in ((150, 5), (150, 60), (2000, 400), (30, 30)):
        shared = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, d // 2, dtype=np.uint64)]) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        bits = sum(int(x).bit_count() for x in (N.odd_sketch(a) ^ N.odd_sketch(b)).view(np.uint64))
        assert bits <= apart and bits % 2 == apart % 2
        assert apart > 200 or bits > 0.75 * apart


def test_near_strangers_of_one_bucket_are_hardly_ever_compared(spark, monkeypatch):
    """A group of copies that lie below the threshold of one another: cuts hold few members, and sketches rule most pairs out."""
    monkeypatch.setattr(N, "CUT_ROWS", 16)
    rng = random.Random(9)
    hub = prose(rng, 150)
    rows = list(enumerate([hub] + [changed(rng, hub, 5) for _ in range(250)]))
    seen = []
    real = N._likely
    monkeypatch.setattr(N, "_likely", lambda pairs, *rest: seen.append((pairs := write_scratch(pairs, "pairs")).count()) or real(pairs, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert got == near_dup_brute(rows, 3, 85)
    assert sum(seen) < 250 * 249 / 2 / 10


def test_joins_are_given_what_their_pairs_name(spark, monkeypatch):
    """Registers and sets of other documents are left out before the shuffle, and rounds without pairs compare nothing."""
    rng = random.Random(12)
    base = prose(rng, 60)
    rows = list(enumerate([prose(rng, 60) for _ in range(400)] + [base] + [changed(rng, base, 1) for _ in range(3)]))
    given = []
    for name in ("_likely", "_confirmed"):
        monkeypatch.setattr(N, name, lambda pairs, known, *rest, real=getattr(N, name): given.append((pairs.count(), known.count())) or real(pairs, known, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(documents(spark, rows), 5, 80).collect()}
    assert got == near_dup_brute(rows, 5, 80)
    assert given and all(named < 40 for _, named in given)


def test_maybe_among_keeps_all_wanted_rows(spark, monkeypatch):
    rows = spark.range(-1000, 3000).selectExpr("id AS doc", "concat('t', id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc, 'x' AS text"))
    keys = write_scratch(rows.where("doc % 40 = 0 OR doc = 2999").select("doc").unionByName(rows.where("doc = 0").select("doc")), "keys")
    wanted = {r.doc for r in keys.collect()}
    passed = maybe_among(rows, keys)
    assert passed.columns == rows.columns
    assert all(r.text == f"t{r.doc}" for r in passed.collect() if r.doc is not None)
    got = [r.doc for r in passed.collect()]
    assert len(got) == len(set(got)) < 700 and wanted <= set(got)
    monkeypatch.setattr(common, "MAX_BITS", 64)  # a map that is too small lets more rows pass
    got = [r.doc for r in maybe_among(rows, keys).collect()]
    assert len(got) == len(set(got)) and wanted <= set(got)
    assert maybe_among(rows, write_scratch(keys.where("doc > 5000"), "keys")).collect() == []


def shuffled(df, column):
    """Rows written to exchanges that carry this column, after a run of the frame's own plan."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" and any(plan.output().apply(i).name() == column for i in range(plan.output().size())):
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        plans += below
    return total


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """Nor where the ids that go are too many to be broadcast."""
    rng = random.Random(21)
    base = prose(rng, 60)
    rows = list(enumerate([prose(rng, 60) for _ in range(400)] + [base] + [changed(rng, base, 1) for _ in range(5)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for more in ([], [(3, rows[3][1]), (404, rows[404][1])]):  # rows that share an id: one of them stays
            documents(spark, rows + more).write.parquet(path := f"{tmp_path}/{len(more)}")
            kept = N.drop_near_duplicates(spark.read.parquet(path))
            assert 5 <= shuffled(kept, "text") < 100
            want = [(d, t) for d, t in rows if near_dup_brute(rows[400:], 5, 80).get(d, (0, d))[1] == d]
            assert sorted(map(tuple, kept.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_of_full_sets_are_left_out_before_the_shuffle(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(22)
        documents(spark, list(enumerate(prose(rng, 30) for _ in range(400)))).write.parquet(f"{tmp_path}/docs")
        wanted = write_scratch(spark.range(5).withColumnRenamed("id", "doc"), "wanted")
        sets = N._full_sets(spark.read.parquet(f"{tmp_path}/docs"), wanted, 5, "doc_id", "text")
        assert 5 <= shuffled(sets, "text_") < 100
        assert sorted(r.doc for r in sets.collect()) == [0, 1, 2, 3, 4]
        assert 5 <= shuffled(N._own_shingles(write_scratch(N._full_sets(spark.read.parquet(f"{tmp_path}/docs"), spark.range(400).withColumnRenamed("id", "doc"), 5, "doc_id", "text"), "sets"), wanted), "hashes") < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_and_without_are_exact(spark, monkeypatch):
    rows = spark.range(-1000, 3000).selectExpr("id AS doc", "concat('t', id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc, 'x' AS text"))
    for some in ("doc % 40 = 0", "doc % 40 = 0 OR doc IS NULL", "doc > 5000", "doc IS NOT NULL"):
        for most in (common.MAX_BITS, 64):  # with a map that is too small more rows are joined
            monkeypatch.setattr(common, "MAX_BITS", most)
            keys = write_scratch(rows.where(some).select("doc"), "keys")
            got = without(rows, keys)
            assert got.columns == rows.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.where(f"NOT coalesce({some}, false) OR doc IS NULL").collect()))
            got = only(rows, write_scratch(keys.unionByName(keys), "keys"))
            assert got.columns == rows.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.where(f"({some}) AND doc IS NOT NULL").collect()))


def test_rows_without_id_and_shared_ids(spark):
    rng = random.Random(1)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a), (4, b), (None, a), (None, a), (5, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(documents(spark, rows), 5, 80).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 1, False), (None, None, True), (None, None, True), (5, 5, True)], key=repr)
    docs = documents(spark, [(*r, 9) for r in rows], "doc_id bigint, text string, component int")
    kept = N.drop_near_duplicates(docs, 5, 80)
    assert kept.columns == docs.columns
    again = documents(spark, [(*r, i) for i, r in enumerate(rows)][::-1], "doc_id bigint, text string, component int")
    one = {r.doc_id: r.component for r in N.drop_near_duplicates(again, 5, 80).collect() if r.doc_id == 1}
    other = {r.doc_id: r.component for r in N.drop_near_duplicates(again.orderBy("component"), 5, 80).collect() if r.doc_id == 1}
    assert one == other  # of rows that share an id always the same one stays
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(1, a, 9), (None, a, 9), (None, a, 9), (5, None, 9)], key=repr)


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, []), 3, 85).collect() == []
    assert N.drop_near_duplicates(documents(spark, [])).collect() == []


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    for n in (8, 40, 500, 6000):
        hits, want = [], []
        for _ in range(40):
            shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, n // 8, n // 8))
            x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
            est = N.estimate(N.sketch(x)[None, :], N.sketch(y)[None, :], np.array([len(x)]), np.array([len(y)]))
            hits.append(float(est[0]))
            want.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(hits) - np.mean(want)) < 0.02


def test_chance_hits_are_corrected():
    rng = np.random.default_rng(5)
    equal = [(N.sketch(rng.integers(0, 1 << 63, 2000, dtype=np.uint64)) == N.sketch(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))).mean() for _ in range(300)]
    assert abs(np.mean(equal) - N.chance_hits(np.array([2000]), np.array([2000]))[0]) < 4e-4


def test_rows_per_band_keep_the_miss_small():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        rows = N.rows_per_band(threshold)
        assert (1 - threshold ** rows) ** (N.REGISTERS // rows) <= N.MISS


def test_connected_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
