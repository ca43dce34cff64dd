"""Toxicity and importance resampling: accuracy on rows that were held out, and awkward rows."""

import random
import zlib

import numpy as np
import pytest

from quillmap.llm import resample as R
from quillmap.llm import toxicity as T
from tests.llm.helpers import documents, prose

BAD = ["idiot", "scum", "glorfu", "glorfi", "glorfa", "brakto", "brakti"]


def toxic_rows(n=900):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        words, y = prose(rng, rng.randint(20, 200), "abcdefghijklmn").split(" "), rng.random() < 0.2
        if y:
            for w in rng.sample(BAD, 3):
                words[rng.randrange(len(words))] = w + rng.choice(["", ",", "!"])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, 1, int(y)))
    return docs, labels, {d for d, t in docs if any(b in t for b in BAD)}


LABELS = "doc_id bigint, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    docs, labels, toxic = toxic_rows()
    docs += [(5000, None), (5001, ""), (None, "you idiot scum brakto glorfu"), (3, docs[3][1]), (5002, "nice day " * 20_000)]
    odd = [(None, 1, 1), (9999, 1, None), (4, 1, 7)]
    table = documents(spark, [(*d, "x") for d in docs], "doc_id bigint, text string, score string")
    got = T.score_documents(table, T.fit(table, spark.createDataFrame(labels + odd, LABELS))).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted == 1, r.doc_id in toxic) for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean([a == b for a, b in held]) >= 0.95 and len(held) > 100
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score < 0.5 and by_id[5002].predicted == 0 and by_id[None].predicted == 1


def test_lexicon_and_pattern_hits_reach_the_score(spark):
    """Where the training rows' toxic words are invented ones, English insults still score above an empty text."""
    docs, labels, _ = toxic_rows()
    docs = [(d, t.replace("idiot", "vrak").replace("scum", "zell")) for d, t in docs]
    model = T.fit(documents(spark, docs), spark.createDataFrame(labels, LABELS))
    empty, clean = model.score(""), model.score("a nice day in the garden")
    for text in ("moron", "go to hell", "you worthless neighbour", "stupid!!", "kill"):
        assert model.score(text) > empty + 0.01, text
    assert clean == pytest.approx(empty) and model.score("moron") < 0.5
    assert model.score("kill yourself you pathetic worthless trash") > 0.5


def test_posteriors_are_those_of_plain_em():
    """Two voters that do not depend on each other: expectation and maximisation written out row by row."""
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.25
    votes = np.stack([rng.random(4000) < np.where(y, 0.95, 0.05), rng.random(4000) < np.where(y, 0.7, 0.1)], axis=1)
    model = T.fit_label_model(votes, np.ones(4000), votes[:, 0].astype(float))
    got = model.posterior(votes.astype(float))
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    grouped = T.fit_label_model(patterns, counts.astype(float), patterns[:, 0].astype(float))
    assert np.allclose(grouped.posterior(patterns.astype(float))[back], got, atol=1e-6)  # patterns counted are rows
    assert ((got > 0.5) == y).mean() > 0.93 and abs(got.mean() - votes[:, 0].mean()) < 0.01
    order = [got[(votes == p).all(axis=1)].mean() for p in ([False, False], [False, True], [True, False], [True, True])]
    assert order == sorted(order)


def test_held_out_labels_are_never_learned(spark):
    docs, labels, _ = toxic_rows(300)
    turned = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, q, y in labels]
    table = documents(spark, docs)
    a, b = (T.fit(table, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.weights.keys() == b.weights.keys() and a.constant == pytest.approx(b.constant)


def test_toxicity_without_labels(spark):
    table = documents(spark, [(1, "idiot"), (2, None)])
    for labels, share in (([], 0.0), ([(i, 1, 0) for i in range(3)], 0.0), ([(i, 1, 1) for i in range(3)], 1.0)):
        model = T.fit(table, spark.createDataFrame(labels, LABELS))
        assert [r.score for r in T.score_documents(table, model).collect()] == [pytest.approx(share)] * 2
    empty = documents(spark, [])
    model = T.fit(empty, spark.createDataFrame([(1, 1, 1)], LABELS))
    assert T.score_documents(empty, model).collect() == []


def test_keep_clean(spark):
    model = T.Classifier(-2.0, {"bad": 5.0, "glor*": 3.0})
    docs = documents(spark, [(1, "bad day", 1), (2, "good day", 2), (3, None, 3), (None, "Glorfu!", 4), (4, "glor", 5)], "doc_id bigint, text string, score int")
    got = T.keep_clean(docs, model)
    assert got.columns == docs.columns and sorted(r.score for r in got.collect()) == [2, 3, 5]


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.3
    votes = np.zeros((len(y), 5), dtype=bool)
    for j, (yes, no) in enumerate([(0.97, 0.02), (0.6, 0.01), (0.5, 0.05), (0.4, 0.02)]):
        votes[:, j] = rng.random(len(y)) < np.where(y, yes, no)
    votes[:, 4] = votes[:, 3]  # one voter twice
    model = T.fit_label_model(votes, np.ones(len(y)), votes[:, 0].astype(float))
    assert np.allclose(model.rate[1, 1:4], [0.6, 0.5, 0.4], atol=0.05) and np.allclose(model.rate[0, 1:4], [0.01, 0.05, 0.02], atol=0.02)
    assert model.correlation[3, 4] > 0.99 and abs(model.correlation[1, 2]) < 0.1
    assert model.own[3] == pytest.approx(0.5, abs=0.05)
    assert ((model.posterior(votes.astype(float)) > 0.5) == y).mean() > 0.97


def quality_rows(n=600):
    rng, docs, labels = random.Random(4), [], []
    for i in range(n):
        good = rng.random() < 0.8
        docs.append((i, prose(rng, rng.randint(30, 200), "abcdef" if good else "uvwxyz")))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def test_resampling_keeps_good_texts(spark):
    docs, labels = quality_rows()
    docs += [(7000, None), (7001, ""), (None, "abc"), (3, docs[3][1]), (7002, "ab cd " * 20_000)]
    table = documents(spark, [(*d, True) for d in docs], "doc_id bigint, text string, kept boolean")
    got = R.resample(table, spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0)], LABELS), share=0.75).collect()
    assert len(got) == len(docs)
    kept = [r for r in got if r.kept]
    k = round(0.75 * len(docs))
    assert len(kept) == k and min(r.gumbel_key for r in kept) >= max(r.gumbel_key for r in got if not r.kept)
    truth = {d: set(t) <= set("abcdef ") for d, t in docs[:600]}
    right = [r.kept == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id % 2 == 0]
    assert np.mean(right) > 0.9
    assert {r.log_weight for r in got if r.doc_id in (7000, 7001)} == {0.0}


@pytest.mark.parametrize("shipped", [4_000_000, 0])
def test_log_weights_are_those_of_a_plain_count(spark, monkeypatch, shipped):
    """Every good labelled text counts, whether its id is shipped or joined."""
    monkeypatch.setattr(R, "SHIPPED_IDS", shipped)
    docs, labels = quality_rows(300)
    docs += [(8000, None), (8001, ""), (8002, "abc " * 5000)]
    labels += [(8002, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0)]
    best = {}
    for d, y, _ in labels:
        best[d] = max(y, best.get(d, 0))
    raw, target = np.ones(R.BUCKETS), np.ones(R.BUCKETS)
    for d, text in docs:
        for b in R.ngram_buckets(text):
            raw[b] += 1
            target[b] += best.get(d, 0)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = R.resample(documents(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    weights = {r.doc_id: r.log_weight for r in got}
    assert len(weights) == len(docs)
    assert all(weights[d] == pytest.approx(ratio[R.ngram_buckets(t)].sum(), abs=1e-9) for d, t in docs)


def test_resampling_ties_and_small_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    same = documents(spark, [(None, "a"), (None, "a"), (None, "a"), (None, "b")])
    assert sum(r.kept for r in R.resample(same, labels, share=0.5).collect()) in (0, 3, 4)
    assert R.resample(documents(spark, []), labels).collect() == []
    got = R.resample(documents(spark, [(i, "") for i in range(40)]), labels, share=0.25)
    assert sum(r.kept for r in got.collect()) == 10 and {r.log_weight for r in got.collect()} == {0.0}
    again = R.resample(documents(spark, [(i, "") for i in range(40)]).repartition(3), labels, share=0.25)
    assert sorted(r.doc_id for r in got.where("kept").collect()) == sorted(r.doc_id for r in again.where("kept").collect())
    assert all(r.kept for r in R.resample(same, labels).collect())


def test_kth_largest(spark):
    values = [0, 5, -5, 5, (1 << 63) - 1, -(1 << 63), 70_000, -70_000, 1 << 40]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k, v in enumerate(sorted(values, reverse=True), 1):
        found, above = R.kth_largest(rows, "v", k)
        assert found == v and above == sum(x > v for x in values)
