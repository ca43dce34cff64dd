import random

from quillmap.llm import quality_rules as Q
from tests.llm.helpers import documents, prose, words


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + s for at in seen.values() if len(at) > 1 for i in at for s in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def awkward():
    rng = random.Random(5)
    good = prose(rng, 90, "abcdefghijklmnopqrstuvwxyz")
    return [
        (1, good), (2, None), (3, ""), (4, " \n\t "), (5, "aa bb " * 60), (6, good + "\n" + good), (7, good.upper()),
        (8, " ".join(w + "###" for w in good.split())), (9, "line one\n" * 40 + good), (10, "x" * 100_000), (11, prose(rng, 30_000)),
        (12, "é\x0bü\x0cß\u00a0x \u2003 y"), (13, " ".join(f"the {w}" for w in good.split())), (14, "1 2 3 4 5 6 7 8 9 10 " * 6 + good),
        (1, good), (None, good), (15, "a b c d a b c d"), (16, "a b c a b c a"), (17, "\r\n".join([good, "", "x", "x"])),
    ]


def test_base_figures_and_verdicts(spark):
    rows = awkward()
    got = Q.judge_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_figures = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert by_figures == sorted(brute(t) for _, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert {1, None} <= kept and not kept & {2, 3, 4, 5, 7, 8, 10, 12, 13}


def test_order_never_changes_the_verdict():
    rules = [*Q.BASE_RULES, *Q.MORE_RULES]
    for _, text in awkward():
        verdicts = set()
        for seed in range(5):
            random.Random(seed).shuffle(rules)
            verdicts.add(Q.first_rejection({"text": text or ""}, rules) is None)
        assert len(verdicts) == 1


def test_order_by_rejection_per_cost():
    rules = Q.MORE_RULES[:3]
    free = dict.fromkeys(Q.FEATURES, 0.0)
    cost = {rules[0].name: 1.0, rules[1].name: 1.0, rules[2].name: 0.1}
    # rule 0 rejects 10 of 100 texts, rule 1 rejects 20, rule 2 rejects 5 of those of rule 1
    order = Q.order_rules(rules, free, cost, {0b001: 10, 0b010: 15, 0b110: 5, 0: 70})
    assert [r.name for r in order] == [rules[2].name, rules[1].name, rules[0].name]
    dear = free | {"lines": 100.0}
    order = Q.order_rules(rules, dear, cost, {0b001: 10, 0b010: 15, 0b110: 5, 0: 70})
    assert order[0].name != rules[2].name


def test_keep_documents_passes_columns_through(spark):
    rows = [(d, t, "kept", True) for d, t in awkward()]
    docs = documents(spark, rows, "doc_id bigint, text string, n_words string, kept boolean")
    got = Q.keep_documents(docs)
    assert got.columns == docs.columns
    judged = Q.judge_documents(docs).where("kept").select("doc_id")
    assert sorted(r.doc_id or 0 for r in got.collect()) == sorted(r.doc_id or 0 for r in judged.collect())


def test_empty_table(spark):
    docs = documents(spark, [])
    assert Q.judge_documents(docs).collect() == [] and Q.keep_documents(docs).collect() == []
