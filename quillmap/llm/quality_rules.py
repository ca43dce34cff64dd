"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one condition on a few features. On a sample (chosen by a hash of the id) the
cost of every feature and rule is timed and the rules' verdicts are kept for each text. Rules are then
ordered greedily: next comes the rule with the most rejections per second among the texts that the
rules before it let through, where features that are computed already cost nothing. A text goes through
the rules in that order, computes a feature when a rule first asks for it, and stops at its first rejection.

A text is kept if no rule rejects it, so the order changes the time and never the verdict.

Defined results: a null text counts as an empty one, has no words and is rejected for its length. Repeated
rows are judged each for itself. Extra columns pass through ``keep_documents`` unchanged and are ignored
by ``judge_documents``. Empty tables give empty results; the rules then run in their listed order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import row_slices, sample_by_hash, string_column

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Texts on which cost and selectivity are estimated. They decide the order of the rules only.
SAMPLE_ROWS = 2000

_NO_LETTER = re.compile(rb"[^A-Za-z\x80-\xff]+")
_BIG, _SMALL = re.compile(r"[A-Z]+"), re.compile(r"[a-z]+")


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    base = len(ids)
    pairs = seq[:-1] * base + seq[1:]
    if base >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + seq[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(twice)] |= twice
    return int(covered.sum())


def _dup_lines(text: str) -> tuple[int, int]:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


#: Each feature, from the text and the features before it. The words are those between ASCII white space.
FEATURES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "words": ((), lambda d: d["text"].encode("utf-8", "replace").split()),
    "n_words": (("words",), lambda d: len(d["words"])),
    "word_chars": ((), lambda d: len(d["text"]) - sum(map(d["text"].count, SPACES))),
    "n_symbols": ((), lambda d: sum(map(d["text"].count, SYMBOLS))),
    "lines": ((), lambda d: _dup_lines(d["text"])),
    "n_dup_lines": (("lines",), lambda d: d["lines"][1]),
    "n_repeat_words": (("words",), lambda d: _repeat_words(d["words"])),
    "top_count": (("words",), lambda d: max(Counter(d["words"]).values(), default=0)),
    "no_letter_words": (("words",), lambda d: sum(1 for w in d["words"] if _NO_LETTER.fullmatch(w))),
    "big_letters": ((), lambda d: sum(map(len, _BIG.findall(d["text"])))),
    "small_letters": ((), lambda d: sum(map(len, _SMALL.findall(d["text"])))),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict], bool]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda d: d["n_words"] < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda d: 100 * d["n_repeat_words"] > 50 * d["n_words"]),
)
MORE_RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda d: 10 * d["n_symbols"] > d["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda d: not 2 * d["n_words"] <= d["word_chars"] <= 20 * d["n_words"]),
    Rule("repeated_lines", ("lines", "n_dup_lines"), lambda d: 2 * d["n_dup_lines"] > d["lines"][0]),
    Rule("capitals", ("big_letters", "small_letters"), lambda d: 10 * d["big_letters"] > 3 * (d["big_letters"] + d["small_letters"])),
    Rule("one_word", ("n_words", "top_count"), lambda d: 5 * d["top_count"] > d["n_words"]),
    Rule("no_letters", ("n_words", "no_letter_words"), lambda d: 5 * d["no_letter_words"] > d["n_words"]),
)
BASE_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def closure(names) -> list[str]:
    """The features and all they need, each after its own needs."""
    out: list[str] = []
    for name in names:
        for x in (*closure(FEATURES[name][0]), name):
            if x not in out:
                out.append(x)
    return out


def compute(doc: dict, names) -> None:
    for name in names:
        if name not in doc:
            needs, f = FEATURES[name]
            compute(doc, needs)
            doc[name] = f(doc)


def first_rejection(doc: dict, order) -> str | None:
    for rule in order:
        compute(doc, rule.needs)
        if rule.rejects(doc):
            return rule.name
    return None


def measure(docs: DataFrame, rules, key: str, text: str, rows: int) -> tuple[dict[str, float], dict[str, float], Counter]:
    """Seconds of each feature and each rule on the sample, and how often each set of rules rejects."""
    features = closure(x for r in rules for x in r.needs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, seen = Counter(), Counter()
        clock = time.perf_counter
        for batch in row_slices(batches):
            for value in batch.column(0).to_pylist():
                doc, hit = {"text": value or ""}, 0
                for name in features:
                    began = clock()
                    doc[name] = FEATURES[name][1](doc)
                    spent["f:" + name] += clock() - began
                for i, rule in enumerate(rules):
                    began = clock()
                    hit |= rule.rejects(doc) << i
                    spent["r:" + rule.name] += clock() - began
                seen[f"h:{hit}"] += 1
        both = [*spent.items(), *((k, float(n)) for k, n in seen.items())]
        yield pa.record_batch({"what": pa.array([k for k, _ in both], pa.string()), "amount": pa.array([float(v) for _, v in both], pa.float64())})

    sample = sample_by_hash(docs, key, rows).select(string_column(text))
    # one row for each feature, rule and set of rejecting rules that occurs in the sample
    found = {r["what"]: r["amount"] for r in sample.mapInArrow(run, "what string, amount double").groupBy("what").agg(F.sum("amount").alias("amount")).collect()}
    pick = lambda kind: {k[2:]: v for k, v in found.items() if k.startswith(kind)}
    return pick("f:"), pick("r:"), Counter({int(k): int(v) for k, v in pick("h:").items()})


def order_rules(rules, feature_s: dict[str, float], rule_s: dict[str, float], hits: Counter, ready=()) -> list[Rule]:
    """Greedy order by rejections per second; ``ready`` features are there anyway."""
    left, done, alive = list(range(len(rules))), set(closure(ready)), Counter(hits)
    total, out = max(1, sum(hits.values())), []
    while left:
        passing = max(1, sum(alive.values()))

        def gain(i: int) -> tuple[float, int]:
            new = [x for x in closure(rules[i].needs) if x not in done]
            # measured on all sampled texts, paid for those that still pass
            cost = (sum(feature_s.get(x, 0.0) for x in new) + rule_s.get(rules[i].name, 0.0)) * passing / total
            return sum(n for h, n in alive.items() if h >> i & 1) / max(cost, 1e-9), -i

        best = max(left, key=gain)
        left.remove(best)
        out.append(rules[best])
        done.update(closure(rules[best].needs))
        alive = Counter({h: n for h, n in alive.items() if not h >> best & 1})
    return out


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base figures of every document and the verdict of the cascade.

    Columns: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. The base
    figures are asked for, so they are computed for all; the other rules run only where the base rules pass.
    """
    more = order_rules(MORE_RULES, *measure(docs, MORE_RULES, key, text, sample_rows), ready=BASE_FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            figures, failed, kept = [], [], []
            for value in batch.column(1).to_pylist():
                doc = {"text": value or ""}
                compute(doc, BASE_FEATURES)
                figures.append([doc[x] for x in BASE_FEATURES])
                failed.append(any(r.rejects(doc) for r in BASE_RULES))
                kept.append(not failed[-1] and first_rejection(doc, more) is None)
            columns = {key: batch.column(0)}
            columns |= {x: pa.array([f[i] for f in figures], pa.int64()) for i, x in enumerate(BASE_FEATURES)}
            yield pa.record_batch(columns | {"base_failed": pa.array(failed, pa.bool_()), "kept": pa.array(kept, pa.bool_())})

    kind = docs.schema[key].dataType.simpleString()
    longs = ", ".join(f"{x} bigint" for x in BASE_FEATURES)
    return docs.select(F.col(f"`{key}`").alias(key), string_column(text, "text_")).mapInArrow(run, f"`{key}` {kind}, {longs}, base_failed boolean, kept boolean")


def keep_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns; every rule runs in the cascade."""
    rules = (*BASE_RULES, *MORE_RULES)
    order = order_rules(rules, *measure(docs, rules, key, text, sample_rows))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([first_rejection({"text": t or ""}, order) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
