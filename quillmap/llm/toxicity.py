"""Toxicity by weak supervision.

Many voters look at a text: groups of a lexicon, patterns, and words and word beginnings that the training rows
associate with toxic texts. Such a voter says yes or abstains; one more voter speaks for the other side where no
lexicon or pattern finds anything, and the annotators' label is a voter that says yes or no. A generative
label model has each voter speak with one probability for toxic and another for other texts; expectation and
maximisation estimate these accuracies together with the hidden classes, and the correlations that voters
show within the classes. A voter's evidence is divided by what the correlations say it shares with others. The posterior of each training row
is the soft label of a linear classifier with an L1 penalty over the words, the word beginnings, and the votes of lexicon and
patterns; the classifier alone scores documents. A lexicon group or pattern that the training rows hardly show keeps the weight that the
label model's evidence for it gives, by a few made rows that hold its vote alone.

Training rows are labelled rows whose crc32(id as text) mod 5 is not 0; at most ``TRAIN_ROWS`` of them, chosen by a hash of the
id, are used. Everything else covers all rows.

Defined results: a null text counts as an empty one and gets the score of the classifier's constant. Rows without an id
are scored and never learned from. Of several labels of an id the highest counts. Without labelled rows of both classes
every score is the share of toxic ones among them (0 if there are none). Repeated rows are scored each for itself.
Extra columns pass through ``keep_clean`` and are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import row_slices, sample_by_hash, string_column, write_scratch

#: Bound on the labelled rows that voters, label model and classifier are fitted on.
TRAIN_ROWS = 20_000
#: Words and beginnings kept as features, and how many of them also vote.
FEATURES, MINED_VOTERS = 1500, 150
#: Toxic training rows that must hold a word before it becomes a feature.
SUPPORT = 4
#: Least association of a feature with the label, in nats; weeds out what many comparisons throw up by chance.
LEAST_G = 8.0
BEGINNINGS = (4, 5, 6)
L1 = 0.00003
TRUST = 0.98

LEXICON = {
    "insult": "idiot moron stupid dumb fool loser imbecile clown jerk cretin dimwit halfwit",
    "contempt": "pathetic worthless disgusting trash scum garbage vermin filth filthy parasite subhuman",
    "threat": "kill murder die hang shoot stab strangle exterminate eradicate",
    "hate": "hate despise loathe detest deport inferior savages",
    "profanity": "damn bastard bitch shit fuck fucking crap asshole whore slut",
}
PATTERNS = {
    "addressed": r"\byou(?:'re| are)? (?:such )?(?:a |an |all )?(?:idiot|moron|stupid|loser|clown|trash|scum|pathetic|worthless)",
    "command": r"\b(?:shut up|go to hell|get lost|drop dead|kill yourself)\b",
    "masked": r"\b[a-z][*#@$]{2,}[a-z]*\b",
    "exclaimed": r"\b(?:idiot|moron|stupid|loser|trash|scum)\w*\s*!{2,}",
}
_GROUPS = [frozenset(v.split()) for v in LEXICON.values()]
_PATTERNS = [re.compile(p) for p in PATTERNS.values()]
HIT_VOTERS = len(_GROUPS) + len(_PATTERNS)
#: Made rows of a lexicon or pattern voter, as a share of the training rows, and the most that their soft label may be:
#: without a training row of its own, one such vote must not call a text toxic.
MADE_SHARE, MADE_MOST = 0.001, 0.4
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~" + "«»“”‘’…"


def words_of(text: str) -> set[str]:
    return {w.strip(_EDGE).lower() for w in set(text.split())}


def features_of(words: set[str]) -> set[str]:
    """Words, and beginnings marked by a star."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    out.discard("")
    return out


def hits_of(words: set[str], text: str, wanted: tuple | None = None) -> list[bool]:
    """The votes of the lexicon groups and patterns; those not wanted are not looked for."""
    ask = [True] * HIT_VOTERS if wanted is None else wanted
    low = text.lower() if any(ask[len(_GROUPS):]) else ""
    said = [bool(a) and not g.isdisjoint(words) for g, a in zip(_GROUPS, ask, strict=False)]
    return said + [bool(a) and p.search(low) is not None for p, a in zip(_PATTERNS, ask[len(_GROUPS):], strict=True)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class LabelModel:
    """P(vote | class) of each voter, the share of its evidence that is its own, and a constant.

    Voter 0 is the annotators' label. The silence of the others is no evidence of its own; the constant stands for
    all of it and makes the mean posterior the share of toxic rows."""

    prior: float
    rate: np.ndarray  # (2, voters)
    correlation: np.ndarray
    own: np.ndarray
    constant: float = 0.0

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        yes = self.own * np.log(self.rate[1] / self.rate[0])
        no = math.log((1 - self.rate[1, 0]) / (1 - self.rate[0, 0]))
        return votes @ yes + (1 - votes[:, 0]) * no

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _sigmoid(self.evidence(votes) + self.constant)


def fit_label_model(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
    """votes (patterns, voters) of 0 and 1, how often each pattern occurs, and first guesses of the classes.

    The prior is the annotators' share of toxic rows. With the weight of a tenth of the rows, they are believed
    to be right ``TRUST`` of the time."""
    votes, q = votes.astype(np.float64), np.clip(start, 0.05, 0.95)
    total = weight.sum()
    prior = float(np.clip(weight @ votes[:, 0] / total, 1e-4, 1 - 1e-4))
    for _ in range(rounds):
        mass = np.stack([weight * (1 - q), weight * q])
        rate = (mass @ votes + 0.5) / (mass.sum(axis=1, keepdims=True) + 1.0)
        rate[:, 0] = (mass @ votes[:, 0] + np.array([1 - TRUST, TRUST]) * total / 10) / (mass.sum(axis=1) + total / 10)
        left = votes - (np.outer(1 - q, rate[0]) + np.outer(q, rate[1]))
        cov = (left * weight[:, None]).T @ left / total
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = cov / np.outer(sd, sd)
        np.fill_diagonal(correlation, 1.0)
        own = 1 / (correlation ** 2).sum(axis=1)
        own[0] = 1.0  # annotators judge the text for themselves
        model = LabelModel(prior, rate, correlation, own)
        evidence, low, high = model.evidence(votes), -60.0, 60.0
        for _ in range(60):
            model.constant = (low + high) / 2
            if weight @ _sigmoid(evidence + model.constant) > prior * total:
                high = model.constant
            else:
                low = model.constant
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-6:
            break
        q = np.clip(new, 1e-6, 1 - 1e-6)
    return model


def made_labels(model: LabelModel) -> list[float]:
    """For each lexicon and pattern voter, the posterior of a text with its vote alone, as far as it may go."""
    own = model.own * np.log(model.rate[1] / model.rate[0])
    prior = math.log(model.prior / (1 - model.prior))
    return [min(MADE_MOST, float(_sigmoid(prior + own[2 + v]))) for v in range(HIT_VOTERS)]


@dataclass
class Classifier:
    constant: float
    weights: dict[str, float]
    votes: tuple[float, ...] = ()  # of lexicon groups and patterns

    def score(self, text: str) -> float:
        total, get, words = self.constant, self.weights.get, words_of(text)
        if any(self.votes):
            total += sum(v for v, hit in zip(self.votes, hits_of(words, text, self.votes), strict=True) if hit)
        for w in words:
            total += get(w, 0.0)
            for n in BEGINNINGS:
                if len(w) > n:
                    total += get(w[:n] + "*", 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def _mine(train: DataFrame) -> list[str]:
    """Features by association with the label: G-squared of those commoner in toxic rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out():
            both = [(f, int(y == 0) * n, int(y) * n) for y in (0, 1) for f, n in seen[y].items()]
            for c in seen:
                c.clear()
            f, n0, n1 = zip(*both, strict=True) if both else ((), (), ())
            return pa.record_batch({"f": pa.array(f, pa.string()), "n0": pa.array(n0, pa.int64()), "n1": pa.array(n1, pa.int64())})

        for batch in row_slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[y].update(features_of(words_of(text)))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield out()
        yield out()

    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = F.col("n1"), F.col("n0")
    share1, share0 = a / sizes[1], (b + 0.5) / sizes[0]
    rest1, rest0 = F.lit(float(sizes[1])) - a, F.lit(float(sizes[0])) - b
    p = (a + b) / (sizes[0] + sizes[1])
    g = a * F.log(a / (p * sizes[1])) + F.when(b > 0, b * F.log(b / (p * sizes[0]))).otherwise(0.0)
    g += F.when(rest1 > 0, rest1 * F.log(rest1 / ((1 - p) * sizes[1]))).otherwise(0.0) + F.when(rest0 > 0, rest0 * F.log(rest0 / ((1 - p) * sizes[0]))).otherwise(0.0)
    counts = train.select("text", "toxic").mapInArrow(count, "f string, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    likely = counts.where((a >= SUPPORT) & (share1 > 3 * share0)).withColumn("g", g).where(F.col("g") >= LEAST_G)
    return [r["f"] for r in likely.orderBy(F.desc("g"), "f").limit(FEATURES).collect()]


def _votes(train: DataFrame, mined: list[str]) -> DataFrame:
    """doc, toxic, votes ('0' and '1' for each voter) and features (their places in ``mined``, and behind it the hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(mined)}
        for batch in row_slices(batches):
            votes, found = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = words_of(text)
                has = sorted(place[f] for f in features_of(words) if f in place)
                hit = hits_of(words, text)
                said = [y, not any(hit), *hit]
                told = set(has)
                said += [i in told for i in range(min(MINED_VOTERS, len(mined)))]
                votes.append("".join("1" if v else "0" for v in said))
                found.append(has + [len(mined) + i for i, h in enumerate(hit) if h])
            yield pa.record_batch({"votes": pa.array(votes, pa.string()), "features": pa.array(found, pa.list_(pa.int32()))})

    return train.select("text", "toxic").mapInArrow(run, "votes string, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Classifier:
    known = labels.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{label}`").cast("int").alias("toxic")).where("doc IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(F.crc32(F.col("doc").cast("string").cast("binary")) % 5 != 0).groupBy("doc").agg(F.max("toxic").alias("toxic"))
    chosen = sample_by_hash(known, "doc", train_rows)  # bounded by the parameter, so it may be shipped
    texts = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(string_column(text, "t"), F.lit("")).alias("text"))
    train = write_scratch(texts.join(F.broadcast(chosen), "doc").select("toxic", "text"), "train")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Classifier(500.0 if 1 in sizes else -500.0, {})
    mined = _mine(train)
    voted = write_scratch(_votes(train, mined), "votes")
    patterns = voted.groupBy("votes").count().collect()  # at most the training rows
    matrix = np.array([[c == "1" for c in r["votes"]] for r in patterns])
    model = fit_label_model(matrix, np.array([r["count"] for r in patterns], dtype=np.float64), matrix[:, 0].astype(float))
    soft = dict(zip((r["votes"] for r in patterns), model.posterior(matrix.astype(np.float64)).tolist(), strict=True))
    width = len(mined) + HIT_VOTERS
    vector = F.udf(lambda found: Vectors.sparse(width, found, [1.0] * len(found)), VectorUDT())
    posterior = F.udf(lambda votes: soft[votes], "double")
    rows = voted.select(vector("features").alias("x"), posterior("votes").alias("p"), F.lit(1.0).alias("n"))
    made = docs.sparkSession.createDataFrame(
        [([len(mined) + v], p, MADE_SHARE * sum(sizes.values())) for v, p in enumerate(made_labels(model))], "features array<int>, p double, n double")
    rows = rows.unionByName(made.select(vector("features").alias("x"), "p", "n"))
    rows = rows.select("x", F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), (F.col("n") * F.col("p")).alias("w")), F.struct(F.lit(0.0).alias("y"), (F.col("n") * (1 - F.col("p"))).alias("w")))).alias("r"))
    rows = rows.select("x", "r.y", "r.w").where("w > 1e-6")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=L1, elasticNetParam=1.0, standardization=False, maxIter=60).fit(rows)
    values = fitted.coefficients.toArray()
    weights = {f: float(v) for f, v in zip(mined, values, strict=False) if v}
    return Classifier(float(fitted.intercept), weights, tuple(map(float, values[len(mined):])))


def score_documents(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            scores = [classifier.score(t or "") for t in batch.column("text_").to_pylist()]
            yield pa.record_batch({key: batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()),
                                   "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())})

    held = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias(key), held.alias("held_out"), string_column(text, "text_")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, classifier: Classifier, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            yield batch.filter(pa.array([classifier.score(t or "") < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
