"""Quality by importance resampling.

Two bag-of-n-gram models over hashed words and word pairs are counted: one of the target (texts that annotators call
good) and one of the raw corpus (all texts). The log of their ratio, summed over the n-grams of a text, is the log of the
importance weight. Resampling without replacement adds an independent Gumbel variable to each log weight and
keeps the k largest sums; the k-th is found exactly by counting the sums' bits from the top, 16 at a time.

The raw model counts every text, the target model every text that is labelled good. The Gumbel variable is a function of the id and a seed, so a run can be repeated.

Defined results: a null text counts as an empty one, with the log weight 0. Rows without an id are scored and drawn like others,
all with one Gumbel variable. Equal sums are taken in order of id, then of all equal rows in full or not at all, if k falls among rows
that share an id. Without target rows all log weights are 0 and the draw is uniform. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import row_slices, string_column, write_scratch
from quillmap.session import collect_bounded

#: Hash buckets of the models.
BUCKETS = 1 << 16
#: Ids of target rows that are shipped to the texts; more are joined by a shuffle.
SHIPPED_IDS = 4_000_000
#: Added to every bucket of both models, in shares of one n-gram.
SMOOTH = 1.0


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and of all pairs of neighbours."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    one = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] + (one[:-1] >> np.uint64(29)))
    two = (two ^ (two >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([one >> np.uint64(33), two >> np.uint64(33)]).astype(np.int64) % buckets


def log_ratio(docs: DataFrame, good: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """log target - log raw for each bucket; ``good`` holds the ids of the target rows, each once."""
    ids = good.withColumn("good", F.lit(True))
    if collect_bounded(good, SHIPPED_IDS) is not None:
        ids = F.broadcast(ids)
    marked = docs.select(F.col(f"`{key}`").alias("doc"), string_column(text, "text_")).join(ids, "doc", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in row_slices(batches):
            for value, is_good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.bincount(ngram_buckets(value, buckets), minlength=buckets) if value else 0
                raw += seen
                if is_good:
                    target += seen
        used = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": pa.array(used), "raw": pa.array(raw[used]), "target": pa.array(target[used])})

    counts = marked.select("text_", "good").mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most the buckets
    raw, target = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    at = counts.column("bucket").to_numpy()
    raw[at] += counts.column("raw").to_numpy()
    target[at] += counts.column("target").to_numpy()
    if target.sum() <= SMOOTH * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a bigint column, and how many rows are larger; exact, by four counts of 16 bits."""
    found, above = 0, 0
    shifted = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    left = rows.select(shifted.alias("u"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF))
        counts = left.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("d")).collect()  # at most 65,536 rows
        for row in counts:
            if above + row["n"] >= k:
                break
            above += row["n"]
        left = left.where(digit == row["d"])
        found = found << 16 | row["d"]
    signed = found ^ 1 << 63
    return signed - (1 << 64) if signed >= 1 << 63 else signed, above


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0,
    key: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """key, log_weight, gumbel_key, kept.

    k is ``share`` of the rows. Without it, the share of good rows among the labelled ones is taken, at the upper end of
    its 99.9 % interval.
    """
    known = labels.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{label}`").cast("int").alias("y")).where("doc IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("doc").agg(F.max("y").alias("y"))
    if share is None:
        n, p = known.agg(F.count("*"), F.avg("y")).first()
        share = min(1.0, p + 3.3 * (p * (1 - p) / n) ** 0.5) if n else 1.0
    good = known.where("y = 1").select("doc")
    ratio = log_ratio(docs, good, key, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            weights = [float(ratio[ngram_buckets(t)].sum()) if t else 0.0 for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            u = np.array([(xxhash.xxh3_64_intdigest(str(i).encode(), seed=seed) >> 11) + 0.5 for i in ids]) / 2.0 ** 53
            sums = np.array(weights) - np.log(-np.log(u))
            bits = (sums + 0.0).view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            yield pa.record_batch({key: batch.column(0), "log_weight": pa.array(weights, pa.float64()), "gumbel_key": pa.array(sums), "place": pa.array(order)})

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(f"`{key}`").alias(key), string_column(text, "text_")).mapInArrow(score, f"`{key}` {kind}, log_weight double, gumbel_key double, place bigint")
    scored = write_scratch(scored, "weights")
    total = scored.count()
    k = round(share * total)
    if k <= 0 or k >= total:
        return scored.withColumn("kept", F.lit(k > 0)).drop("place")
    edge, above = kth_largest(scored, "place", k)
    # among the rows of the k-th sum the smallest ids are taken
    ids = F.xxhash64(F.col(f"`{key}`")) if kind != "bigint" else F.coalesce(F.col(key), F.lit(-(1 << 63)))
    tied = scored.where(F.col("place") == edge).select((-1 - ids).alias("turned"))
    last, _ = kth_largest(tied, "turned", k - above)
    kept = (F.col("place") > edge) | ((F.col("place") == edge) & (-1 - ids >= last))
    return scored.withColumn("kept", kept).drop("place")
