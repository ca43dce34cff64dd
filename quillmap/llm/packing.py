"""Best-fit packing with exact complements.

Documents become token ids with an end id; what is longer than a sequence is cut. Only the count of pieces
of each length matters for the packing, and there are no more lengths than a sequence has tokens, so the plan
is made on that bounded histogram, whatever the number of documents. Lengths are taken from the longest
down as openers of sequences. The gap an opener leaves is looked up in the index of sums that are available:
a single length, then a pair, then a triple that fills it exactly; as many sequences as the counts allow are
filled that way at once. What finds no exact complement goes, longest first, into the tightest gap that holds
it, or opens a new sequence.

Pieces are numbered within their length by running counts of each task plus the counts of the tasks before,
and the plan tells which number goes where. Pieces are never gathered by length.

Defined results: a null text counts as an empty one and is packed as its end id alone; rows without an id and
repeated rows are packed each for itself; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm.common import row_slices, string_column, write_scratch
from quillmap.llm.token_ids import encoder

Run = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies) ...), number of sequences


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32; part and nth: the task, and the piece's number there within its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer_path), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        for batch in row_slices(batches, 64):
            keys, rows = batch.column(0), []
            for i, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                data = np.concatenate([np.frombuffer(ids, dtype=encode.dtype), end]).astype("<u4")
                for piece, at in enumerate(range(0, len(data), capacity)):
                    ids_of = data[at:at + capacity]
                    rows.append((i, piece, at, len(ids_of), zlib.crc32(ids_of), int(seen[len(ids_of)])))
                    seen[len(ids_of)] += 1
            columns = [np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 6
            yield pa.record_batch({
                key: keys.take(pa.array(columns[0])), "piece": pa.array(columns[1].astype(np.int32)), "start": pa.array(columns[2]),
                "length": pa.array(columns[3]), "ids_crc32": pa.array(columns[4]),
                "part": pa.array(np.full(len(rows), part, dtype=np.int32)), "nth": pa.array(columns[5]),
            })

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    return docs.select(F.col(f"`{key}`").alias(key), string_column(text, "text_")).mapInArrow(run, schema)


class Sums:
    """The lengths with pieces left, and the sums of two and three of them, as bit sets."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.capacity = counts, len(counts) - 1
        self.limit = (1 << self.capacity + 1) - 1
        self.singles = self.pairs = self.triples = 0
        self.stale = True

    def refresh(self) -> None:
        have = np.flatnonzero(self.counts)
        self.singles = sum(1 << int(a) for a in have)
        self.pairs = self.triples = 0
        for a in map(int, have):
            self.pairs |= self.singles << a
        self.pairs &= self.limit
        for a in map(int, have):
            self.triples |= self.pairs << a
        self.triples &= self.limit
        self.stale = False

    def _enough(self, lengths) -> bool:
        return all(self.counts[a] >= lengths.count(a) for a in lengths)

    def _pair(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        high = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in high[(self.counts[high] > 0) & (self.counts[gap - high] > 0)]:
            found = (int(a), gap - int(a))
            if self._enough(held + found):
                return found
        return None

    def exact(self, gap: int, opener: int, pieces: int) -> tuple[int, ...] | None:
        """So many lengths that sum to the gap and are left beside the opener; longest first."""
        if self.stale:
            self.refresh()
        if not (self.singles, self.pairs, self.triples)[pieces - 1] >> gap & 1:
            return None
        if pieces == 1:
            return (gap,) if self._enough((opener, gap)) else None
        if pieces == 2:
            return self._pair(gap, (opener,))
        for a in np.flatnonzero(self.counts[:gap - 1])[::-1]:
            a = int(a)
            if self.pairs >> (gap - a) & 1 and (found := self._pair(gap - a, (opener, a))):
                return (a, *found)
        return None


def plan(counts: np.ndarray) -> list[Run]:
    """Sequences for ``counts[length]`` pieces of each length up to the capacity, as runs of equal ones.

    Openers are the lengths of half a sequence and more, no two of which longer ones fit together. All gaps
    that a single length fills are closed first, then those that need a pair, then triples, so that short
    lengths last longer; the short ones left over are best placed by best fit.
    """
    counts = np.array(counts, dtype=np.int64)
    capacity = len(counts) - 1
    counts[0] = 0
    runs: list[Run] = []
    if counts[capacity]:
        runs.append((((capacity, 1),), int(counts[capacity])))
        counts[capacity] = 0
    sums = Sums(counts)
    for pieces in (1, 2, 3):
        for opener in range(capacity - 1, (capacity - 1) // 2, -1):
            while counts[opener] and (found := sums.exact(capacity - opener, opener, pieces)):
                lengths = (opener, *found)
                use = tuple((a, lengths.count(a)) for a in dict.fromkeys(lengths))
                times = min(int(counts[a]) // n for a, n in use)
                for a, n in use:
                    counts[a] -= times * n
                    sums.stale |= bool(counts[a] == 0)
                runs.append((use, times))
    return runs + best_fit(counts)


def best_fit(counts: np.ndarray) -> list[Run]:
    """Longest first, each piece into the tightest gap that holds it; equal sequences are handled together."""
    capacity = len(counts) - 1
    open_: list[list] = [[] for _ in range(capacity + 1)]  # by gap: [pattern, number of sequences]
    for length in range(capacity, 0, -1):
        left, gap = int(counts[length]), length
        while left and gap <= capacity:
            if not open_[gap]:
                gap += 1
                continue
            pattern, n = open_[gap].pop()
            fit = gap // length
            whole = min(n, left // fit)
            if whole:
                open_[gap - fit * length].append((pattern + ((length, fit),), whole))
                left, n = left - whole * fit, n - whole
            if n and left:
                some = min(left, fit)
                open_[gap - some * length].append((pattern + ((length, some),), 1))
                left, n = left - some, n - 1
            if n:
                open_[gap].append((pattern, n))
        if left:
            fit = capacity // length
            if left // fit:
                open_[capacity - fit * length].append((((length, fit),), left // fit))
            if left % fit:
                open_[capacity - left % fit * length].append((((length, left % fit),), 1))
    return [(pattern, n) for group in open_ for pattern, n in group]


def places(runs: list[Run], capacity: int) -> np.ndarray:
    """Rows (length, first number, copies, first sequence, offset), sorted: where the pieces of a length go."""
    used, sequence, rows = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for pattern, times in runs:
        offset = 0
        for length, copies in pattern:
            rows.append((length, int(used[length]), copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    pieces = write_scratch(cut_pieces(docs, tokenizer_path, end_id, capacity, key, text), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length: at most the capacity
        counts[row["length"]] = row["n"]
    table = places(plan(counts), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.join(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), ["part", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 45 | table[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = table[np.searchsorted(keys, length << 45 | number, side="right") - 1] if len(length) else table[:0]
            instance, copy = np.divmod(number - row[:, 1], np.maximum(row[:, 2], 1))
            out = {c: batch.column(c) for c in (key, "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(out | {"sequence_id": pa.array(row[:, 3] + instance), "offset": pa.array(row[:, 4] + copy * length)})

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return numbered.select(key, "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("number")).mapInArrow(run, schema)
