"""Vector code compression: product codes, their nearest entries found by Orchard's search.

A vector is cut into parts; each part is replaced by the index of the nearest entry of its position's codebook. For every entry a
list of the other entries is kept, sorted by distance. The search starts from some entry and walks its list; an entry that
is nearer to the point becomes the current one and the walk goes on in its list. Entries looked at are marked and
never measured twice. By the triangle inequality no entry farther from the current one than twice the current distance can be
nearer, or as near, so there the walk ends. Many points walk at once, a step of each at a time.

Codebooks start as the parts of the vectors of the smallest ids and move to the rounded-down means of their points. A task
sends one row for each entry (count and sums) whatever it reads, and the rows of all tasks are added before they reach the driver. All
arithmetic is in integers, so codes and codebooks do not depend on the order of the rows.

Defined results: vectors that are null or hold null, NaN or an infinity (also after scaling) take no part, and have no row in
the result. Vectors of another length than the commonest one (the shorter of two equally common) take no part
either. Where the length is no multiple of ``parts``, the first parts are one component longer. Of rows that share an id the
smallest vector can start an entry; rows without an id start none, and are coded and counted like all others. With fewer
ids than entries the codebooks are smaller. Repeated rows count as often as they occur. An error beyond 64 bits is null. Other
columns are not read; an empty table gives empty codebooks and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm import vectors as V
from quillmap.llm.common import write_scratch
from quillmap.session import collect_bounded

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Points that walk at the same time; bounds the marks of a task to this many times the entries.
POINTS = 4096
#: Entries of a list that a walk looks at in one step, before it moves to the nearest of them.
STRIDE = 8
#: Pieces that a label's rows are dealt to where there are too many labels to ship.
SALTS = 16


def cuts(length: int, parts: int) -> list[slice]:
    """Consecutive parts, the first ones longer where the length cannot be shared out evenly."""
    ends = np.cumsum([length // parts + (i < length % parts) for i in range(parts)])
    return [slice(int(b - (length // parts + (i < length % parts))), int(b)) for i, b in enumerate(ends)]


class Neighbours:
    """The entries of one codebook, and for each entry all entries by distance."""

    def __init__(self, entries: list[tuple[int, ...]]):
        whole = np.array(entries, dtype=object).reshape(len(entries), -1)
        self.most = float(max((abs(x) for e in entries for x in e), default=0))
        self.whole, self.floats = whole, whole.astype(np.float64)
        # by integers only where doubles would lose a digit
        if 4 * whole.shape[1] * self.most ** 2 < 2.0 ** 51:
            apart = ((self.floats[:, None, :] - self.floats[None, :, :]) ** 2).sum(axis=2)
        else:
            apart = ((whole[:, None, :] - whole[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        ahead = np.take_along_axis(apart, self.order, axis=1)
        end = np.full((len(entries), 1), float("inf"), dtype=ahead.dtype)
        self.ahead = np.concatenate([ahead, end], axis=1)  # the end of a list stops every walk
        self.order = np.concatenate([self.order, np.zeros((len(entries), 1), dtype=np.int64)], axis=1)
        self.sums = self.floats.sum(axis=1)
        self.by_sum = np.argsort(self.sums, kind="stable")

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, the lower index of equally near ones."""
        reach = max(self.most, V.largest(points))
        if 4 * points.shape[1] * (2 * reach) ** 2 < 2.0 ** 53:
            entries = self.floats
        else:
            points, entries = V.integers(points), self.whole
        n = len(points)
        rows = np.arange(n)
        # any start is right; the entry with the next sum of components is often a near one
        at = self.by_sum[np.minimum(np.searchsorted(self.sums[self.by_sum], points.sum(axis=1).astype(np.float64)), len(entries) - 1)]
        best = ((points - entries[at]) ** 2).sum(axis=1)
        seen = np.zeros((n, len(entries)), dtype=bool)
        seen[rows, at] = True
        place, walking, step = np.zeros(n, dtype=np.int64), rows, np.arange(STRIDE)
        while len(walking):
            here, there = at[walking, None], np.minimum(place[walking, None] + step, len(entries))
            within = (self.ahead[here, there] <= 4 * best[walking, None]).astype(bool)
            entry = self.order[here, there]
            r, c = np.nonzero(within & ~seen[walking[:, None], entry])
            row, looked = walking[r], entry[r, c]
            seen[row, looked] = True
            far = np.full(within.shape, float("inf"), dtype=best.dtype)
            far[r, c] = ((points[row] - entries[looked]) ** 2).sum(axis=1)
            least = far.min(axis=1)
            nearest = np.where(far == least[:, None], entry, len(entries)).min(axis=1)
            had, was = best[walking], at[walking]
            nearer = ((least < had) | ((least == had) & (nearest < was))).astype(bool)
            row = walking[nearer]
            at[row], best[row] = nearest[nearer], least[nearer]
            place[walking] += STRIDE
            place[row] = 0
            walking = walking[nearer | within[:, -1]]
        return at, best


@dataclass
class Codebooks:
    """Entries by part, each a tuple of integers; and how vectors are read for them."""

    entries: list[list[tuple[int, ...]]]
    length: int
    scale: int
    widest: float

    @property
    def parts(self) -> int:
        return len(self.entries)

    def digest(self) -> str:
        """SHA-256 of all components in order, as decimal integers with commas between them."""
        flat = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def decode(self, code: bytes) -> list[int]:
        """The vector that a code stands for."""
        return [x for part, i in zip(self.entries, code, strict=True) for x in part[i]]


def _kept(vectors: DataFrame, key: str, vector: str, scale: int, *more: str) -> DataFrame:
    rows = vectors.select(F.col(f"`{key}`").alias("id"), *[F.col(f"`{c}`").alias(f"more{i}") for i, c in enumerate(more)], V.scaled(vector, scale).alias("x"))
    return rows.where(V.usable("x"))


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, POINTS):
            part = batch.slice(at, POINTS)
            yield part, V.matrix(part.column("x"), length)


def _first_entries(rows: DataFrame, entries: int) -> list[tuple]:
    """The vectors of the smallest ids, as tuples of doubles; no id twice."""
    ids: list = []
    while len(ids) < entries:
        left = rows.where(F.col("id") > F.lit(ids[-1])) if ids else rows.where("id IS NOT NULL")
        more = sorted({r["id"] for r in left.select("id").orderBy("id").limit(entries).collect()})
        if not more:
            break
        ids += more
    found = rows.where(F.col("id").isin(ids[:entries])).groupBy("id").agg(F.min("x").alias("x"))
    return [tuple(r["x"]) for r in found.orderBy("id").collect()]


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (points, sums of their components)} of the entries that any point is nearest to.

    A sum travels as limbs of 32 bits where a task's could leave 64 bits; added limbs stay small."""
    limbs = 1 if books.widest < 2.0 ** 24 else int(np.ceil((np.log2(books.widest) + 44) / 32)) + 1
    where, length, entries = cuts(books.length, books.parts), books.length, books.entries
    width = max(s.stop - s.start for s in where)
    names = [f"s{i}_{j}" for i in range(width) for j in range(limbs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_ = [Neighbours(e) for e in entries]
        kind = np.int64 if limbs == 1 else object
        count = np.zeros((len(where), len(entries[0])), dtype=np.int64)
        sums = np.zeros((len(where), len(entries[0]), width), dtype=kind)
        for _, points in _slices(batches, length):
            for p, (s, book) in enumerate(zip(where, books_, strict=True)):
                at, _ = book.search(points[:, s])
                count[p] += np.bincount(at, minlength=count.shape[1])
                np.add.at(sums[p][:, :s.stop - s.start], at, points[:, s].astype(np.int64) if limbs == 1 else V.integers(points[:, s]))
        p, e = np.nonzero(count)
        out = {"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(count[p, e])}
        for i in range(width):
            for j in range(limbs):
                held = [int(x) >> 32 * j for x in sums[p, e, i]]
                out[f"s{i}_{j}"] = pa.array(held if j == limbs - 1 else [x & 0xFFFFFFFF for x in held], pa.int64())
        yield pa.record_batch(out)

    schema = ", ".join(["part int", "entry int", *(f"{c} bigint" for c in ["n", *names])])
    added = rows.select("x").mapInArrow(run, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names])
    out = {}
    for r in added.collect():  # a row for each entry
        s = where[r["part"]]
        out[r["part"], r["entry"]] = r["n"], [sum(int(r[f"s{i}_{j}"]) << 32 * j for j in range(limbs)) for i in range(s.stop - s.start)]
    return out


def fit_codebooks(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 1024,
    key: str = "vec_id", vector: str = "embedding",
) -> Codebooks:
    """Codebooks after ``rounds`` rounds of assignment and means over all rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows = _kept(vectors, key, vector, scale)
    found = V.commonest_length(rows, "x")
    if found is None:
        return Codebooks([[] for _ in range(parts)], 0, scale, 0.0)
    length, widest = found
    rows = rows.where(F.size("x") == length)
    start = [[int(np.floor(x)) for x in v] for v in _first_entries(rows, entries)]
    books = Codebooks([[tuple(v[s]) for v in start] for s in cuts(length, parts)], length, scale, widest)
    if not start:
        return books
    for _ in range(rounds):
        for (p, e), (n, sums) in _sums(rows, books).items():
            books.entries[p][e] = tuple(s // n for s in sums)
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", *keep: str) -> DataFrame:
    """key, code (binary, a byte for each part), error (squared distances, added), and the columns named in ``keep``."""
    kinds = [vectors.schema[c].dataType.simpleString() for c in (key, *keep)]
    names = [key, "code", "error", *keep]
    schema = f"`{key}` {kinds[0]}, code binary, error bigint" + "".join(f", `{c}` {k}" for c, k in zip(keep, kinds[1:], strict=True))
    where, length, entries = cuts(books.length, books.parts), books.length, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_ = [Neighbours(e) for e in entries]
        for batch, points in _slices(batches, length):
            codes, total = np.zeros((len(points), len(where)), dtype=np.uint8), np.zeros(len(points), dtype=object)
            for p, (s, book) in enumerate(zip(where, books_, strict=True)):
                at, far = book.search(points[:, s])
                codes[:, p] = at
                total = total + (far.astype(np.int64).astype(object) if far.dtype != object else far)
            error = [int(t) if t <= V.MOST else None for t in total]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64()), *batch.columns[1:-1]], names=names)

    rows = _kept(vectors, key, vector, books.scale, *keep).where(F.size("x") == length)
    if not books.entries or not books.entries[0]:
        rows = rows.limit(0)  # no row has an id, or there is none
    return rows.mapInArrow(run, schema)


def with_group_sum(rows: DataFrame, group: str, amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over rows of equal ``group`` (nulls together); null where it leaves 64 bits.

    Sums are reduced in each task first. Few groups are shipped to the rows; more are joined, each group's rows dealt to
    ``SALTS`` pieces so that no group is met in one task."""
    sums = rows.groupBy(F.col(f"`{group}`").alias("__group")).agg(F.sum(F.col(f"`{amount}`").cast("decimal(38,0)")).alias("__sum"))
    sums = sums.select("__group", F.col("__sum").try_cast("bigint").alias(name))
    if collect_bounded(sums) is not None:
        return rows.join(F.broadcast(sums), F.col(f"`{group}`").eqNullSafe(F.col("__group"))).drop("__group")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    sums = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("__mine", salt.cast("int"))
    joined = left.join(sums, F.col(f"`{group}`").eqNullSafe(F.col("__group")) & (F.col("__mine") == F.col("__salt")))
    return joined.drop("__group", "__salt", "__mine")


def compress(vectors: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """key, code (hex), error, label_error, codebooks_sha256."""
    books = fit_codebooks(vectors, scale=scale, key=key, vector=vector)
    coded = write_scratch(encode_vectors(vectors, books, key, vector, label), "codes")
    told = with_group_sum(coded, label, "error", "label_error")
    return told.select(F.col(f"`{key}`").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
