"""Hard-negative mining with rotated one-bit codes.

An index holds, for each vector, the signs of its rotated components (the code), the inner product of the rotated
vector with its code's unit vector (the alignment) and the length of what the code leaves over (the residual). For an anchor, whose
rotated components are cut to a few bits, the inner product with a code's unit vector is estimated by popcounts of the code with
each bit's plane, within a known error. By Cauchy-Schwarz the score then lies within the alignment's share of that estimate, plus or
minus the residual times what the anchor has outside the code's direction. This interval is certain, not likely; rows whose
interval cannot reach an anchor's results are dropped, and all others are scored in integers.

1. Positives: of the rows of the anchor's label, those whose interval reaches the k-th best score so far (or the k-th best
   lower end, which is as good) are scored; each task keeps k of an anchor.
2. Negatives: each positive's score gives a band of scores. Of rows of other labels, those whose interval meets a band and
   reaches its third best score so far are scored.

Anchors are dealt to blocks and rows to groups; a task streams the rows of a group past a block in tiles of bounded size. The
number of tasks is bounded, so copies of the inputs and the rows that tasks send on are, too.

Defined results: rows without an id or a label, without a vector, or with a null, NaN or infinite component take no part. Vectors meet
those of their own length. A repeated row is a row of its own; an id is an anchor once, with its smallest label and vector, and rows of
its id are none of its positives. Scores beyond 64 bits are returned, and ranked, as the nearest 64-bit integer. Equal scores rank by
the smaller id. Anchors without positives, and positives without a negative in their band, have no rows. Other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm import vectors as V
from quillmap.llm.common import write_scratch

#: Bits that an anchor's rotated components are cut to.
PLANES = 4
#: Components of a block of anchors; rows of a group; cells of blocks and groups, each a part of a task's work.
BLOCK_COMPONENTS, ROWS_IN_GROUP, CELLS = 1 << 20, 8192, 8192
#: Anchors and rows whose intervals are held at a time.
ANCHOR_TILE, ROW_TILE = 256, 512
#: Pairs that are scored at a time; a tile with a larger share of pairs to score is multiplied as a whole.
PAIRS, DENSE = 1 << 16, 1 / 32
#: Share of the product of two lengths that rounding may cost an interval.
ROUNDING = 1e-9
NONE = -V.MOST
_U = np.uint64


@functools.lru_cache(maxsize=8)
def rotation(length: int) -> np.ndarray:
    """The same orthogonal matrix in every task."""
    q, r = np.linalg.qr(np.random.default_rng(20_011 + length).standard_normal((length, length)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, length = bits.shape
    wide = np.zeros((n, -(-length // 64) * 64), dtype=bool)
    wide[:, :length] = bits
    return np.packbits(wide, axis=1).view("<u8").reshape(n, -1).astype(_U)


class Codes:
    """Code, alignment, residual and length of each row of a matrix."""

    def __init__(self, x: np.ndarray):
        self.size = np.sqrt((x * x).sum(axis=1))
        turned = x @ rotation(x.shape[1])
        self.words = _packed(turned >= 0)
        self.along = np.abs(turned).sum(axis=1) / np.sqrt(max(1, x.shape[1]))
        self.left = np.sqrt(np.maximum(0.0, self.size ** 2 - self.along ** 2))


class Anchors:
    """Rotated anchors, cut to bit planes."""

    @np.errstate(all="ignore")
    def __init__(self, x: np.ndarray):
        length = max(1, x.shape[1])
        turned = x @ rotation(x.shape[1])
        self.length, self.size = x.shape[1], np.sqrt((x * x).sum(axis=1))
        self.low = turned.min(axis=1, initial=0.0)
        self.step = np.maximum((turned.max(axis=1, initial=0.0) - self.low) / ((1 << PLANES) - 1), 1e-300)
        cut = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1)
        off = turned - (self.low[:, None] + self.step[:, None] * cut)
        self.root = np.sqrt(length)
        self.error = np.abs(off).sum(axis=1) / self.root
        cut = cut.astype(np.int64)
        self.planes = [_packed(cut >> j & 1 > 0) for j in range(PLANES)]
        self.heavy = sum(np.bitwise_count(p).sum(axis=1).astype(np.int64) << j for j, p in enumerate(self.planes))

    def intervals(self, some: slice, codes: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) ends of the scores of some anchors with some rows."""
        words = codes.words[rows]
        signs = 2.0 * np.bitwise_count(words).sum(axis=1) - self.length
        both = np.zeros((len(self.low[some]), len(words)), dtype=np.int32)
        for j, plane in enumerate(self.planes):
            for w in range(words.shape[1]):
                both += np.bitwise_count(plane[some, w, None] & words[None, :, w]).astype(np.int32) << j
        inner = self.low[some, None] * signs + self.step[some, None] * (2 * both - self.heavy[some, None])
        inner /= self.root
        error, size = self.error[some, None], self.size[some, None]
        outside = np.sqrt(np.maximum(0.0, size ** 2 - np.maximum(0.0, np.abs(inner) - error) ** 2))
        reach = codes.along[rows] * error + codes.left[rows] * outside + ROUNDING * size * codes.size[rows] + ROUNDING
        middle = codes.along[rows] * inner
        return middle - reach, middle + reach


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row; minus infinity where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Best:
    """The k best (score, id) of each slot, the smaller id of equal scores."""

    def __init__(self, slots: int, k: int):
        self.k, self.score, self.id = k, np.full((slots, k), NONE), np.full((slots, k), V.MOST)
        self.n = np.zeros(slots, dtype=np.int64)

    def least(self, slots) -> np.ndarray:
        """Scores that new ones must reach."""
        return np.where(self.n[slots] == self.k, self.score[slots, -1].astype(np.float64), -np.inf)

    def floor(self) -> np.ndarray:
        """Of each slot, the score that is still of use."""
        return np.where(self.n == self.k, self.score[:, -1], NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        had = np.arange(self.k)[None, :] < self.n[touched, None]
        slot = np.concatenate([np.repeat(touched, self.n[touched]), slot])
        score = np.concatenate([self.score[touched][had], score])
        id_ = np.concatenate([self.id[touched][had], id_])
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        first = place < self.k
        self.score[slot[first], place[first]], self.id[slot[first], place[first]] = score[first], id_[first]
        self.n[touched] = np.minimum(self.k, np.bincount(np.searchsorted(touched, slot), minlength=len(touched)))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of all that is held."""
        slot, place = np.nonzero(np.arange(self.k)[None, :] < self.n[:, None])
        return slot, self.score[slot, place], self.id[slot, place]


class Block:
    """Anchors of one block and length, and what a task finds for them.

    Without bands it looks for the best rows of the anchor's own label, with bands for the best of other labels in each."""

    def __init__(self, parts: list[tuple], length: int, k: int, banded: bool):
        self.id, self.label, vectors = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
        self.vectors, self.anchors, self.k, self.scored = vectors.reshape(len(self.id), length), None, k, 0
        self.anchors = Anchors(self.vectors)
        self.bands = None
        if banded:
            bands = [b for p in parts for b in p[3]]
            self.width = max(1, max(map(len, bands)))
            self.bands = np.tile(np.array([np.inf, -np.inf]), (len(bands), self.width, 1))
            self.exact = np.tile(np.array([1, 0]), (len(bands), self.width, 1))
            for i, of in enumerate(bands):
                for j, ends in enumerate(of):
                    self.bands[i, j] = self.exact[i, j] = ends
        self.best = Best(len(self.id) * (self.width if banded else 1), k)

    @np.errstate(all="ignore")  # ends that are no numbers, of very large components, drop nothing
    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        codes = Codes(vectors)
        for a in range(0, len(self.id), ANCHOR_TILE):
            some = slice(a, a + ANCHOR_TILE)
            for b in range(0, len(ids), ROW_TILE):
                rows = slice(b, b + ROW_TILE)
                low, high = self.anchors.intervals(some, codes, rows)
                same = self.label[some, None] == labels[None, rows]
                if self.bands is None:
                    self._positives(a, b, low, high, same & (self.id[some, None] != ids[None, rows]), ids, vectors)
                else:
                    self._negatives(a, b, low, high, ~same, ids, vectors)

    def _score(self, a: int, b: int, alive: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs of a tile that are left."""
        q, c = np.nonzero(alive)
        self.scored += len(q)
        if len(q) > DENSE * alive.size:
            score = V.products(self.vectors[a:a + alive.shape[0]], vectors[b:b + alive.shape[1]])[q, c]
            return q + a, c + b, score
        q, c = q + a, c + b
        parts = [V.row_products(self.vectors[q[i:i + PAIRS]], vectors[c[i:i + PAIRS]]) for i in range(0, len(q), PAIRS)]
        return q, c, np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def _positives(self, a, b, low, high, fits, ids, vectors) -> None:
        mine = np.arange(a, a + len(low))
        least = self.best.least(mine)
        if (self.best.n[mine] < self.k).any():
            least = np.maximum(least, kth_largest(np.where(fits, low, -np.inf), self.k))
        q, c, score = self._score(a, b, fits & ~(high < least[:, None]), vectors)
        good = score >= self.best.floor()[q]
        self.best.add(q[good], score[good], ids[c[good]])

    def _negatives(self, a, b, low, high, fits, ids, vectors) -> None:
        alive = np.zeros(fits.shape, dtype=bool)
        mine = np.arange(a, a + len(low))
        for j in range(self.width):
            from_, to = self.bands[mine, j, 0, None], self.bands[mine, j, 1, None]
            slots = mine * self.width + j
            least = np.maximum(from_[:, 0], self.best.least(slots))
            if (self.best.n[slots] < self.k).any():
                sure = np.where(fits & (low >= from_) & (high <= to), low, -np.inf)
                least = np.maximum(least, kth_largest(sure, self.k))
            alive |= ~(high < least[:, None]) & ~(low > to)
        q, c, score = self._score(a, b, alive & fits, vectors)
        floor = self.best.floor()
        for j in range(self.width):
            slots = q * self.width + j
            good = (score >= np.maximum(self.exact[:, j, 0], floor[j::self.width])[q]) & (score <= self.exact[:, j, 1][q])
            self.best.add(slots[good], score[good], ids[c[good]])


def index_rows(vectors: DataFrame, scale: int, key: str, label: str, vector: str) -> DataFrame:
    """id, label, x (scaled vector), slot; only rows that take part."""
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), V.scaled(vector, scale).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & V.usable("x"))
    return rows.withColumn("slot", F.monotonically_increasing_id())


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, k: int) -> DataFrame:
    """(anchor_id, band, id, score): the best k of each anchor, or of each of its bands, in each group of rows."""
    banded = "bands" in anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, {}, None

        def found():
            for block in (held or {}).values():
                slot, score, id_ = block.best.rows()
                anchor, band = np.divmod(slot, block.width) if banded else (slot, np.zeros_like(slot))
                low = block.exact[anchor, band, 0] if banded else band
                high = block.exact[anchor, band, 1] if banded else band
                yield pa.record_batch({"anchor_id": block.id[anchor], "low": low, "high": high, "id": id_, "score": score})

        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            lengths = batch.column("length").to_numpy()
            ends = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(lengths) != 0)) + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if a == b:
                    continue
                part, length = batch.slice(a, b - a), int(lengths[a])
                if cells[a] != cell:
                    yield from found()
                    cell, parts, held = cells[a], {}, None
                ids, labels, x = part.column("id").to_numpy(), part.column("label").to_numpy(), V.matrix(part.column("x"), length)
                if kinds[a] == 0:
                    bands = [[(e["low"], e["high"]) for e in of] for of in part.column("bands").to_pylist()] if banded else None
                    parts.setdefault(length, []).append((ids, labels, x.ravel(), bands))
                    continue
                if held is None:  # anchors are sorted before rows
                    held = {n: Block(p, n, k, banded) for n, p in parts.items()}
                if length in held:
                    held[length].meet(ids, labels, x)
        yield from found()

    no_bands = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    left = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        (F.col("group") * blocks + F.col("block")).cast("int").alias("cell"), F.lit(0).alias("kind"), F.size("x").alias("length"), "id", "label", "x",
        (F.col("bands") if banded else no_bands).alias("bands"))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        (F.pmod("slot", F.lit(groups)) * blocks + F.col("block")).cast("int").alias("cell"), F.lit(1).alias("kind"), F.size("x").alias("length"), "id", "label", "x",
        no_bands.alias("bands"))
    dealt = left.unionByName(right).repartitionById(groups * blocks, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(run, "anchor_id bigint, low bigint, high bigint, id bigint, score bigint")


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent / 100 of a score, rounded into the band; ended at 64 bits."""
    exact = score.cast("decimal(20,0)") * F.lit(percent) / 100
    rounded = (F.ceil(exact) if up else F.floor(exact)).cast("decimal(30,0)")
    return F.least(F.greatest(rounded, F.lit(NONE).cast("decimal(30,0)")), F.lit(V.MOST).cast("decimal(30,0)")).cast("bigint")


def mine_hard_negatives(
    vectors: DataFrame, asked: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``asked`` (a column over ``id``) holds. Of each anchor and positive the best ``negatives`` rows of
    other labels whose score is at least ``low`` and at most ``high`` percent of the positive's."""
    rows = write_scratch(index_rows(vectors, scale, key, label, vector), "rows")
    total, longest = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    anchors = rows.where(asked).groupBy("id").agg(F.min(F.struct("label", "x")).alias("a")).select("id", "a.label", "a.x")
    blocks = max(1, -(-anchors.count() * max(1, longest or 0) // BLOCK_COMPONENTS))
    groups = max(1, min(-(-total // ROWS_IN_GROUP), CELLS // blocks))
    anchors = write_scratch(anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "anchors")

    near = _meet(anchors, rows, blocks, groups, positives)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id", "copy")
    near = near.withColumn("copy", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    near = near.withColumns({"low": _share(F.col("positive_score"), low, True), "high": _share(F.col("positive_score"), high, False)})
    near = write_scratch(near, "positives")

    bands = near.where("low <= high").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set(F.struct("low", "high")).alias("bands"))
    far = _meet(anchors.join(bands, "id"), rows, blocks, groups, negatives)
    order = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "id", "copy")
    far = far.withColumn("copy", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    far = far.select("anchor_id", "low", "high", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "low", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
