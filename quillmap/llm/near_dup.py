"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles. Its sketch has one register for each bucket: the smallest hash that
falls there, kept as its number of leading zeros and a few bits of mantissa, as in HyperMinHash. A set
too small to fill the buckets in one round of hashing goes through more rounds, and an earlier round wins; so every
register is a minimum over the whole set, and two registers agree with the probability of the Jaccard
similarity, plus a known share of chance hits between compressed values.

1. Equal sets are one class, told by a 128-bit hash of the sorted set; its smallest id stands for it.
2. Registers are banded; a band's key is a hash of its registers. Rows per band are the most for which a pair
   at the threshold shares no band with a probability of 1e-8 at most.
3. In each bucket of equal keys a star is drawn: the member that meets most others is the centre, all others
   are paired with it. For members of large buckets the shingles are counted that no other such member has;
   what is left of a set and the sizes bound the similarity of a pair from above, and pairs, and members of a
   bucket, that cannot reach the threshold go. So do pairs whose odd sketches (the parities of a set's counts in
   512 parts of the hash space) differ in more bits than the sets may differ in shingles, as each shingle flips
   one bit; pairs whose registers differ in too many last bits; and pairs whose estimate, corrected for chance hits, lies six standard deviations below the threshold; the
   rest is confirmed on full sets.
4. Confirmed links make components. Centres leave their buckets, and so do buckets whose members are all of one
   component. In the others, members of the main component need no comparison with one another: the next centres
   are taken from the rest, 256 times as many in each round, until nothing is left. So large groups of
   copies cost a few comparisons each, and no two members of different components that share a bucket are
   left uncompared. Nothing is capped. Members of a large bucket are dealt to cuts of bounded size, and what all of
   them need of the bucket goes to each cut.

Texts, registers, sets and band keys pass a broadcast map of the keys they are wanted by (``maybe_among``) before they are
shuffled into a join, so that a round moves what its pairs name, not all documents. Documents that the map shows to be kept
are never shuffled for the result.

Defined results: words are runs of characters other than blank and \\t\\n\\v\\f\\r, A-Z lower-cased. With fewer words than a
shingle has, the whole sequence is the one shingle; null texts and texts without words have an empty set,
linked with nothing. Rows without an id are linked with nothing, have no component and are kept. Rows that share
an id are rows of their own with the same id; if their texts differ, each counts, and of those that ``drop_near_duplicates``
keeps, the one whose whole row has the smallest digest stays. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import maybe_among, only, row_slices, string_column, without, write_scratch
from quillmap.llm.components import connected_components

REGISTERS, MANTISSA_BITS = 252, 10
#: A pair at the threshold is missed with this probability at most.
MISS = 1e-8
SIGMAS = 6.0
#: Members of buckets with more rows than this have their own shingles counted.
LARGE_BUCKET = 8
#: Members of a bucket that go into one cut, about.
CUT_ROWS = 64
#: Columns of an odd sketch, 64 bits in each.
ODD = [f"odd{i}" for i in range(8)]
_U = np.uint64


def rows_per_band(threshold: float, registers: int = REGISTERS) -> int:
    best = 1
    for rows in range(1, 33):
        if (1 - threshold ** rows) ** (registers // rows) <= MISS:
            best = rows
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashes[i:len(words) - size + 1 + i])
    return np.unique(out)


def sketch(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Compressed registers (leading zeros, mantissa) of a non-empty set."""
    n = len(hashes)
    rounds = max(1, math.ceil(registers * (math.log(registers) + 5) / n))
    seeds = np.arange(1, rounds + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)
    g = _mix(hashes[None, :] ^ seeds[:, None])
    bucket = ((g >> _U(32)) * _U(registers)) >> _U(32)
    ranked = np.sort((bucket << _U(48) | np.arange(rounds, dtype=np.uint64)[:, None] << _U(32) | g & _U(0xFFFFFFFF)).ravel())
    first = np.searchsorted(ranked, np.arange(registers, dtype=np.uint64) << _U(48))
    low = ranked[np.minimum(first, len(ranked) - 1)]
    value = low & _U(0xFFFFFFFF)
    for b in np.flatnonzero(low >> _U(48) != np.arange(registers)):  # rare: no round has reached this bucket
        value[b] = (_mix(hashes ^ _U((int(b) + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) >> _U(32)).min()
    fraction, exponent = np.frexp(value.astype(np.float64))
    mantissa = np.where(value > 0, (2 * fraction - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    return ((32 - exponent.astype(np.int64)) << MANTISSA_BITS | mantissa).astype("<u2")


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) keys of (documents, registers)."""
    bands = registers.shape[1] // rows
    cut = registers[:, :bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2])
    for i in range(rows):
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + cut[:, :, i])
    return keys.astype(np.int64)


def chance_hits(n_a: np.ndarray, n_b: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Probability that registers of different hashes are equal after compression, for sets of these sizes."""
    zeros = np.arange(33)[None, :]

    def spread(n):
        load = np.maximum(1.0, n[:, None] / registers)
        return np.exp(load * np.log1p(-(2.0 ** -(zeros + 1)))) - np.where(zeros == 0, 0.0, np.exp(load * np.log1p(-(2.0 ** -np.maximum(zeros, 1)))))

    return (spread(n_a) * spread(n_b)).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance hits."""
    equal, chance = (a == b).mean(axis=1), chance_hits(n_a, n_b, a.shape[1])
    return (equal - chance) / (1 - chance)


def sketch_documents(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """doc, n, set_key, registers for every row; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            n, keys, registers = [], [], []
            for value in batch.column(1).to_pylist():
                hashes = shingle_set(value, size)
                n.append(len(hashes))
                keys.append(hashlib.blake2b(hashes, digest_size=16).digest() if len(hashes) else None)
                registers.append(sketch(hashes).tobytes() if len(hashes) else None)
            yield pa.record_batch({"doc": batch.column(0), "n": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()), "registers": pa.array(registers, pa.binary())})

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), string_column(text, "text_")).mapInArrow(run, "doc bigint, n bigint, set_key binary, registers binary")


#: Columns with the last bits of the registers, 64 in each.
BITS = ["bits0", "bits1", "bits2", "bits3"]


def last_bits(registers: np.ndarray) -> np.ndarray:
    """(documents, 4) of signed 64-bit integers."""
    bits = np.zeros((len(registers), 64 * len(BITS)), dtype=np.uint8)
    bits[:, :registers.shape[1]] = registers & 1
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def differing_bits(threshold: float) -> int:
    """Most last bits in which the registers of a pair at the threshold differ, six deviations up: equal
    hashes agree, and half of the others do."""
    p = (1 - threshold) / 2
    return math.ceil(REGISTERS * p + SIGMAS * math.sqrt(REGISTERS * p * (1 - p)))


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers whose bits are the parities of the set's counts in as many parts of the hash space.

    Two sets differ in at least as many elements as their odd sketches differ in bits."""
    parts = 64 * len(ODD)
    counts = np.bincount((hashes % _U(parts)).astype(np.int64), minlength=parts)
    return np.packbits((counts & 1).astype(np.uint8)).view(">i8").astype(np.int64)


def _bands(classes: DataFrame, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 2048):
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(batch.num_rows, -1)
                keys = band_keys(registers, rows)
                again = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), keys.shape[1]))  # noqa: B023, E731
                yield pa.record_batch({"band": pa.array(keys.ravel()), "doc": again("doc"), "n": again("n")})

    return classes.select("doc", "n", "registers").mapInArrow(run, "band bigint, doc bigint, n bigint")


def _last_bits(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 4096):
            if batch.num_rows:
                bits = last_bits(np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(batch.num_rows, -1))
                yield pa.record_batch({"doc": batch.column("doc"), **{c: pa.array(bits[:, i]) for i, c in enumerate(BITS)}})

    return classes.select("doc", "registers").mapInArrow(run, "doc bigint, " + ", ".join(f"{c} bigint" for c in BITS))


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate does not rule the threshold out."""
    least = threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 4096):
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("r_a", "r_b"))
                good = estimate(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("hashes").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            good = []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(doc, n, hashes, odd sketch) of the documents named in ``wanted``; for rows that share an id, one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            hashes = [shingle_set(t, size) for t in batch.column("text_").to_pylist()]
            odd = np.array([odd_sketch(h) for h in hashes], dtype=np.int64).reshape(len(hashes), len(ODD))
            yield pa.record_batch({
                "doc": batch.column("doc"), "n": pa.array([len(h) for h in hashes], pa.int64()),
                "hashes": pa.array([h.astype("<u8").tobytes() for h in hashes], pa.binary()), **{c: pa.array(odd[:, i]) for i, c in enumerate(ODD)},
            })

    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), string_column(text, "text_"))
    return only(texts, wanted).mapInArrow(run, "doc bigint, n bigint, hashes binary, " + ", ".join(f"{c} bigint" for c in ODD))


def _with_root(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """With ``root``, the component that the document is known to be of."""
    if roots is None:
        return rows.withColumn("root", F.col("doc"))
    return rows.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))


def _own_shingles(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, own): how many shingles of each wanted document no other wanted one has; none are left out."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            hashes = [np.frombuffer(x, "<u8") for x in batch.column("hashes").to_pylist()]
            if hashes:
                docs = np.repeat(batch.column("doc").to_numpy(), [len(h) for h in hashes])
                yield pa.record_batch({"h": pa.array(np.concatenate(hashes).view(np.int64)), "doc": pa.array(docs)})

    rows = only(sets.select("doc", "hashes"), wanted).mapInArrow(explode, "h bigint, doc bigint")
    alone = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("doc").alias("doc")).where("c = 1")
    return alone.groupBy("doc").agg(F.count("*").alias("own"))


def _for_cuts(buckets: DataFrame) -> DataFrame:
    """What is known of each bucket, once for each of its cuts."""
    return buckets.withColumn("cut", F.explode(F.expr(f"sequence(0L, c div {CUT_ROWS})"))).drop("c")


def _feasible(active: DataFrame, percent: int) -> DataFrame:
    """Without the members whose bounds fit no size in their bucket, and no bound their size.

    Of a set of n shingles, at most ``v`` can be shared with another member. A pair needs
    (100 + percent) * least v >= percent * (sum of n), so a partner has at most ``reach`` shingles."""
    active = active.withColumn("reach", F.expr(f"{100 + percent} * v div {percent}") - F.col("n"))
    sizes = active.groupBy("band").agg(F.min("n").alias("least_n"), F.max("reach").alias("most_reach"), F.count("*").alias("left"), F.max("c").alias("c"))
    fits = active.join(_for_cuts(sizes.where("left > 1")), ["band", "cut"]).where("reach >= least_n AND n <= most_reach")
    return fits.drop("reach", "least_n", "most_reach", "left")


def link_documents(docs: DataFrame, size: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n, component for every row of ``docs``: sets of ``size``-word shingles, linked where
    100 * intersection >= percent * union."""
    threshold = percent / 100
    rows = write_scratch(sketch_documents(docs, size, key, text), "sketches")
    known = rows.where("doc IS NOT NULL AND set_key IS NOT NULL")
    classes = known.groupBy("set_key").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = write_scratch(classes, "classes")

    bands = _bands(classes, rows_per_band(threshold))
    shared = write_scratch(bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = write_scratch(maybe_among(bands, shared.select("band")).join(shared, "band"), "members")
    meets = write_scratch(members.groupBy("doc").agg(F.sum("c").alias("meets"), F.max("c").alias("most")), "meets")
    sets = _full_sets(docs, meets.select("doc"), size, key, text)
    roots = tested = None
    twice = known.groupBy("doc").count().where("count > 1")
    if twice.limit(1).count():  # rows that share an id: their classes are linked
        sets = sets.dropDuplicates(["doc", "hashes"])
        both = known.join(twice, "doc", "left_semi").select("doc", "set_key").distinct()
        both = both.join(classes.select("set_key", F.col("doc").alias("b")), "set_key").select("doc", "b")
        both = both.join(both.groupBy("doc").agg(F.min("b").alias("a")), "doc")
        roots = connected_components(both.select("a", "b"))
    sets = write_scratch(sets, "sets")
    large = meets.where(F.col("most") > LARGE_BUCKET).select("doc")
    own = write_scratch(_own_shingles(sets, large).join(twice, "doc", "left_anti"), "own")
    in_large = (F.col("c") > LARGE_BUCKET) & F.col("own").isNotNull()
    parities = sets.select("doc", *ODD).join(twice, "doc", "left_anti")
    about = meets.drop("most").join(_last_bits(maybe_among(classes, meets.select("doc"))), "doc").join(own, "doc", "left").join(parities, "doc", "left")
    cut = F.pmod(F.xxhash64("doc"), F.expr(f"1 + c div {CUT_ROWS}")).alias("cut")
    active = members.join(about, "doc").select(
        "band", cut, "c", "doc", "n", "meets", F.when(in_large, F.col("n") - F.col("own")).otherwise(F.col("n")).alias("v"), *BITS, *ODD, F.lit(False).alias("main"))
    limit = differing_bits(threshold)
    told = ["n", "v", *BITS, *ODD]  # of a centre

    centres_each = 1
    while True:
        active = write_scratch(_feasible(active, percent), "active")
        if not active.limit(1).count():
            break
        slices = F.pmod(F.xxhash64("doc"), F.lit(centres_each))
        best = F.max(F.struct("meets", "doc", *told)).alias("best")
        centres = active.where("NOT main").groupBy("band", slices.alias("slice")).agg(best, F.max("c").alias("c"))
        centres = centres.select("band", "c", F.col("best.doc").alias("centre"), *[F.col(f"best.{x}").alias(f"{x}_centre") for x in told])
        differ = lambda columns: sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_centre"))) for x in columns), F.lit(0))
        pairs = active.join(_for_cuts(centres), ["band", "cut"]).where("doc <> centre")
        pairs = pairs.where((100 + percent) * F.least("v", "v_centre") >= percent * (F.col("n") + F.col("n_centre")))
        pairs = pairs.where((100 + percent) * F.coalesce(differ(ODD), F.lit(0)) <= (100 - percent) * (F.col("n") + F.col("n_centre")))
        pairs = pairs.where(differ(BITS) <= limit)
        pairs = pairs.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if roots is not None:
            side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))  # noqa: B023, E731
            pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
            pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        pairs = write_scratch(pairs, "pairs")
        if pairs.limit(1).count():
            likely = write_scratch(_likely(pairs, maybe_among(classes, _ends(pairs)), threshold), "likely")
            tested = likely if tested is None else tested.unionByName(likely)
            found = write_scratch(_confirmed(likely, maybe_among(sets, _ends(likely)), percent), "links")
            if found.limit(1).count():
                roots = connected_components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        # what has met every centre of its bucket stays only if the bucket still holds several components
        met = active.where("NOT main").groupBy("band", slices.alias("slice")).agg(F.max(F.struct("meets", "doc")).alias("best")).select("band", "best.doc")
        left = _with_root(active.select("band", "doc", "meets", "c").join(met, ["band", "doc"], "left_anti"), roots)
        open_ = left.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max_by("root", F.struct("meets", "doc")).alias("chief"), F.max("c").alias("c"))
        open_ = write_scratch(open_.where("least <> most").select("band", "chief", "c"), "open")
        if not open_.limit(1).count():
            break
        active = maybe_among(active, open_.select("band")).join(_for_cuts(open_), ["band", "cut"])
        active = active.join(met.withColumn("met", F.lit(True)), ["band", "doc"], "left").where("met IS NULL")  # see maybe_among
        active = _with_root(active, roots).select("band", "cut", "c", "doc", "n", "meets", "v", *BITS, *ODD, (F.col("root") == F.col("chief")).alias("main"))
        centres_each *= 256

    of_class = classes.select("set_key", "doc")
    if roots is not None:
        of_class = of_class.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("set_key", F.coalesce("root", "doc").alias("component"))
    else:
        of_class = of_class.withColumnRenamed("doc", "component")
    out = rows.join(of_class, "set_key", "left")
    return out.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept for every row."""
    found = link_documents(docs, size, percent, key, text)
    kept = F.col("doc").eqNullSafe(F.col("component"))
    return found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one of the smallest id, with all columns. Rows without an id stay."""
    found = write_scratch(link_documents(docs, size, percent, key, text), "components")
    gone = write_scratch(found.where("doc <> component").select(F.col("doc").alias("__id")).distinct(), "gone")
    twice = found.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc").alias("__id"))
    twice = write_scratch(twice.join(gone, "__id", "left_anti"), "twice")
    rows = docs.withColumn("__id", F.col(f"`{key}`").cast("bigint"))
    if not twice.limit(1).count():
        return without(rows, gone).drop("__id")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = only(rows, twice).groupBy("__id").agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("__row"))
    return without(rows, gone.unionByName(twice)).drop("__id").unionByName(one.select("__row.*"))
