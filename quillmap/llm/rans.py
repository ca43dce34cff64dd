"""Token ids on disk, entropy coded: static range asymmetric numeral systems in interleaved blocks.

One table of frequencies, counted over the whole corpus and scaled to a power of two, serves all blocks.
A block holds whole documents in ascending order and needs nothing but the table to be read. Its ids are dealt
to lanes in turn, each lane with a state of its own, so that one array operation moves all lanes. At every
checkpoint the block keeps the states, the place in the stream and a checksum of the ids up to the next
checkpoint; reading can start at each of them, and stretches of a block can be read in parallel.

Layout below a folder: ``table`` (token, frequency), ``blocks`` (part, block, payload), ``parts`` (part, base:
the ids in all parts before). A payload is a header, the documents, the checkpoints and the stream, all
little-endian, and is described at ``HEADER``. Parquet serves as the container, so that the job's commit keeps
only one attempt of each task and any store Spark knows can hold it.

Defined results: a null text counts as an empty one; rows without an id come first; rows that share an id
follow one another by length and checksum; other columns are not read. An empty table gives files without
blocks. A damaged payload raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.llm.common import row_slices, string_column
from quillmap.llm.token_ids import encoder
from quillmap.session import scratch_dir

#: magic, version, bits of the table's total, lanes, steps between checkpoints, ids, documents, words of the
#: stream, ids in the part before this block, checksum of the table, checksum of what follows the header.
HEADER = struct.Struct("<4sHHIIQQQQII")
MAGIC, VERSION = b"QRNS", 1
TOTAL_BITS = 20
LANES, STEPS = 1024, 256
#: Ids after which a block is closed at the end of its document.
BLOCK_IDS = 1 << 20
#: Distinct words of a generation that a worker remembers while it writes files; a word found again spares its merges.
WORDS_KEPT = 800_000
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Table:
    """Frequencies of the tokens, scaled to sum to 2 ** TOTAL_BITS with at least one for each token that occurs."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.freq = np.asarray(tokens, np.uint32)[order], np.asarray(freq, np.uint64)[order]
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq, dtype=np.uint64)])[:-1]
        self.checksum = zlib.crc32(self.tokens.tobytes() + self.freq.astype("<u8").tobytes())
        self.rank = np.zeros(int(self.tokens[-1]) + 1 if len(tokens) else 1, dtype=np.int64)
        self.rank[self.tokens] = np.arange(len(self.tokens))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.tokens), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    @classmethod
    def from_counts(cls, tokens: np.ndarray, counts: np.ndarray) -> Table:
        total = 1 << TOTAL_BITS
        if not len(tokens):
            return cls(np.zeros(0), np.zeros(0))
        if len(tokens) > total // 2:
            raise ValueError("more tokens than the table can tell apart")
        share = counts.astype(np.float64) / counts.sum()
        freq = np.maximum(1, np.floor(share * total)).astype(np.int64)
        over = int(freq.sum()) - total
        order = np.lexsort((tokens, -freq))
        if over < 0:
            freq[order[0]] -= over
        while over > 0:  # each round takes at most half of what a token has
            take = np.minimum(freq[order] // 2, np.maximum(0, over - np.concatenate([[0], np.cumsum(freq[order] // 2)])[:-1]))
            freq[order] -= take
            over -= int(take.sum())
        return cls(tokens, freq)


def encode_ids(ids: np.ndarray, table: Table, lanes: int, steps: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The stream of 32-bit words, and for each checkpoint the words before it and the states to start with."""
    rank = table.rank[ids]
    freq, cum = table.freq[rank], table.cum[rank]
    state = np.full(lanes, LOW, dtype=np.uint64)
    bits = np.uint64(TOTAL_BITS)
    full = (LOW >> bits) << WORD
    n_steps = -(-len(ids) // lanes)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(n_steps - 1, -1, -1):
        at = step * lanes
        f, c = freq[at:at + lanes], cum[at:at + lanes]
        x = state[:len(f)]
        big = x >= full * f
        if big.any():
            words.append((x[big] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(words[-1])
            x[big] >>= WORD
        q, r = np.divmod(x, f)
        x[:] = (q << bits) + r + c
        if step % steps == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return stream, [(written - w, s) for w, s in marks[::-1]]


def decode_ids(n: int, stream: np.ndarray, at: int, state: np.ndarray, table: Table) -> np.ndarray:
    """``n`` ids from a checkpoint: its place in the stream and its states."""
    lanes, slots, freq, cum = len(state), table.slots, table.freq, table.cum
    state, out = state.copy(), np.empty(n, dtype=np.uint32)
    bits, low = np.uint64(TOTAL_BITS), np.uint64((1 << TOTAL_BITS) - 1)
    for first in range(0, n, lanes):
        x = state[:min(lanes, n - first)]
        slot = x & low
        rank = slots[slot]
        out[first:first + len(x)] = rank
        x >>= bits
        x *= freq[rank]
        x += slot
        x -= cum[rank]
        small = np.flatnonzero(x < LOW)
        if len(small):
            x[small] = x[small] << WORD | stream[at:at + len(small)]
            at += len(small)
    return table.tokens[out]


def encode_block(docs: list[tuple[int | None, np.ndarray]], before: int, table: Table, lanes: int = LANES, steps: int = STEPS) -> bytes:
    ids = np.concatenate([d for _, d in docs])
    lanes = max(1, min(lanes, len(ids) // 64))
    stream, marks = encode_ids(ids, table, lanes, steps)
    known = np.array([k is not None for k, _ in docs], dtype=np.uint8)
    body = [
        np.array([k or 0 for k, _ in docs], dtype="<i8").tobytes(), known.tobytes(),
        np.array([len(d) for _, d in docs], dtype="<u8").tobytes(),
    ]
    for i, (at, state) in enumerate(marks):
        piece = ids[i * steps * lanes:(i + 1) * steps * lanes].astype("<u4")
        body.append(struct.pack("<QI", at, zlib.crc32(piece)) + state.astype("<u8").tobytes())
    body.append(stream.astype("<u4").tobytes())
    rest = b"".join(body)
    return HEADER.pack(MAGIC, VERSION, TOTAL_BITS, lanes, steps, len(ids), len(docs), len(stream), before, table.checksum, zlib.crc32(rest)) + rest


class Block:
    """A payload opened for reading; ``ids(first, last)`` starts at the checkpoint before ``first``."""

    def __init__(self, payload: bytes, table: Table):
        magic, version, bits, self.lanes, self.steps, self.n_ids, n_docs, n_words, self.before, of_table, checksum = HEADER.unpack_from(payload)
        if (magic, version, bits) != (MAGIC, VERSION, TOTAL_BITS):
            raise ValueError("not a block of this format")
        if of_table != table.checksum:
            raise ValueError("the block was written with another table")
        if zlib.crc32(memoryview(payload)[HEADER.size:]) != checksum:
            raise ValueError("the block is damaged")
        self.table, at = table, HEADER.size
        keys = np.frombuffer(payload, "<i8", n_docs, at)
        known = np.frombuffer(payload, np.uint8, n_docs, at + 8 * n_docs)
        self.keys = [int(k) if y else None for k, y in zip(keys, known, strict=True)]
        self.lengths = np.frombuffer(payload, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 17 * n_docs
        self.marks = []
        self.stride = self.steps * self.lanes
        for _ in range(-(-self.n_ids // self.stride)):
            place, crc = struct.unpack_from("<QI", payload, at)
            self.marks.append((place, crc, np.frombuffer(payload, "<u8", self.lanes, at + 12).astype(np.uint64)))
            at += 12 + 8 * self.lanes
        self.stream = np.frombuffer(payload, "<u4", n_words, at).astype(np.uint64)

    def stretch(self, i: int) -> np.ndarray:
        """The ids between checkpoint i and the next, held against their checksum."""
        place, crc, state = self.marks[i]
        ids = decode_ids(min(self.stride, self.n_ids - i * self.stride), self.stream, place, state, self.table)
        if zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError("ids differ from their checksum")
        return ids

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, dtype=np.uint32)
        i = first // self.stride
        found = np.concatenate([self.stretch(j) for j in range(i, -(-last // self.stride))])
        return found[first - i * self.stride:last - i * self.stride]


def count_tokens(ids: DataFrame, dtype: str) -> Table:
    """Counts over all ids; no more rows come to the driver than the vocabulary has tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in row_slices(batches, 64):
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype))
            if len(seen) > len(counts):
                counts, seen = seen.astype(np.int64), counts
            counts[:len(seen)] += seen
        used = np.flatnonzero(counts)
        yield pa.record_batch({"token": pa.array(used.astype(np.int64)), "n": pa.array(counts[used].astype(np.int64))})

    rows = ids.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    return Table.from_counts(rows.column("token").to_numpy(), rows.column("n").to_numpy())


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, add the end id and write the folder described above."""
    spark = docs.sparkSession
    dtype = encoder(tokenizer_path).dtype.str

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, WORDS_KEPT), np.array([end_id], dtype=dtype).tobytes()
        for batch in row_slices(batches, 64):
            ids = [x + end for x in encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.record_batch({
                "key": batch.column(0), "n": pa.array([len(x) for x in ids], pa.int64()),
                "crc": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()),
            })

    ids = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), string_column(text, "text_")).mapInArrow(tokenise, "key bigint, n bigint, crc bigint, ids binary")
    raw = scratch_dir(spark, "token-ids")
    ids.write.option("compression", "zstd").parquet(raw)
    ids = spark.read.schema(ids.schema).parquet(raw)
    table = count_tokens(ids, dtype)
    spark.createDataFrame(pa.table({"token": table.tokens.astype(np.int64), "frequency": table.freq.astype(np.int64)}), "token bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/table")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, docs, held = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in row_slices(batches, 64):
            for k, x in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append((k, np.frombuffer(x, dtype=dtype)))
                held += len(docs[-1][1])
                if held >= BLOCK_IDS:
                    yield _block_row(part, number, docs, before, table, held)
                    number, before, docs, held = number + 1, before + held, [], 0
        if docs:
            yield _block_row(part, number, docs, before, table, held)

    blocks = ids.repartitionByRange("key", "n", "crc").sortWithinPartitions("key", "n", "crc").select("key", "ids")
    blocks.mapInArrow(encode, "part int, block int, n_ids bigint, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    # one row for each task of the writing job
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")


def _block_row(part: int, number: int, docs, before: int, table: Table, held: int) -> pa.RecordBatch:
    return pa.record_batch({
        "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "n_ids": pa.array([held], pa.int64()),
        "payload": pa.array([encode_block(docs, before, table)], pa.binary()),
    })


def read_table_file(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").toArrow()  # at most the vocabulary
    return Table(rows.column("token").to_numpy(), rows.column("frequency").to_numpy())


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    table = read_table_file(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/parts"), "part").select("base", "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1):
            block, base = Block(batch.column("payload")[0].as_py(), table), batch.column("base")[0].as_py()
            ids = block.ids().astype("<u4")
            ends = np.cumsum(block.lengths)
            starts = ends - block.lengths
            yield pa.record_batch({
                key: pa.array(block.keys, pa.int64()), "start": pa.array(base + block.before + starts),
                "n_tokens": pa.array(block.lengths), "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
            })

    return blocks.mapInArrow(decode, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
