"""Chat formatting after the collapse of cumulative snapshots.

Logs often hold a conversation several times, each time with a few more turns. A rolling hash is kept along
each conversation, so that every prefix of turns has one value. A conversation whose whole value is the value
of a proper prefix of another, or of the whole of one with a smaller id, is dropped by anti-joins; the maximal
conversations are rendered.

The hash is a polynomial over two primes and can be put together from stretches. Turns are sorted into ranges of
conversation, turn, role and the beginning of the text, which is part of the order within a range, too; each task hashes its own stretch of a conversation, and the few conversations that run over the border of
two tasks are completed from one summary for each task. So a single conversation may be as long as the table.

Defined results: turns without a conversation id belong to none and are left out. Turns are ordered by turn,
role and text, nulls first; a null role or text differs from an empty one in the hash and is rendered as an
empty string. Repeated rows are turns of their own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import string_column, write_scratch

#: Characters of a text that decide its range.
RANGE_KEY = 256
PRIMES = ((1 << 61) - 1, (1 << 61) - 31)
BASES = (1_111_111_111_111_111_111, 987_654_321_987_654_321)


def turn_value(role: str | None, text: str | None) -> tuple[int, int]:
    parts = [b"-" if x is None else b"%d:" % len(x.encode()) + x.encode() for x in (role, text)]
    digest = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    return tuple(1 + int.from_bytes(digest[8 * i:8 * i + 8], "little") % (p - 1) for i, p in enumerate(PRIMES))


def append(value: tuple[int, int], turn: tuple[int, int]) -> tuple[int, int]:
    return tuple((v * b + t) % p for v, t, b, p in zip(value, turn, BASES, PRIMES, strict=True))


def concat(head: tuple[int, int], tail: tuple[int, int], turns: int) -> tuple[int, int]:
    """The value of a head followed by a tail of so many turns."""
    return tuple((h * pow(b, turns, p) + t) % p for h, t, b, p in zip(head, tail, BASES, PRIMES, strict=True))


def hash_stretches(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text sorted into ranges; position, h1, h2 within the task's stretch, last: whether the
    stretch ends there; part, and stretch counted within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stretch, conv, place, value = TaskContext.get().partitionId(), -1, None, 0, (0, 0)
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = []
            for c, role, text in zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if stretch < 0 or c != conv:
                    stretch, conv, place, value = stretch + 1, c, 0, (0, 0)
                place, value = place + 1, append(value, turn_value(role, text))
                rows.append((place, *value, stretch))
            if not rows:
                continue
            place_, h1, h2, stretch_ = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            ends = [a[3] != b[3] for a, b in zip(rows, rows[1:], strict=False)]
            if held is not None:
                yield _with_last(held, held_ends + [held_at != rows[0][3]])
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, place_, h1, h2, pa.array([part] * len(rows), pa.int32()), stretch_],
                names=[*batch.schema.names, "position", "h1", "h2", "part", "stretch"])
            held_ends, held_at = ends, rows[-1][3]
        if held is not None:
            yield _with_last(held, held_ends + [True])

    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema)
    # ranges must follow the order of whole texts, whose beginnings do; keys of bounded size may go to the driver's sample
    spread = turns.withColumn("c", F.substring("text", 1, RANGE_KEY))
    spread = spread.repartitionByRange("conv", "turn", "role", "c").drop("c").sortWithinPartitions(*order)
    return spread.mapInArrow(run, f"{kind}, position bigint, h1 bigint, h2 bigint, part int, stretch bigint, last boolean")


def _with_last(batch: pa.RecordBatch, last: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(last, pa.bool_())], names=[*batch.schema.names, "last"])


def join_stretches(rows: DataFrame) -> DataFrame:
    """The same rows with position, h1, h2 and last of whole conversations."""
    state = F.struct("stretch", "position", "h1", "h2", "conv")
    ends = rows.groupBy("part").agg(F.max(state).alias("end"), F.max(F.when(F.col("stretch") == 0, state)).alias("start")).orderBy("part").collect()  # a row for each task
    before: dict[int, tuple] = {}  # part -> what its first stretch continues
    running: set[int] = set()  # parts whose last stretch goes on in the next
    carry, previous = None, None
    for r in ends:
        start, end = r["start"], r["end"]
        if carry is not None and carry[0] == start["conv"]:
            before[r["part"]] = carry[1:]
            running.add(previous)
        n, value = end["position"], (end["h1"], end["h2"])
        if end["stretch"] == 0 and r["part"] in before:
            had, head = before[r["part"]]
            n, value = had + n, concat(head, value, end["position"])
        carry, previous = (end["conv"], n, value), r["part"]
    final = {r["part"]: r["end"]["stretch"] for r in ends if r["part"] in running}
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            part, stretch = columns["part"].to_pylist(), columns["stretch"].to_pylist()
            if not any(p in before or p in final for p in set(part)):
                yield batch
                continue
            place, h1, h2, last = (columns[c].to_pylist() for c in ("position", "h1", "h2", "last"))
            for i, (p, s) in enumerate(zip(part, stretch, strict=True)):
                if s == final.get(p):
                    last[i] = False
                if s == 0 and p in before:
                    n, head = before[p]
                    h1[i], h2[i] = concat(head, (h1[i], h2[i]), place[i])
                    place[i] += n
            columns |= {"position": pa.array(place, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "last": pa.array(last, pa.bool_())}
            yield pa.record_batch(columns)

    return rows.mapInArrow(run, rows.schema)


def format_chats(
    conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>",
    key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """key, turn, position, n_turns, role, rendered: the turns of all maximal conversations in chat markup.

    A turn is rendered as start, role, line end, text, end, line end. Strings of the markup inside a text are
    broken by a zero-width space, so that no text can end its turn.
    """
    turns = conversations.select(F.col(f"`{key}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), string_column(role, "role"), string_column(text, "text"))
    rows = write_scratch(hash_stretches(turns.where("conv IS NOT NULL")), "stretches")
    rows = write_scratch(join_stretches(rows), "turns")
    value = ["h1", "h2", "position"]
    whole = rows.where("last").groupBy(*value).agg(F.min("conv").alias("conv"))
    prefixes = rows.where("NOT last").select(*value).distinct()
    kept = whole.join(prefixes, value, "left_anti").select("conv", F.col("position").alias("n_turns"))
    safe = F.coalesce("text", F.lit(""))
    for mark in (start, end):
        safe = F.replace(safe, F.lit(mark), F.lit(mark[0] + "\u200b" + mark[1:]))
    who = F.coalesce("role", F.lit(""))
    rendered = F.concat(F.lit(start), who, F.lit("\n"), safe, F.lit(end + "\n"))
    return rows.join(kept, "conv").select(F.col("conv").alias(key), F.col("turn").alias(turn), "position", "n_turns", F.col("role").alias(role), rendered.alias("rendered"))
