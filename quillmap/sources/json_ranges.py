"""Elements of a large JSON array without ever holding the file: brackets counted over byte ranges.

Neither the depth nor the string state at the start of a range is known when it is read. A first pass notes for each
range, begun inside a string or not, the state and depth change at its end and the number of commas at every depth
relative to its start. Chained range by range these give the true state, the depth and the index of the first
element. A second pass cuts the ranges at the commas of the outer array; elements that run over borders are put together
by their index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.session import write_scratch
from quillmap.sources import ranges as G

#: An element longer than this makes its file an error; a parsed value has a limit of its own.
MAX_ELEMENT = 16 << 20
INVALID = "not valid JSON"
_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_SIGN = np.zeros(256, dtype=np.int8)
for _c in b"[{":
    _SIGN[_c] = 1
for _c in b"]}":
    _SIGN[_c] = -1
_SPECIAL = (_SIGN != 0)
_SPECIAL[[_QUOTE, _SLASH, _COMMA]] = True
_BLANK = b" \t\r\n"


def marks(block: bytes, run: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, characters) of unescaped quotes, commas and brackets, and the length of the run of backslashes at the
    end; ``run`` is that of the block before."""
    data = np.frombuffer(block, dtype=np.uint8)
    at = np.flatnonzero(_SPECIAL[data])
    ch = data[at]
    slash = at[ch == _SLASH]
    if len(slash) or run:
        number = np.arange(len(slash))
        begins = np.ones(len(slash), dtype=bool)
        begins[1:] = slash[1:] != slash[:-1] + 1
        length = number - np.maximum.accumulate(np.where(begins, number, 0)) + 1
        if len(slash) and slash[0] == 0:        # goes on from the block before
            first = np.cumsum(begins) == 1
            length = length + np.where(first, run, 0)
        before = np.zeros(len(at), dtype=np.int64)
        if len(slash):
            j = np.searchsorted(slash, at - 1)
            hit = (j < len(slash)) & (slash[np.minimum(j, len(slash) - 1)] == at - 1)
            before[hit] = length[j[hit]]
        if len(at) and at[0] == 0 and ch[0] != _SLASH:
            before[0] = run
        new_run = int(length[-1]) if len(slash) and slash[-1] == len(data) - 1 else 0
        keep = (ch != _SLASH) & ~((ch == _QUOTE) & (before % 2 == 1))
        return at[keep], ch[keep], new_run
    return at, ch, 0


def run_before(path: str, start: int) -> int:
    """Backslashes directly before a place of a file."""
    store, name = G.open_store(path)
    run = 0
    with store.open_input_file(name) as f:
        while start > 0:
            size = min(start, 4096)
            data = f.read_at(size, start - size)
            rest = len(data) - len(data.rstrip(b"\\"))
            run += rest
            if rest < size:
                break
            start -= size
    return run


def _blocks(path: str, start: int, stop: int) -> Iterator[bytes]:
    store, name = G.open_store(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        while start < stop and (block := f.read(min(G.BLOCK_BYTES, stop - start))):
            start += len(block)
            yield block


def range_facts(path: str, start: int, stop: int) -> list[dict]:
    """For a start outside and inside a string: state at the end, change of depth, least depth reached, commas by depth and
    brackets by the depth they open, all relative to the start."""
    facts = [{"inside": s, "depth": 0, "least": 0, "commas": {}, "opens": {}} for s in (False, True)]
    run = run_before(path, start)
    for block in _blocks(path, start, stop):
        at, ch, run = marks(block, run)
        quotes = np.cumsum(ch == _QUOTE)
        odd = quotes % 2 == 1
        for fact in facts:
            outside = odd == fact["inside"]
            sign = _SIGN[ch] * outside
            depth = fact["depth"] + np.cumsum(sign, dtype=np.int64)
            for name, which in (("commas", (ch == _COMMA) & outside), ("opens", sign == 1)):
                for d, n in zip(*np.unique(depth[which], return_counts=True)):
                    fact[name][int(d)] = fact[name].get(int(d), 0) + int(n)
            if len(at):
                fact["depth"], fact["least"] = int(depth[-1]), min(fact["least"], int(depth.min()))
                fact["inside"] ^= bool(odd[-1])
    return facts


def elements(path: str, start: int, stop: int, inside: bool, depth: int, index: int) -> Iterator[tuple[int, bytes | None, bool]]:
    """(index, bytes, whole) of the parts of the outer array's elements that lie in a range; None for too many bytes."""
    run, parts, size, whole = run_before(path, start), [], 0, False

    def part():
        return index, None if size > MAX_ELEMENT else b"".join(parts)

    for block in _blocks(path, start, stop):
        at, ch, run = marks(block, run)
        odd = np.cumsum(ch == _QUOTE) % 2 == 1
        outside = odd == inside
        sign = _SIGN[ch] * outside
        after = depth + np.cumsum(sign, dtype=np.int64)
        opens, closes = (sign == 1) & (after == 1), (sign == -1) & (after == 0)
        commas = (ch == _COMMA) & outside & (after == 1)
        begin = 0
        for i in np.flatnonzero(opens | closes | commas):
            cut = int(at[i])
            if not opens[i]:
                size += cut - begin
                parts = parts + [block[begin:cut]] if size <= MAX_ELEMENT else []
                yield (*part(), whole)
                index += int(commas[i])
            begin, parts, size, whole = cut + 1, [], 0, True
            if closes[i]:
                whole = False
        if len(at):
            depth, inside = int(after[-1]), bool(inside ^ odd[-1])
        if depth > 0:
            size += len(block) - begin
            parts = parts + [block[begin:]] if size <= MAX_ELEMENT else []
    if depth > 0 and size:
        yield (*part(), False)


FACTS = "path string, start bigint, stop bigint, length bigint, {} first int, last int, error string"
STATES = "".join(f"inside{s} boolean, depth{s} bigint, least{s} bigint, commas{s} map<bigint,bigint>, opens{s} map<bigint,bigint>, " for s in (0, 1))


def _facts(files: DataFrame, range_bytes: int) -> DataFrame:
    fields = [("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("length", pa.int64())]
    for s in (0, 1):
        fields += [(f"inside{s}", pa.bool_()), (f"depth{s}", pa.int64()), (f"least{s}", pa.int64()), *[(f"{x}{s}", pa.map_(pa.int64(), pa.int64())) for x in ("commas", "opens")]]
    schema = pa.schema([*fields, ("first", pa.int32()), ("last", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = dict(r)
                try:
                    for s, fact in enumerate(range_facts(r["path"], r["start"], r["stop"])):
                        row |= {f"{k}{s}": list(v.items()) if isinstance(v, dict) else v for k, v in fact.items()}
                    shown = b"".join(b.strip(_BLANK)[:1] + b.strip(_BLANK)[-1:] for b in _blocks(r["path"], r["start"], r["stop"]))
                    row |= {"first": shown[0] if shown else None, "last": shown[-1] if shown else None}
                except OSError as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ranges = G.file_ranges(files, range_bytes).join(files.select("path", "length"), "path").select("path", "start", "stop", "length")
    return G.spread_ranges(ranges).mapInArrow(run, FACTS.format(STATES))


PLACES = "path string, start bigint, stop bigint, inside boolean, depth bigint, index bigint, error string"


def _chain(facts: DataFrame) -> DataFrame:
    """The true state at the start of each range; an error for files that are no single array.

    A group is the ranges of a file, one small row for each."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()),
                        ("index", pa.int64()), ("error", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        error = next((r["error"] for r in rows if r["error"]), None)
        inside, depth, index, arrays, out = False, 0, 0, 0, []
        ends = [x for r in rows for x in (r["first"], r["last"]) if x is not None]
        if not error and (not ends or ends[0] != ord("[") or ends[-1] != ord("]")):
            error = INVALID
        for r in [] if error else rows:
            s = int(inside)
            out.append({"path": r["path"], "start": r["start"], "stop": r["stop"], "inside": inside, "depth": depth, "index": index})
            commas, opens = dict(r[f"commas{s}"]), dict(r[f"opens{s}"])
            arrays += opens.get(1 - depth, 0)
            if depth + r[f"least{s}"] < 0 or arrays > 1 or commas.get(-depth, 0):
                error = INVALID
                break
            index += commas.get(1 - depth, 0)
            depth, inside = depth + r[f"depth{s}"], r[f"inside{s}"]
        if not error and (depth or inside):
            error = INVALID
        if error:
            out = [{"path": rows[0]["path"], "error": error}]
        return pa.Table.from_pylist(out, schema=schema)

    return facts.groupBy("path").applyInArrow(run, PLACES)


def array_elements(files: DataFrame, range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, position, text), (path, message)): the elements of files that are one array each."""
    places = write_scratch(_chain(_facts(files, G.RANGE_BYTES if range_bytes is None else range_bytes)), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(out, path, start):
            index, data, whole = zip(*out)
            n = len(out)
            return pa.record_batch({
                "path": pa.array([path] * n), "position": pa.array(index, pa.int64()), "start": pa.array([start] * n, pa.int64()),
                "data": pa.array(data, pa.binary()), "whole": pa.array(whole, pa.bool_())})

        for batch in batches:
            for r in batch.to_pylist():
                out, held = [], 0
                for found in elements(r["path"], r["start"], r["stop"], r["inside"], r["depth"], r["index"]):
                    out.append(found)
                    held += len(found[1] or b"") + 64
                    if held > G.BATCH_BYTES:
                        yield rows(out, r["path"], r["start"])
                        out, held = [], 0
                if out:
                    yield rows(out, r["path"], r["start"])

    good = places.where("error IS NULL")
    parts = G.spread_ranges(good.drop("error")).mapInArrow(run, "path string, position bigint, start bigint, data binary, whole boolean")
    parts = write_scratch(parts, "elements")
    mended = parts.where("NOT whole").groupBy("path", "position").agg(
        F.sum(F.coalesce(F.octet_length("data"), F.lit(MAX_ELEMENT + 1))).alias("size"),
        F.array_sort(F.collect_list(F.struct("start", "data"))).alias("parts"))
    whole = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["data"]))
    mended = mended.select("path", "position", F.when(F.col("size") <= MAX_ELEMENT, whole).alias("data"))
    rows = parts.where("whole").select("path", "position", "data").unionByName(mended)
    # the blank between the brackets of an empty array is no element
    text = F.make_valid_utf8(F.col("data").cast("string"))
    last = rows.groupBy("path").agg(F.max("position").alias("last"))
    rows = rows.join(last, "path").select("path", "position", text.alias("text"), "last")
    rows = rows.where(~((F.col("last") == 0) & F.coalesce(F.trim(F.translate("text", "\t\r\n", "   ")) == "", F.lit(False)))).drop("last")
    return rows, places.where("error IS NOT NULL").select("path", F.col("error").alias("message"))
