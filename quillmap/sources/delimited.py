"""Delimited text of any size: every file is cut into byte ranges, quoted line breaks or not.

Whether a range begins inside a quoted cell is not known when it is read. So a first pass follows each range in both
states and notes, for either, how many records begin there and the state at its end: two numbers and two bits
a range. Chained range by range they tell the true state and the index of the first record. A second pass parses
the ranges; a record that runs over a border comes in fragments, which are put together by its index.

A quote opens a cell only where the cell begins; elsewhere it stands for itself. Blank lines between records are skipped. A row
with fewer cells than the header has NULLs, surplus cells are named ``_c<i>``. An empty cell is NULL, an empty
quoted one an empty text. Records and headers of more than ``MAX_RECORD`` bytes are errors of their file.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.session import write_scratch
from quillmap.sources import ranges as G

csv.field_size_limit(sys.maxsize)
TOO_LONG = "a record is longer than {} bytes"


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header: trimmed, ``_c<i>`` for an empty cell, ``name.1`` for a repeated one."""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = base = (cell or "").strip() or f"_c{i}"
        n = 0
        while name in taken:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
        taken.add(name)
    return names


def is_open(text: str, sep: str, inside: bool = False) -> bool:
    """Whether a quoted cell is open after a line that began in the given state."""
    if '"' not in text:
        return inside
    at, n = 0, len(text)
    while True:
        if not inside:
            while at < n and text[at] != '"':       # at a cell's start
                at = text.find(sep, at) + 1
                if not at:
                    return False
            if at >= n:
                return False
            inside, at = True, at + 1
        close = text.find('"', at)
        if close < 0:
            return True
        if text[close + 1:close + 2] == '"':
            at = close + 2
            continue
        inside = False
        at = text.find(sep, close + 1) + 1          # what follows a closing quote belongs to its cell
        if not at:
            return False


def cells_of(record: str, sep: str) -> list[str | None]:
    if '"' not in record:
        return [c or None for c in record.split(sep)]
    return next(csv.reader([record], delimiter=sep, quoting=csv.QUOTE_NOTNULL), [])


def _pieces(lines: list[str | None]) -> Iterator[tuple[str | None, str]]:
    """(line, its line break); carriage returns end lines too."""
    for line in lines:
        if line is None or "\r" not in line:
            yield line, "\n"
            continue
        *parts, last = line.split("\r")
        for part in parts[:-1]:
            yield part, "\r"
        yield parts[-1], "\r\n" if not last else "\r"
        if last:
            yield last, "\n"


class Records:
    """Puts the lines of a range together to records.

    ``feed`` gives (index in the range, text, complete); a record that began before the range has the index -1. The text
    of one that is too long is None."""

    def __init__(self, sep: str, inside: bool):
        self.sep, self.inside, self.nth = sep, inside, -1
        self.parts: list[str] | None = [] if inside else None      # None: between records
        self.size, self.over = 0, False

    def feed(self, piece: str | None, ending: str) -> tuple[int, str | None, bool] | None:
        if self.parts is None:
            if piece == "":
                return None
            self.nth, self.parts, self.size, self.over = self.nth + 1, [], 0, False
        if piece is None:
            self.over, self.inside = True, False
        else:
            self.inside = is_open(piece, self.sep, self.inside)
            self.size += len(piece) + len(ending)
            self.over |= self.size > G.MAX_RECORD
            if self.over:
                self.parts.clear()
            else:
                self.parts += [piece, ending]
        if self.inside:
            return None
        text = None if self.over else "".join(self.parts[:-1])
        head, self.parts = self.nth < 0, None
        return self.nth, text, not head

    def rest(self) -> tuple[int, str | None, bool] | None:
        """The record that is open at the end."""
        if self.parts is None or not (self.parts or self.over):
            return None
        return self.nth, None if self.over else "".join(self.parts), False


def read_header(path: str, sep: str) -> list[str | None] | None:
    """The cells of a file's first record; None if it is too long."""
    first = Records(sep, False)
    for lines in G.lines_of(path, 0, G.MAX_RECORD + G.BLOCK_BYTES):
        for piece, ending in _pieces(lines):
            if (done := first.feed(piece, ending)) is not None:
                return None if done[1] is None else cells_of(done[1], sep)
    done = first.rest()
    return [] if done is None else None if done[1] is None else cells_of(done[1], sep)


def _facts(files: DataFrame, sep: str, range_bytes: int | None) -> DataFrame:
    """Of each range: records that begin there and state at the end, for both states at its start; whether a line is
    too long; in the first range the header's cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                n, state, over, header, error = [0, 0], [False, True], False, None, None
                try:
                    if start == 0:
                        header = read_header(path, sep)
                        over = header is None
                    for lines in G.lines_of(path, start, stop):
                        if not any(x is None or '"' in x or "\r" in x for x in lines):     # no line changes a state
                            found = sum(1 for x in lines if x)
                            for s in (0, 1):
                                n[s] += 0 if state[s] else found
                            continue
                        for piece, _ in _pieces(lines):
                            over |= piece is None
                            for s in (0, 1):
                                n[s] += not state[s] and piece != ""
                                state[s] = piece is not None and is_open(piece, sep, state[s])
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, start, stop, *n, *state, over, header, error))
            names = ["path", "start", "stop", "n0", "n1", "end0", "end1", "over", "header", "error"]
            kinds = [pa.string(), *[pa.int64()] * 4, *[pa.bool_()] * 3, pa.list_(pa.string()), pa.string()]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    ranges = G.spread_ranges(G.file_ranges(files, range_bytes))
    return ranges.mapInArrow(run, (
        "path string, start bigint, stop bigint, n0 bigint, n1 bigint, end0 boolean, end1 boolean, over boolean, "
        "header array<string>, error string"))


PLACES = "path string, start bigint, stop bigint, inside boolean, base bigint, names array<string>, split boolean"


def _chain(facts: DataFrame) -> DataFrame:
    """The true state at the start of each range, the index of its first record, its file's column names, and whether
    a record of the range is in parts or too long.

    A group is the ranges of a file, one small row for each."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        names, inside, base = header_names(rows[0]["header"] or []), False, 0
        out = []
        for r in rows:
            end = r["end1"] if inside else r["end0"]
            out.append({"path": r["path"], "start": r["start"], "stop": r["stop"], "inside": inside, "base": base, "names": names,
                        "split": inside or end or r["over"]})
            base += r["n1"] if inside else r["n0"]
            inside = end
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("inside", pa.bool_()), ("base", pa.int64()), ("names", pa.list_(pa.string())), ("split", pa.bool_())]))

    return facts.groupBy("path").applyInArrow(run, PLACES)


def _as_maps(names: list[str], rows: list[list[str | None]]) -> pa.Array:
    """Records as maps from column names; every row has all columns of the header."""
    widest = max([len(names), *map(len, rows)])
    wide = names if widest == len(names) else header_names([*names, *[""] * (widest - len(names))])
    keys, items, ends = [], [], [0]
    for cells in rows:
        n = max(len(names), len(cells))
        keys += wide[:n]
        items += cells + [None] * (n - len(cells))
        ends.append(ends[-1] + n)
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()))


PARSED = "path string, row bigint, start bigint, record map<string,string>, fragment string, over boolean"
_KINDS = pa.schema([("path", pa.string()), ("row", pa.int64()), ("start", pa.int64()), ("record", pa.map_(pa.string(), pa.string())),
                    ("fragment", pa.string()), ("over", pa.bool_())])


def _batch(path: str, start: int, rows: np.ndarray, records: pa.Array, fragments: list, over: list) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([
        pa.array([path] * n, pa.string()), pa.array(rows, pa.int64()), pa.array([start] * n, pa.int64()), records.cast(_KINDS.field("record").type),
        pa.array(fragments, pa.string()), pa.array(over, pa.bool_())], schema=_KINDS)


def _parse(places: DataFrame, sep: str) -> DataFrame:
    """Records that lie within a range as maps, parts of others as fragments."""
    none = pa.nulls(1, pa.map_(pa.string(), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.to_pylist():
                path, start, base, names = at["path"], at["start"], at["base"], at["names"]
                lines_in = Records(sep, at["inside"])

                def other(done):
                    nth, text, _ = done
                    return _batch(path, start, np.array([base + nth]), none, [text], [text is None])  # noqa: B023

                for lines in G.lines_of(path, start, at["stop"]):
                    whole, where, odd = [], [], []
                    if lines_in.parts is None and not any(x is None or '"' in x or "\r" in x for x in lines):
                        whole = [[c or None for c in x.split(sep)] for x in lines if x]
                        where = np.arange(lines_in.nth + 1, lines_in.nth + 1 + len(whole))
                        lines_in.nth += len(whole)
                    else:
                        for piece, ending in _pieces(lines):
                            done = lines_in.feed(piece, ending)
                            if done is not None and done[2] and done[1] is not None:
                                where.append(done[0])
                                whole.append(cells_of(done[1], sep))
                            elif done is not None:
                                odd.append(done)
                    if whole:
                        n = len(whole)
                        yield _batch(path, start, base + np.asarray(where), _as_maps(names, whole), [None] * n, [False] * n)
                    for done in odd:
                        yield other(done)
                if (done := lines_in.rest()) is not None:
                    yield other(done)

    return G.spread_ranges(places).mapInArrow(run, PARSED)


def _mend(parsed: DataFrame, names: DataFrame, sep: str) -> DataFrame:
    """Records put together from their fragments: (path, row, record, over)."""
    parts = parsed.where("record IS NULL").groupBy("path", "row").agg(
        F.sum(F.length("fragment")).alias("size"), F.max("over").alias("over"),
        F.array_sort(F.collect_list(F.struct("start", "fragment"))).alias("parts"))
    parts = parts.select("path", "row", (F.col("over") | (F.col("size") > G.MAX_RECORD)).alias("over"),
                         F.concat_ws("", F.transform("parts", lambda p: p["fragment"])).alias("text")).join(names, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                record = None if r["over"] else _as_maps(r["names"], [cells_of(r["text"], sep)])[0].as_py()
                yield pa.record_batch({
                    "path": pa.array([r["path"]]), "row": pa.array([r["row"]], pa.int64()),
                    "record": pa.array([record], pa.map_(pa.string(), pa.string())), "over": pa.array([bool(r["over"])])})

    return parts.mapInArrow(run, "path string, row bigint, record map<string,string>, over boolean")


def delimited_records(files: DataFrame, sep: str = ",", range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, position, record), (path, message)) of files with headers of their own; ``files`` is (path, length).

    ``position`` is the record's index in its file, however the file is cut."""
    facts = write_scratch(_facts(files.select("path", "length"), sep, range_bytes), "ranges")
    unread = facts.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("message"))
    heads = facts.where("start = 0 AND over AND header IS NULL AND error IS NULL")
    errors = unread.unionByName(heads.select("path", F.lit(TOO_LONG.format(G.MAX_RECORD)).alias("message")))
    places = write_scratch(_chain(facts.join(unread.select("path"), "path", "left_anti")), "places")
    parsed = _parse(places, sep)
    if places.where("split").limit(1).count():
        parsed = write_scratch(parsed, "parsed")          # read for its records and for its fragments
        mended = write_scratch(_mend(parsed, places.where("start = 0").select("path", "names"), sep), "mended")
        long = mended.where("over").select("path", F.lit(TOO_LONG.format(G.MAX_RECORD)).alias("message"))
        errors = errors.unionByName(long).distinct()
        rows = parsed.where("record IS NOT NULL").select("path", "row", "record").unionByName(
            mended.where("NOT over").select("path", "row", "record"))
    else:
        rows = parsed.select("path", "row", "record")
    return rows.where("row > 0").select("path", (F.col("row") - 1).alias("position"), "record"), errors
