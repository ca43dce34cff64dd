"""Files opened inside tasks: folders listed level by level, whole contents, and lines by byte ranges.

No list of files ever reaches the driver: every function takes and gives frames of (path, length), and work is
dealt out by the number of folders, files or bytes. Paths are local ones or URIs of a store that pyarrow knows
(HDFS, S3, GCS, ...).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.session import write_scratch

RANGE_BYTES = 64 << 20          # of a file that one task reads at a time
BLOCK_BYTES = 4 << 20           # read from a store at once
BATCH_BYTES = 32 << 20          # sent on at once
FOLDERS_EACH, FILES_EACH = 64, 256      # per task
MAX_TASKS = 20_000
MAX_CONTENT = 1 << 30           # of one row
# a line, or a record of many lines, longer than this is an error of its file
MAX_RECORD = 64 << 20


def open_store(path: str) -> tuple[pa_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa_fs.FileSystem.from_uri(path)
    return pa_fs.LocalFileSystem(), path


def skipped(name: str) -> bool:
    """Names that Spark's own listing leaves out as well: what writers leave beside their data."""
    return name.startswith(("_", ".")) and "=" not in name


def children(folder: str) -> list[tuple[str, bool, int, int]]:
    """(path, is a folder, length, mtime in microseconds) of what lies directly in a folder, or of a file itself."""
    store, name = open_store(folder)
    info = store.get_file_info(name)
    if info.type == pa_fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.is_file else store.get_file_info(pa_fs.FileSelector(name))
    prefix = folder[: len(folder) - len(name)] if folder.endswith(name) and "://" in folder else ""
    out = []
    for x in found:
        if info.is_file or not skipped(x.base_name):
            out.append((prefix + x.path, not x.is_file, int(x.size or 0), (x.mtime_ns or 0) // 1_000_000 * 1000))
    return out


def list_tree(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """(path, length, mtime) of every file below the roots.

    One job lists all folders of a level; its folders are the next level, so a wide tree is listed by many tasks
    and the number of jobs is the depth of the tree.
    """
    roots = [roots] if isinstance(roots, str) else roots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = children(folder)
                for at in range(0, len(rows), 10_000):
                    path, inner, length, mtime = zip(*rows[at:at + 10_000])
                    yield pa.record_batch({
                        "path": pa.array(path, pa.string()), "folder": pa.array(inner, pa.bool_()),
                        "length": pa.array(length, pa.int64()), "mtime": pa.array(mtime, pa.int64())})

    level = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string").coalesce(1)
    out = None
    while True:
        found = write_scratch(
            level.mapInArrow(run, "path string, folder boolean, length bigint, mtime bigint"), "listing")
        files = found.where("NOT folder").select("path", "length", "mtime")
        out = files if out is None else out.unionByName(files)
        n = found.where("folder").count()
        if not n:
            return out
        level = found.where("folder").select("path").repartition(min(MAX_TASKS, -(-n // FOLDERS_EACH)))


def dealt(files: DataFrame, bytes_each: int = RANGE_BYTES) -> DataFrame:
    """Files dealt to as many tasks as their bytes and number ask for."""
    n, size = files.agg(F.count("*"), F.sum("length")).first()
    return files.repartition(max(1, min(MAX_TASKS, max(-(-n // FILES_EACH), -(-(size or 0) // bytes_each)))))


def contents(files: DataFrame) -> DataFrame:
    """(path, content, error) of files; one that cannot be read, or is too long for a row, has its error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                data = error = None
                try:
                    if length > MAX_CONTENT:
                        raise ValueError(f"longer than {MAX_CONTENT} bytes")
                    store, name = open_store(path)
                    with store.open_input_stream(name) as f:
                        data = f.read()
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, data, error))
                held += len(data or b"")
                if held > BATCH_BYTES:
                    yield _content_batch(rows)
                    rows, held = [], 0
            yield _content_batch(rows)

    return dealt(files.select("path", "length")).mapInArrow(run, "path string, content binary, error string")


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    path, data, error = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({"path": pa.array(path, pa.string()), "content": pa.array(data, pa.binary()),
                            "error": pa.array(error, pa.string())})


def file_ranges(files: DataFrame, size: int | None = None) -> DataFrame:
    """(path, start, stop): every file cut into byte ranges."""
    size = RANGE_BYTES if size is None else size
    cut = files.where("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start"))
    return cut.select("path", "start", F.least(F.col("start") + size, "length").alias("stop"))


def spread_ranges(ranges: DataFrame) -> DataFrame:
    """A task for each range, up to ``MAX_TASKS``."""
    return ranges.repartition(max(1, min(MAX_TASKS, ranges.count())))


def lines_of(path: str, start: int, stop: int) -> Iterator[list[str | None]]:
    """The lines that begin in a byte range, without their line feeds; None for one that is too long.

    A line may end beyond the range; what is left of one that begins before it belongs to the range before.
    """
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        at = max(0, start - 1)
        f.seek(at)
        skipping, held, size, over = start > 0, [], 0, False
        # ``at`` is the place of the next byte to read, ``begin`` of the first byte of the line in work
        begin = at
        while True:
            block = f.read(BLOCK_BYTES)
            if not block:
                break
            if at == 0 and block.startswith(b"\xef\xbb\xbf"):
                block, at, begin = block[3:], 3, 3 if not skipping else begin
            out, ended = [], False
            parts = block.split(b"\n")
            for part in parts[:-1]:
                at += len(part) + 1
                if skipping:
                    skipping = False
                else:
                    if not over:
                        held.append(part)
                    out.append(None if over or size + len(part) > MAX_RECORD else b"".join(held).decode("utf-8", "replace"))
                held, size, over, begin = [], 0, False, at
                if begin >= stop:
                    ended = True
                    break
            if out:
                yield out
            if ended:
                return
            at += len(parts[-1])
            if parts[-1] and not skipping:
                size += len(parts[-1])
                over |= size > MAX_RECORD
                held = [] if over else [*held, parts[-1]]
            if at >= stop and (skipping or over):      # no other line begins in the range
                if over:
                    yield [None]
                return
        if not skipping and (held or over) and begin < stop:
            yield [None if over else b"".join(held).decode("utf-8", "replace")]


def text_lines_of(files: DataFrame) -> DataFrame:
    """(path, pos, line) of text files of any size; ``pos`` sorts a file's lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                nth = 0
                for lines in lines_of(path, start, stop):
                    whole = [x.removesuffix("\r") for x in lines if x is not None]
                    yield pa.record_batch({
                        "path": pa.array([path] * len(whole), pa.string()), "start": pa.array([start] * len(whole), pa.int64()),
                        "nth": pa.array(range(nth, nth + len(whole)), pa.int64()), "line": pa.array(whole, pa.string())})
                    nth += len(whole)

    ranges = spread_ranges(file_ranges(files))
    return ranges.mapInArrow(run, "path string, start bigint, nth bigint, line string").select(
        "path", F.struct("start", "nth").alias("pos"), "line")
