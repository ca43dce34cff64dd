"""WARC archives: written as monolithic gzip streams, normalised to one gzip member a record, with a sidecar offset index.

1. ``write_archives`` makes a record of each page and lets Spark's text writer compress whole files: each file is one gzip stream
   of many records, as crawlers without record compression leave them. Of pages with equal payloads one is a response, the
   others are revisits that name it.
2. ``normalise`` inflates each such stream once, in Spark's reader, whatever its size: the stream arrives in pieces between
   blank lines and is put together to records by their Content-Length. Every record is compressed as a member of its
   own. An empty member with a comment stands after each (20 bytes and the comment), which any gzip reader skips and at which
   Spark can cut a file into splits.
3. ``index_archives`` reads the members in parallel, checks their checksums and payload digests, and writes the sidecar: file, offset
   and length of each record's member beside what its header says. Offsets are counted within each split and moved by what
   the splits before it hold. ``read_members`` fetches single records by it.

All files are written and committed by Spark's writers, so a lost executor leaves no half a file.

Defined results: a null payload counts as an empty one; a null url leaves its header out; line ends and other control characters
in a url are percent-encoded. Payloads of fewer bytes than ``least`` are always responses. Rows without an id revisit
others and are named by none, unless no row of their payload has an id: then all of them are responses. All rows that share the
largest id and the payload are responses. Repeated rows are records of their own, with the same record id. Other columns are
not read. An empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.llm.common import string_column, write_scratch
from quillmap.session import collect_bounded

BLANK = "\r\n\r\n"
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member with a comment; stands behind every record's member.
SEPARATOR = b"\x1f\x8b\x08\x10\0\0\0\0\0\xffend of record\0\x03\0\0\0\0\0\0\0\0\0"
LEVEL = 3
#: Pieces that the copies of one payload are dealt to where there are too many payloads to ship.
SALTS = 16
INDEX = "file string, offset bigint, length bigint, record_id string, page string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string"


def _uuid(page: Column, url: Column, digest: Column) -> Column:
    whole = F.md5(F.concat_ws("|", F.coalesce(page, F.lit("-")), F.coalesce(url, F.lit("-")), digest))
    return F.regexp_replace(whole, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _header(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _safe_url(url: Column) -> Column:
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _originals(base: DataFrame, least: int) -> DataFrame:
    """(digest, n, page, url) of the response of each payload that several rows have; reduced before it is dealt out."""
    named = F.max(F.when(F.col("id").isNotNull(), F.struct("id", F.coalesce("url", F.lit("")).alias("order"), "url")))
    groups = base.where(F.col("n") >= least).groupBy("digest", "n").agg(F.count("*").alias("c"), named.alias("r"))
    return groups.where("c > 1 AND r IS NOT NULL").select(
        F.col("digest").alias("d"), F.col("n").alias("m"), F.col("r.id").alias("first_id"), F.col("r.url").alias("first_url"))


def make_records(pages: DataFrame, least: int = 1000, date: str = "2000-01-01T00:00:00Z", key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """value: each page's record, without the blank lines that end it."""
    base = pages.select(F.col(f"`{key}`").alias("id"), string_column(url, "url"), F.coalesce(string_column(payload, "p"), F.lit("")).alias("payload"))
    base = base.select("id", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("bigint").alias("n"))
    first = _originals(base, least)
    same = (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m"))
    if collect_bounded(first) is not None:
        rows = base.join(F.broadcast(first), same, "left")
    else:
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = base.withColumn("mine", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(first, same & (F.col("mine") == F.col("salt")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    page, origin = F.col("id").cast("string"), F.col("first_id").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(BLANK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _uuid(page, F.col("url"), F.col("digest"))), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", _safe_url(F.col("url"))), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", _uuid(origin, F.col("first_url"), F.col("digest"))),
            _header("WARC-Refers-To-Target-URI", _safe_url(F.col("first_url"))), _header("Refers-To-Page-ID", origin))).otherwise(F.lit("")),
        _header("Page-ID", page), F.lit("Content-Type: application/http;msgtype=response\r\n"))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK))
    return rows.select(F.concat(head, length, block).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Archives below ``path``, each file one gzip stream."""
    records = make_records(pages, **options)
    records.write.option("lineSep", BLANK).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line under ''."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out = {"": first}
    for line in lines:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class RecordStream:
    """Puts the pieces between blank lines of one stream together to records."""

    def __init__(self, name: str):
        self.name, self.head, self.parts, self.held, self.wanted = name, None, [], 0, 0

    def feed(self, piece: bytes) -> bytes | None:
        """The record that ends with this piece, if one does."""
        if self.head is None:
            piece = piece.lstrip(b"\r\n")
            if not piece:
                return None
            fields = headers_of(piece)
            if not fields[""].startswith("WARC/") or not fields.get("content-length", "").isdigit():
                raise ValueError(f"no WARC record where one should begin in {self.name}")
            self.head, self.wanted, self.parts, self.held = piece, int(fields["content-length"]), [], 0
            return None
        self.held += len(piece) + (4 if self.parts else 0)
        self.parts.append(piece)
        if self.held < self.wanted:
            return None
        end = BLANK.encode()
        block = end.join(self.parts)
        # line ends that close a block run into the blank line after it, which is then found too early
        block, rest = block[:self.wanted], block[self.wanted:]
        if not (rest + end).startswith(end):
            raise ValueError(f"a record of {self.name} is longer than its Content-Length")
        record = self.head + end + block + end
        self.head = None
        if len(rest) > len(end):
            self.feed(rest[len(end):])
        return record

    def close(self) -> None:
        if self.head is not None:
            raise ValueError(f"{self.name} ends within a record")


def member(record: bytes, level: int = LEVEL) -> bytes:
    """The record as a gzip member without the separator's bytes in it."""
    for tried in (level, *range(1, 10)):
        packer = zlib.compressobj(tried, zlib.DEFLATED, 31)
        out = packer.compress(record) + packer.flush()
        if SEPARATOR not in out:
            return out
    raise ValueError("a record cannot be told from the separator")


def normalise(spark: SparkSession, source: str, path: str, level: int = LEVEL) -> None:
    """Files below ``path`` that hold each record of the gzip streams below ``source`` as a member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            out = []
            for name, piece in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
                if stream is None or stream.name != name:
                    if stream is not None:
                        stream.close()
                    stream = RecordStream(name)
                record = stream.feed(piece.as_py())
                if record is not None:
                    out.append(member(record, level))
            yield pa.record_batch({"value": pa.array(out, pa.binary())})
        if stream is not None:
            stream.close()

    pieces = spark.read.option("lineSep", BLANK).text(source).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    members = pieces.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).option("compression", "none").text(path)


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a whole record."""
    end = BLANK.encode()
    head, _, rest = record.partition(end)
    fields = headers_of(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(end)
    return fields, headers_of(http), payload


def inflate(data: bytes) -> bytes:
    """Of one member, whose checksum the library checks."""
    unpacker = zlib.decompressobj(31)
    out = unpacker.decompress(data)
    if not unpacker.eof or unpacker.unused_data:
        raise ValueError("a damaged member")
    return out


def facts(record: bytes) -> tuple:
    """(record id, page, url, type, payload digest, payload bytes, refers to); raises where payload and digest differ."""
    fields, http, payload = parse(record)
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if digest != said:
            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    else:
        digest, size = said, int(http["content-length"])
    return fields["warc-record-id"], fields.get("page-id"), fields.get("warc-target-uri"), kind, digest, size, fields.get("refers-to-page-id")


def _members(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1"))
    return reader.text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar rows of the normalised archives below ``path``, from one reading of them."""
    names = ["file", "block", "before", "length", "record_id", "page", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = None, 0
        for batch in batches:
            rows = []
            for data, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                data = data.as_py()
                if (file, block) != at:
                    at, before = (file, block), 0
                rows.append((file, block, before, len(data), *facts(inflate(data))))
                before += len(data) + len(SEPARATOR)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "file string, block bigint, before bigint, length bigint, record_id string, page string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string"
    rows = write_scratch(_members(spark, path).mapInArrow(run, schema), "members")
    held = rows.groupBy("file", "block").agg(F.sum(F.col("length") + len(SEPARATOR)).alias("held"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("file", "block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    placed = rows.join(starts, ["file", "block"])
    return placed.select("file", (F.col("start") + F.col("before")).alias("offset"), "length", *names[4:])


def read_members(index: DataFrame) -> DataFrame:
    """record_id, record (binary, whole) of the sidecar rows given: only their bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    store, name = pa_fs.FileSystem.from_uri(quote(file, safe=":/%+"))
                    opened = {file: store.open_input_file(name)}
                out.append(inflate(opened[file].read_at(length, offset)))
            yield pa.record_batch({"record_id": batch.column("record_id"), "record": pa.array(out, pa.binary())})

    return index.select("file", "offset", "length", "record_id").sortWithinPartitions("file", "offset").mapInArrow(run, "record_id string, record binary")


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", **options) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of every page, as its record under ``path`` says.

    ``path``/raw has the monolithic archives, ``path``/members the normalised ones and ``path``/index the sidecar."""
    spark = pages.sparkSession
    write_archives(pages, f"{path}/raw", key=key, **options)
    normalise(spark, f"{path}/raw", f"{path}/members")
    index_archives(spark, f"{path}/members").write.parquet(f"{path}/index")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    kind = pages.schema[key].dataType
    return index.select(F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
