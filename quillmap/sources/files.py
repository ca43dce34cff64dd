"""File sources: scanning, routing, and the readers that turn one file into many documents.

Every reader returns (path, position, type, content, record, suggested_label); ``record`` is a
string map for structured rows and NULL otherwise. The row logic is kept apart from the reading so
that it runs on tables as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap import constants as K
from quillmap.functions.text import clean_text, is_hidden, one_json_value, route
from quillmap.session import write_scratch
from quillmap.sources import ranges as G
from quillmap.sources.delimited import delimited_records
from quillmap.sources.json_ranges import INVALID, array_elements

# a parsed JSON value holds 16 MB; larger files are cut into their elements
JSON_WHOLE = 8 << 20
DOCUMENT_COLUMNS = ["path", "position", "type", "content", "record", "suggested_label"]


def plain_path(path: Column) -> Column:
    """Local paths without their scheme, so that every source spells them alike."""
    return F.regexp_replace(path, "^file:/+", "/")


def source_path() -> Column:
    """Path of the file a row was read from; the metadata column spells it as a URI."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return plain_path(F.url_decode(encoded))


def list_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, length, mtime) of every file below ``root``; listed by the executors, no byte is read."""
    return G.list_tree(spark, root).withColumn("path", plain_path(F.col("path")))


def scan_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """``list_files`` of the supported, visible files, with their type."""
    return supported_files(list_files(spark, root))


def files_of(spark: SparkSession, source: str | list[str] | DataFrame, ext: str | None = None) -> DataFrame:
    """(path, length) of a frame of files, or of the files below folders; of one extension if given."""
    files = source if isinstance(source, DataFrame) else list_files(spark, source)
    if ext is not None:
        files = files.where(F.lower("path").endswith(ext.lower()))
    return files.select("path", "length")


def read_ranges(files: DataFrame, slice_bytes: int) -> DataFrame:
    """(path, length, mtime, slices): first, middle and last bytes of files of any size."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                store, name = G.open_store(path)
                with store.open_input_file(name) as f:
                    out.append(b"".join(
                        f.read_at(min(slice_bytes, length - at), at)
                        for at in (0, length // 2, max(0, length - slice_bytes))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "slices"])

    slim = files.select("path", "length", "mtime")
    slim = slim.repartition(max(1, min(G.MAX_TASKS, -(-slim.count() // G.FILES_EACH))))
    return slim.mapInArrow(read, T.StructType([*slim.schema, T.StructField("slices", T.BinaryType())]))


def supported_files(files: DataFrame) -> DataFrame:
    """Add the loader type; drop hidden files and extensions nothing reads."""
    path = F.col("path")
    return files.withColumn("type", route(path)).where(F.col("type").isNotNull() & ~is_hidden(path))


def unsupported_files(files: DataFrame) -> DataFrame:
    """The quarantine side of the routing: path and the reason."""
    path = F.col("path")
    return files.where(route(path).isNull() & ~is_hidden(path)).select(
        "path", F.lit("no reader for this extension").alias("error"))


# --- delimited text ---------------------------------------------------------

def as_document(record: Column, kind: str) -> list[Column]:
    return [
        F.lit(kind).alias("type"), F.to_json(record).alias("content"), record.alias("record"),
        F.lit(None).cast("string").alias("suggested_label"),
    ]


def read_delimited(spark: SparkSession, paths, kind: str = "csv", multi_line: bool = False
                   ) -> DataFrame:
    """Files that share one header: Spark's CSV reader, header names stripped."""
    df = (
        spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        .option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
        .csv(paths)
    )
    named = [(c.strip(), F.col(f"`{c}`")) for c in df.columns]
    record = F.create_map(*[x for n, c in named for x in (F.lit(n), c.cast("string"))])
    return df.select(
        source_path().alias("path"),
        F.monotonically_increasing_id().alias("position"), *as_document(record, kind))


def separator(kind: str) -> str:
    return "\t" if kind == "tsv" else ","


def delimited_documents(files: DataFrame, kind: str = "csv", range_bytes: int | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """(documents, (path, message)) of files with headers of their own; ``position`` is the record's index in
    its file."""
    rows, errors = delimited_records(files, separator(kind), range_bytes)
    return rows.select("path", "position", *as_document(F.col("record"), kind)), errors


def read_mixed_delimited(spark: SparkSession, source, kind: str = "csv", ext: str | None = None) -> DataFrame:
    """``delimited_documents`` of a frame of files, or of the files below folders."""
    return delimited_documents(files_of(spark, source, ext), kind)[0]


# --- JSON -------------------------------------------------------------------

def json_documents(texts: DataFrame) -> DataFrame:
    """One document per object of an array, one for a top-level object, none for broken JSON."""
    whole = texts.select("path", F.try_parse_json(one_json_value(F.col("text"))).alias("v"))
    items = F.expr("CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' "
                   "THEN CAST(v AS ARRAY<VARIANT>) ELSE array(v) END")
    return _json_objects(whole.where("v IS NOT NULL").select(
        "path", F.posexplode(items).alias("position", "item")))


def _json_objects(items: DataFrame) -> DataFrame:
    body = items.where(F.schema_of_variant("item").startswith("OBJECT")).select(
        "path", F.col("position").cast("bigint").alias("position"), F.to_json("item").alias("content"))
    return body.select(
        "path", "position", F.lit("json").alias("type"), "content",
        F.from_json("content", "map<string,string>").alias("record"),
        F.lit(None).cast("string").alias("suggested_label"))


def json_files(files: DataFrame, whole_bytes: int = JSON_WHOLE, range_bytes: int | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """(documents, (path, message)) of JSON files of any size.

    Files that a parsed value can hold are read whole. Larger ones must be arrays; their elements are cut out of
    byte ranges and parsed one by one, and an element that is not valid makes the file an error, as it does in a small one.
    """
    small, large = files.where(F.col("length") <= whole_bytes), files.where(F.col("length") > whole_bytes)
    texts, unread = whole_texts(small)
    broken = texts.where(F.try_parse_json(one_json_value(F.col("text"))).isNull()).select(
        "path", F.lit(INVALID).alias("message"))
    docs, errors = json_documents(texts), unread.unionByName(broken)
    if not large.limit(1).count():
        return docs, errors
    parts, no_array = array_elements(large, range_bytes)
    items = parts.select("path", "position", F.try_parse_json(one_json_value(F.col("text"))).alias("item"))
    items = write_scratch(items.select("path", "position", "item"), "items")
    bad = items.where("item IS NULL").select("path", F.lit(INVALID).alias("message")).distinct()
    found = _json_objects(items.where("item IS NOT NULL").join(bad.select("path"), "path", "left_anti"))
    return docs.unionByName(found), errors.unionByName(no_array).unionByName(bad)


def whole_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, text), (path, message)) of text files."""
    rows = G.contents(files)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.where("error IS NULL").select("path", text.alias("text")), rows.where("error IS NOT NULL").select(
        "path", F.col("error").alias("message"))


def read_whole_texts(spark: SparkSession, source, ext: str | None = None) -> DataFrame:
    return whole_texts(files_of(spark, source, ext))[0]


def read_json(spark: SparkSession, source, ext: str | None = None) -> DataFrame:
    return json_files(files_of(spark, source, ext))[0]


# --- plain text -------------------------------------------------------------

def text_lines(text: Column) -> Column:
    """Lines of a text: any line break counts, a final one adds no line."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    return F.split(F.regexp_replace(unified, r"\n\z", ""), "\n")


def is_list_text(lines: Column) -> Column:
    """More than two lines and few words per line over the first lines."""
    sample = F.slice(lines, 1, K.LIST_SAMPLE_LINES)
    words = F.aggregate(
        sample, F.lit(0), lambda n, line: n + F.regexp_count(line, F.lit(r"\S+")))
    return (F.size(lines) > K.LIST_MIN_LINES) & (
        words / F.size(sample) < K.LIST_MAX_MEAN_WORDS)


def txt_documents(texts: DataFrame) -> DataFrame:
    """List files give one document per line with content, prose files one document."""
    split = texts.select("path", "text", text_lines(F.col("text")).alias("lines")).withColumn(
        "is_list", is_list_text(F.col("lines")))
    # one explode for both kinds: prose is a list of one
    parts = split.select(
        "path", "is_list",
        F.posexplode(F.when(F.col("is_list"), F.col("lines")).otherwise(F.array("text"))
                     ).alias("position", "part"))
    cleaned = parts.select("path", "is_list", F.col("position").cast("bigint").alias("position"),
                           clean_text(F.col("part")).alias("content"))
    return cleaned.where(
        ~F.col("is_list") | (F.length("content") > K.LIST_MIN_LINE_CHARS)
    ).select(
        "path", "position", F.lit("txt").alias("type"), "content",
        F.lit(None).cast("map<string,string>").alias("record"),
        F.when(F.col("is_list"), F.col("content")).alias("suggested_label"))


def read_txt(spark: SparkSession, source, ext: str | None = None) -> DataFrame:
    return txt_documents(read_whole_texts(spark, source, ext))
