"""Frames that Spark derives from the given tables: files, catalog, queries, records, references.

All of them read whole tables. Expressions over ids only spread names and shapes over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap import constants as K
from quillmap.functions.embedders import embed_text
from quillmap.functions.vectors import as_doubles, fuse
from quillmap.operators.catalog import folder_signatures
from quillmap.operators.search import prepare_queries
from quillmap.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# first column of each table that orders its rows
TABLE_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey, l_linenumber", "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
    "conversations": "conv_id, turn",
}
EPOCH = 1704067200


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The text table, for queries that compute on whole texts."""
    return spread(table(spark, sf, "documents"), "doc_id")


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def paths(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """One file path per part; ``wide`` spreads a small scan for costly follow-ups."""
    key = F.col("p_partkey")
    exts = F.array(*[F.lit(e) for e in
                     (".jpg", ".csv", ".PDF", ".bmp", ".JPEG", ".tar.gz", ".txt")])
    part = table(spark, sf, "part")
    return (spread(part, "p_partkey") if wide else part).select(
        key.alias("key"),
        F.concat(F.lit("raw/a"), (F.col("p_size") % 7).cast("string")).alias("archive"),
        F.concat(
            F.lit("raw/a"), (F.col("p_size") % 7).cast("string"), F.lit("/"),
            F.when(key % 3 == 0, "images").when(key % 3 == 1, F.lower("p_type")).otherwise("train"),
            F.lit("/"),
            F.when(key % 2 == 0, F.translate("p_name", " ", "_"))
            .otherwise(F.concat(F.lit("img"), key.cast("string"))),
            F.get(exts, (key % 7).cast("int")),
        ).alias("path"),
    )


def doc_files(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Documents, or the given ones, as text files in folders ``raw/<source>/<lang>``."""
    return (documents(spark, sf) if rows is None else rows).select(
        "doc_id", "text", "lang", "source",
        F.concat(F.lit("raw/"), "source", F.lit("/"), "lang").alias("archive"),
        F.concat(F.lit("raw/"), "source", F.lit("/"), "lang", F.lit("/doc_"),
                 F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.md5(F.col("text").cast("binary")).alias("file_hash"),
        ((F.lit(EPOCH) + F.col("doc_id")) * 1000000).alias("mtime"),
        "n_chars",
    )


def indexed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The state of an earlier run: the labelled documents are in the catalog."""
    known = table(spark, sf, "labels").select("doc_id")
    return doc_files(spark, sf).join(known, "doc_id", "left_semi").withColumnRenamed(
        "path", "source_path")


def indexed_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return indexed_files(spark, sf).select(
        "doc_id", "file_hash", F.col("source_path").alias("source"), "archive")


def old_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts written before the short documents arrived; folders without any are unchanged."""
    old = folder_signatures(doc_files(spark, sf).where("n_chars >= 200"))
    return old.select(
        F.col("archive").alias("folder_path"), "signature",
        F.when(F.col("archive").endswith("/fr"), "unknown")
        .otherwise(F.substring_index("archive", "/", -1)).alias("assigned_domain"),
        F.lit(0.9).cast("float").alias("confidence"), F.lit(0).alias("is_verified"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Searchable catalog: every document; those with an embedding row have an image vector."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), as_doubles(F.col("embedding")).alias("visual"),
        F.col("label").alias("_label"))
    docs = doc_files(spark, sf).join(vectors, "doc_id", "left")
    return docs.withColumn("_t", embed_text(F.col("text"))).select(
        "doc_id", F.col("file_hash").alias("doc_hash"), "file_hash",
        F.col("path").alias("source"), "archive", F.lit("txt").alias("type"),
        F.coalesce(F.concat(F.lit("d"), F.col("_label").cast("string")), F.lit("unknown")
                   ).alias("domain"),
        F.col("lang").alias("label"),
        F.substring("text", 1, 20000).alias("content"),
        F.substring("text", 1, 500).alias("snippet"),
        F.col("visual"), fuse(F.col("_t"), F.col("visual")).alias("vector"),
        F.to_json(F.struct("n_chars", "lang")).alias("extra"),
    )


def raw_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item twice: as an image with readable text, and as an image alone."""
    items = table(spark, sf, "benchmark").join(
        table(spark, sf, "embeddings"), F.col("item_id") == F.col("vec_id"), "left")
    langs = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "unknown")])
    return items.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("item_id") * 2 + F.col("variant")).alias("qid"),
        F.col("embedding").alias("image_vector"),
        F.when(F.col("variant") == 0, F.col("text")).otherwise("").alias("ocr_text"),
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("f_domain"),
        F.get(langs, F.col("label") % 5).alias("f_label"),
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_queries(
        raw_queries(spark, sf), F.col("image_vector"), F.col("ocr_text"),
        embed_text(F.col("ocr_text")), F.col("f_domain"), F.col("f_label"))


def label_words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of the benchmark texts that are long enough for a label."""
    from quillmap.functions.text import clean_text

    words = F.split(clean_text(F.col("text"), "a-z0-9"), " ")
    return table(spark, sf, "benchmark").select(F.explode(words).alias("label")).where(
        F.length("label") >= K.LABEL_MIN_LENGTH).distinct()


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a vector: its row of embeddings, or its embedded text where there is none.

    Texts are embedded as they are read, and only their beginnings, all that prompts hold, go through the join.
    """
    known = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), as_doubles(F.col("embedding")).alias("_v"))
    docs = doc_files(spark, sf).withColumn("_t", embed_text(F.col("text"))).withColumn(
        "text", F.substring("text", 1, K.DOMAIN_PROMPT_CHARS))
    return docs.join(known, "doc_id", "left").withColumn(
        "embedding", F.coalesce("_v", "_t")).drop("_v", "_t")


def assigned_query(spark: SparkSession, sf: str, key: Column) -> Column:
    """The query that the digest of an id picks; where item ids leave gaps there may be none of that number."""
    n = 2 * table(spark, sf, "benchmark").count()
    digest = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10)
    return digest.cast("bigint") % F.nullif(F.lit(n), F.lit(0))


def label_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"),
        F.col("embedding").alias("vector"))


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as rows of one file per brand, with a column that names an image file."""
    part = table(spark, sf, "part").join(
        paths(spark, sf).select(F.col("key").alias("p_partkey"), "path", "archive"), "p_partkey")
    return part.select(
        F.concat(F.lit("raw/"), F.translate("p_brand", "#", "_"), F.lit(".csv")).alias("file"),
        "archive", F.col("p_partkey").alias("row_no"),
        F.create_map(
            F.lit("p_brand"), F.col("p_brand"),
            F.lit("picture"), F.when(F.col("p_size") > 3,
                                     F.upper(F.substring_index("path", "/", -1))),
            F.lit("p_name"), F.col("p_name"),
            F.lit("p_type"), F.col("p_type"),
        ).alias("record"))


def named_records(spark: SparkSession, sf: str) -> DataFrame:
    """Part, customer and supplier rows as records in one folder per table."""
    def rows(name: str, key: str, cols: list[str]) -> DataFrame:
        pairs = [x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]
        return table(spark, sf, name).select(
            F.lit(f"raw/{name}").alias("folder"), F.col(key).alias("row_no"),
            F.create_map(*pairs).alias("record"))

    return (
        rows("part", "p_partkey", ["p_brand", "p_name", "p_type"])
        .unionByName(rows("customer", "c_custkey", ["c_mktsegment", "c_name"]))
        .unionByName(rows("supplier", "s_suppkey", ["s_nationkey", "s_name"]))
    )


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of every table, by key, as a record."""
    out = None
    for name in TABLES:
        keys = [k.strip() for k in TABLE_KEYS[name].split(",")]
        row = table(spark, sf, name).agg(
            F.min_by(F.struct("*"), F.struct(*keys)).alias("r")).select("r.*")
        cols = [f.name for f in row.schema.fields if "array" not in f.dataType.typeName()]
        pairs = [x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]
        one = row.select(F.lit(name).alias("file"), F.create_map(*pairs).alias("record"))
        out = one if out is None else out.unionByName(one)
    return out


def json_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as JSON files: mixed arrays, objects, broken text."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("path"),
        F.when(kind == "click", F.concat(F.lit("["), "props", F.lit(", 5, "), "props", F.lit("]")))
        .when(kind == "view", F.col("props"))
        .otherwise(F.concat(F.lit('{"k": '), "props")).alias("text"))


def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scan lines of one page per user; confidence is the value over the maximum."""
    events = table(spark, sf, "events")
    top = events.agg(F.max("value")).scalar()
    return events.select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"),
        F.col("event_type").alias("text"), (F.col("value") / top).alias("confidence"))


def blob_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as dataset entries: html is the value, attributes come from the url."""
    host = F.regexp_extract("url", r"^https?://([^/]*)", 1)
    lang = F.regexp_extract("url", r"^https?://[^/]*/([^/]*)/", 1)
    return table(spark, sf, "pages").select(
        F.lit("store.h5").alias("path"), F.col("page_id").cast("string").alias("name"),
        F.octet_length("html").cast("bigint").alias("nbytes"),
        F.concat(F.lit("("), F.length("html").cast("string"), F.lit(",)")).alias("shape"),
        F.lit("object").alias("dtype"), F.col("html").alias("value"),
        F.create_map(F.lit("label"), F.when(F.contains(F.col("url"), F.lit("?")), host).otherwise(""),
                     F.lit("class"), lang).alias("attrs"))
