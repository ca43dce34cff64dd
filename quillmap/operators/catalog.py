"""The catalog table and the folder contracts: rows, incremental skips, upserts, exploration."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap import constants as K
from quillmap.functions.text import dirname, snippet
from quillmap.functions.vectors import l2_normalize
from quillmap.operators.structure import upsert
from quillmap.session import small_batches, write_scratch

CATALOG_SCHEMA = T.StructType([
    T.StructField("doc_hash", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("archive", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("domain_score", T.FloatType()),
    T.StructField("content", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("visual", T.ArrayType(T.FloatType())),
    T.StructField("image_linked", T.StringType()),
    T.StructField("extra", T.StringType()),
    T.StructField("position", T.LongType()),
    T.StructField("batch", T.StringType()),
    T.StructField("domain", T.StringType()),
])
ROW_FIELDS = [f for f in CATALOG_SCHEMA.fields if f.name != "batch"]

CONTRACT_SCHEMA = T.StructType([
    T.StructField("folder_path", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("assigned_domain", T.StringType()),
    T.StructField("confidence", T.FloatType()),
    T.StructField("is_verified", T.IntegerType()),
])


# --- rows, sink, scan -------------------------------------------------------

def catalog_rows(docs: DataFrame, content_chars: int = K.CONTENT_CHARS,
                 snippet_chars: int = K.SNIPPET_CHARS) -> DataFrame:
    """Rows as stored: unit vector, defaults for missing texts, cut content, JSON extra."""
    def text(name: str, default: str = "") -> Column:
        if name not in docs.columns:
            return F.lit(default).alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit(default)).alias(name)

    picked = {
        "vector": l2_normalize(F.col("vector")).cast("array<float>"),
        "visual": F.col("visual").cast("array<float>"),
        "domain_score": F.round(F.coalesce(
            F.col("domain_score") if "domain_score" in docs.columns else F.lit(None).cast("double"),
            F.lit(0.0)), 4).cast("float"),
        "content": F.substring(F.coalesce("content", F.lit("")), 1, content_chars),
        "snippet": snippet(F.col("content"), snippet_chars),
        "position": (F.col("position") if "position" in docs.columns else F.lit(0)).cast("bigint"),
    }
    defaults = {"type": "unknown", "domain": "unknown", "label": "unknown", "extra": "{}"}
    return docs.select(*[
        picked[f.name].alias(f.name) if f.name in picked else text(f.name, defaults.get(f.name, ""))
        for f in ROW_FIELDS
    ])


def extra_json(**fields: Column) -> Column:
    """JSON text of the given fields; NULL fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def append_catalog(rows: DataFrame, path: str, batch: str) -> None:
    """Add one batch, laid out by domain below its own folder.

    Writing a batch again replaces it, so a retried run leaves no duplicates. The rebalance hint
    lets AQE split a domain that holds most rows over many files and merge the small ones.
    """
    with small_batches(rows.sparkSession):
        rows.hint("rebalance", "domain").write.mode("overwrite").partitionBy("domain").parquet(
            f"{path}/batch={batch}")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a new version beside a folder and switch to it when it is complete.

    A job that fails leaves the old version where it was.
    """
    jvm = spark.sparkContext._jvm
    mark = uuid.uuid4().hex
    live, new, old = (jvm.org.apache.hadoop.fs.Path(x)
                      for x in (path, f"{path}.new-{mark}", f"{path}.old-{mark}"))
    fs = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(f"{path}.new-{mark}")
        if fs.exists(live) and not fs.rename(live, old):
            raise OSError(f"{path} cannot be moved")
        if not fs.rename(new, live):
            fs.rename(old, live)
            raise OSError(f"{path} cannot be replaced")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)


def reset_catalog(rows: DataFrame, path: str, batch: str) -> None:
    """Start over: the table holds exactly ``rows`` afterwards."""
    labelled = rows.withColumn("batch", F.lit(batch)).hint("rebalance", "domain")
    with small_batches(rows.sparkSession):
        replace_folder(rows.sparkSession, path, lambda to: labelled.write.partitionBy(
            "batch", "domain").parquet(to))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog scan; an empty frame when nothing has been written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return spark.read.schema(CATALOG_SCHEMA).option("basePath", path).parquet(path)


def append_contracts(contracts: DataFrame, path: str, batch: str, version: int) -> None:
    """Add contract versions; the newest of a folder is the one that counts."""
    contracts.withColumn("version", F.lit(version).cast("bigint")).write.mode(
        "overwrite").parquet(f"{path}/batch={batch}")


def reset_contracts(contracts: DataFrame, path: str, batch: str) -> None:
    """Start over with these contracts alone."""
    rows = contracts.withColumns({"version": F.lit(0).cast("bigint"), "batch": F.lit(batch)})
    replace_folder(contracts.sparkSession, path, lambda to: rows.write.partitionBy(
        "batch").parquet(to))


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Current contract of every folder."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CONTRACT_SCHEMA)
    names = [f.name for f in CONTRACT_SCHEMA.fields]
    log = spark.read.schema(T.StructType(
        CONTRACT_SCHEMA.fields + [T.StructField("version", T.LongType())])).parquet(path)
    newest = log.groupBy("folder_path").agg(
        F.max_by(F.struct(*names), "version").alias("c"))
    return newest.select("c.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# --- incremental load -------------------------------------------------------

def folder_signatures(files: DataFrame, depth: str = "all") -> DataFrame:
    """(archive, signature): md5 of folder, newest modification and number of files.

    ``files`` has archive, mtime (integer) and, for ``depth='direct'``, path.
    """
    if depth == "direct":
        files = files.where(dirname(F.col("path")) == F.col("archive"))
    return files.groupBy("archive").agg(
        F.max("mtime").alias("_m"), F.count("*").alias("_n")
    ).select("archive", F.md5(F.concat_ws(
        "_", "archive", F.col("_m").cast("string"), F.col("_n").cast("string")
    ).cast("binary")).alias("signature"))


def changed_archives(signatures: DataFrame, contracts: DataFrame) -> DataFrame:
    """Archives whose signature no contract knows."""
    known = contracts.select(F.col("folder_path").alias("archive"), "signature")
    return signatures.join(known, ["archive", "signature"], "left_anti")


def skip_unchanged(files: DataFrame, contracts: DataFrame, depth: str = "all") -> DataFrame:
    changed = changed_archives(folder_signatures(files, depth), contracts)
    return files.join(changed.select("archive"), "archive", "left_semi")


def indexed_hashes(catalog: DataFrame) -> DataFrame:
    return catalog.select("file_hash").where("file_hash IS NOT NULL").distinct()


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files with a hash that the catalog does not hold; the hash column alone is scanned."""
    return files.where("file_hash IS NOT NULL").join(
        catalog.select("file_hash"), "file_hash", "left_anti")


def file_status(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add status: exists (same hash and path), moved (same hash elsewhere) or new.

    The catalog side is distinct on both joins, so copies cannot multiply rows.
    """
    seen = catalog.select("file_hash", F.col("source").alias("path"), F.lit(True).alias("_same")
                          ).distinct()
    hashes = catalog.select("file_hash", F.lit(True).alias("_known")).distinct()
    joined = files.join(seen, ["file_hash", "path"], "left").join(hashes, "file_hash", "left")
    return joined.withColumn(
        "status", F.when(F.col("_same"), "exists").when(F.col("_known"), "moved").otherwise("new")
    ).drop("_same", "_known")


def apply_moves(catalog: DataFrame, moves: DataFrame) -> DataFrame:
    """Catalog with new sources; ``moves`` is (file_hash, new_source), the greatest path wins."""
    latest = moves.groupBy("file_hash").agg(F.max("new_source").alias("new_source"))
    return catalog.join(latest, "file_hash", "left").withColumn(
        "source", F.coalesce("new_source", "source")).drop("new_source")


def moved_sources(moved: DataFrame, catalog: DataFrame, present: DataFrame) -> DataFrame:
    """(file_hash, source, new_source): files found elsewhere whose old path is no longer ``present``.

    A file that still lies at its old path has been copied, not moved."""
    gone = catalog.select("file_hash", "source").distinct().join(
        present.select(F.col("path").alias("source")), "source", "left_anti")
    latest = moved.groupBy("file_hash").agg(F.max("path").alias("new_source"))
    return gone.join(latest, "file_hash")


def store_moves(spark: SparkSession, path: str, moves: DataFrame) -> None:
    """Write the new sources into the catalog; only partitions that hold a moved file are rewritten."""
    catalog = read_catalog(spark, path)
    touched = write_scratch(catalog.join(moves, ["file_hash", "source"], "left_semi").select(
        "batch", "domain").distinct(), "touched")
    if not touched.limit(1).count():
        return
    rows = catalog.join(touched, ["batch", "domain"], "left_semi")
    new = moves.select("file_hash", "source", "new_source").distinct()
    rows = rows.join(new, ["file_hash", "source"], "left").withColumn(
        "source", F.coalesce("new_source", "source")).select(*catalog.columns)
    rows = write_scratch(rows, "moved")               # the partitions cannot be read and replaced at once
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "batch", "domain").parquet(path)


def upsert_contracts(contracts: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(contracts, updates, "folder_path")


def lookup_contracts(docs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Documents with their folder's contract, one join for the whole batch."""
    return docs.join(contracts.withColumnRenamed("folder_path", "archive"), "archive", "left")


def ingest_counters(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


# --- exploration ------------------------------------------------------------

def preview(catalog: DataFrame, where: str | None = None, limit: int = K.PREVIEW_ROWS,
            order_by: str = "source") -> DataFrame:
    """Rows that meet a SQL predicate, without the vectors."""
    picked = catalog if not where else catalog.where(F.expr(where))
    shown = [c for c in picked.columns if c not in ("vector", "visual")]
    return picked.select(*shown).orderBy(order_by).limit(limit)


def catalog_metrics(catalog: DataFrame, contracts: DataFrame) -> DataFrame:
    """(metric, value): number of vectors and of folder contracts."""
    return catalog.agg(F.count("*").alias("value")).select(
        F.lit("total_vectors").alias("metric"), "value"
    ).unionAll(contracts.agg(F.count("*").alias("value")).select(
        F.lit("folder_contracts").alias("metric"), "value"))
