"""Continuous ingestion, de-duplication by hash, and debouncing of file events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from quillmap import constants as K
from quillmap.functions.hashing import fingerprint
from quillmap.operators.catalog import append_catalog, new_files, path_exists, read_catalog
from quillmap.plans import ingest as P
from quillmap.session import small_batches, write_scratch
from quillmap.sources.files import supported_files


def watch_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Stream of supported, visible files below ``root`` with their fingerprints."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(root).withColumn("mtime", F.unix_micros("modificationTime"))
    return supported_files(files).withColumn(
        "file_hash", fingerprint(F.col("content"), F.col("length"), F.col("mtime")))


def hash_store(path: str) -> str:
    return f"{path}.hashes"


def _prefix(hash_col: str) -> Column:
    return F.substring(F.md5(F.col(hash_col).cast("binary")), 1, K.HASH_PREFIX)


def keep_hashes(rows: DataFrame, path: str, batch: str, hash_col: str = "file_hash") -> None:
    """Store the hashes of a batch by prefix; a batch that is written again replaces itself."""
    hashes = rows.select(hash_col, _prefix(hash_col).alias("prefix")).where(F.col(hash_col).isNotNull())
    hashes.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(
        f"{hash_store(path)}/batch={batch}")


def known_hashes(fresh: DataFrame, path: str, batch: str, hash_col: str = "file_hash") -> DataFrame:
    """Hashes of other batches, of the prefixes that occur in ``fresh`` only."""
    spark = fresh.sparkSession
    wanted = [r[0] for r in fresh.select(_prefix(hash_col)).distinct().collect() if r[0] is not None]  # 16^n at most
    store = spark.read.schema(f"`{hash_col}` string, batch string, prefix string").option(
        "basePath", hash_store(path)).parquet(hash_store(path))
    return store.where((F.col("batch") != batch) & F.col("prefix").isin(wanted)).select(hash_col)


def append_new(stream: DataFrame, path: str, checkpoint: str,
               transform: Callable[[DataFrame], DataFrame] | None = None,
               hash_col: str = "file_hash") -> StreamingQuery:
    """Append every row whose hash the table at ``path`` does not hold, each hash once.

    A batch is written below its own ``batch=`` folder in overwrite mode: a batch that is replayed
    after a failure replaces what its first try left behind, and does not see it as known. The hashes are also
    kept beside the table, by their digest's first characters; a batch reads only those it holds itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = write_scratch(batch.dropDuplicates([hash_col]), "batch")
        if path_exists(spark, path) and not path_exists(spark, hash_store(path)):
            rows = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != batch_id)
            keep_hashes(rows, path, "earlier", hash_col)      # a table from before there was a store
        if path_exists(spark, hash_store(path)):
            known = known_hashes(fresh, path, str(batch_id), hash_col)
            fresh = write_scratch(fresh.join(known, hash_col, "left_anti"), "fresh")
        out = fresh if transform is None else transform(fresh)
        with small_batches(spark):
            out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        keep_hashes(fresh, path, str(batch_id), hash_col)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_new(files: DataFrame, catalog_path: str, checkpoint: str,
               rows_of: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Catalog rows of every file whose hash the catalog does not hold, through ``rows_of``.

    Hashes are compared by file before anything is loaded, so all records of a new file arrive.
    ``rows_of`` loads and classifies a micro-batch; a batch that is replayed replaces its first try.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        known = read_catalog(batch.sparkSession, catalog_path).where(F.col("batch") != str(batch_id))
        fresh = write_scratch(new_files(batch, known), "new-files")
        append_catalog(rows_of(fresh), catalog_path, str(batch_id))

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def watch_folder(
    spark: SparkSession, root: str, catalog_path: str, contracts_path: str, checkpoint: str,
    settings: P.IngestSettings = P.IngestSettings(), max_files: int | None = None,
) -> StreamingQuery:
    """Files that arrive below ``root`` trigger an ingest of the folders they changed: the loaders, catalog rows and folder
    contracts of a batch run.

    The first run builds the store, later ones complete it. Catalog and contracts are written under the name of the
    micro-batch, so one that is replayed replaces in both what its first try left.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = supported_files(reader.load(root).select("path"))     # contents are read by the loaders alone

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            P.ingest(batch.sparkSession, root, catalog_path, contracts_path,
                     ingest_mode(batch.sparkSession, catalog_path), settings, batch=f"stream-{batch_id}")

    return (
        files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drop_repeats(stream: DataFrame, hash_col: str, ts_col: str, within: str) -> DataFrame:
    """First row of each hash within a watermark; state is dropped once it has passed."""
    return stream.withWatermark(ts_col, within).dropDuplicatesWithinWatermark([hash_col])


# --- debounce ---------------------------------------------------------------

def debounce_sessions(events: DataFrame, key: str, ts: str,
                      gap_seconds: int = K.DEBOUNCE_SECONDS) -> DataFrame:
    """(key, start_us, end_us, n) of runs of events with no silence longer than the gap.

    Two events in one slot of the gap's width always belong together, so events are first reduced
    to one row per (key, slot) on the map side. A key that holds most events then sorts no more rows
    than there are slots in its time span.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = events.select(key, at.alias("_t")).groupBy(
        key, F.expr(f"_t div {gap}").alias("_slot")
    ).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_slot")
    silent = F.col("_a") - F.lag("_b").over(w) > gap
    runs = slots.withColumn("_new", F.when(silent, 1).otherwise(0)).withColumn(
        "_run", F.sum("_new").over(w))
    return runs.groupBy(key, "_run").agg(
        F.min("_a").alias("start_us"), F.max("_b").alias("end_us"), F.sum("_n").alias("n")
    ).drop("_run")


def debounce_stream(events: DataFrame, key: str, ts: str,
                    gap_seconds: int = K.DEBOUNCE_SECONDS, late: str = "1 minute") -> DataFrame:
    """The same runs on a stream: a session window, emitted once the watermark has passed it."""
    span: Column = F.session_window(ts, f"{gap_seconds} seconds")
    return events.withWatermark(ts, late).groupBy(key, span.alias("w")).agg(
        F.min(F.unix_micros(ts)).alias("start_us"), F.max(F.unix_micros(ts)).alias("end_us"),
        F.count("*").alias("n")).drop("w")


def run_debounced(events: DataFrame, checkpoint: str, action: Callable[[], None]) -> StreamingQuery:
    """Call ``action`` once per batch in which a debounced run has ended."""
    def fire(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            action()

    return events.writeStream.foreachBatch(fire).option(
        "checkpointLocation", checkpoint).outputMode("append").start()


def ingest_mode(spark: SparkSession, catalog_path: str) -> str:
    """'r' (reset) while the catalog does not exist, else 'c' (complete)."""
    return "c" if path_exists(spark, catalog_path) else "r"


