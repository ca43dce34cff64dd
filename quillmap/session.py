"""Session settings, shared scratch folders and the broadcast size check."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is only broadcast below both bounds; every caller has another way beyond them.
MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# bytes of an Arrow batch on its way to a Python worker; whole texts must not pile up on either side
BATCH_BYTES = "8m"


def recommended_conf() -> dict[str, str]:
    """Settings the operators are written for; ``shuffle.partitions`` is left to the cluster."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # whole texts travel in Arrow batches: bound them by bytes as well as by rows
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
    }


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillmap-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes through Python in Arrow batches of ``BATCH_BYTES``."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        conf.set(key, before)


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table, so that a lost executor never replays the plan."""
    path = scratch_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None):
    """The frame as an Arrow table if it is within both bounds, else ``None``.

    The row limit and a byte limit inside its task keep an oversized frame from ever reaching the
    driver: at most one batch beyond the bytes is sent.
    """
    max_rows = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes

    def up_to_bytes(batches):
        sent = 0
        for batch in batches:
            yield batch
            sent += batch.nbytes
            if sent > max_bytes:
                return

    table = df.limit(max_rows + 1).mapInArrow(up_to_bytes, df.schema).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return None
    return table


def spread_nulls(df: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out``: the key, or where it is NULL a text that nothing is joined with.

    An outer join deals all NULL keys to one task; these are dealt like any others.
    """
    own = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    return df.withColumn(out, F.coalesce(F.col(key), own))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer partitions than cores, hashed by its keys; any other scan unchanged.

    Meant for plain scans of few, large row groups in front of costly expressions. Cluster-sized
    input has more splits than cores and is not shuffled.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def deal_evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has, hashed by their keys; they are not put together by their bytes again.

    Meant for rows that are short but costly.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
