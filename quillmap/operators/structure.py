"""What the files of an archive say about each other: image index, mappings, file plans, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillmap import constants as K
from quillmap.functions.text import (
    basename,
    extension,
    has_any_word,
    is_label_noisy,
    is_visual,
    mapping_key,
    mapping_value,
    parent_folder,
    strip,
)
from quillmap.session import spread_nulls


def image_index(files: DataFrame) -> DataFrame:
    """(archive, name, image_path): lower-case file name of every image; the greatest path wins."""
    name = F.lower(basename(F.col("path")))
    return files.where(is_visual(F.col("path"))).groupBy("archive", name.alias("name")).agg(
        F.max("path").alias("image_path"))


def is_mapping_file(path: Column) -> Column:
    return extension(path).isin(K.MAPPING_FILE_EXTENSIONS) & has_any_word(
        basename(path), K.MAPPING_FILE_WORDS)


def file_mapping(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(*scope, file_name, label) from ``key = value`` lines; the last line of a key wins.

    ``lines`` has line and a sortable ``seq``.
    """
    scope = scope or []
    return (
        lines.select(*scope, mapping_key(F.col("line")).alias("file_name"),
                     mapping_value(F.col("line")).alias("label"), "seq")
        .where(F.col("file_name").isNotNull())
        .groupBy(*scope, "file_name").agg(F.max_by("label", "seq").alias("label"))
    )


def mapping_labels(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct valid labels of mapping lines: values, and bare lines of three characters up."""
    bare = F.lower(strip(F.col("line")))
    label = F.when(F.col("line").rlike("[=:]"), mapping_value(F.col("line"))).when(
        F.length(bare) >= K.LABEL_MIN_LENGTH, bare)
    return lines.select(*(scope or []), label.alias("label")).where("label <> ''").distinct()


def folder_labels(files: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct names of folders that hold files, unless technical or noisy."""
    return (
        files.select(*(scope or []), parent_folder(F.col("path")).alias("label")).distinct()
        .where(~F.col("label").isin(K.TECHNICAL_FOLDERS) & ~is_label_noisy(F.col("label")))
    )


# --- file plans -------------------------------------------------------------

def probe_path_columns(
    records: DataFrame, index: DataFrame,
    sample_rows: int = K.PLAN_SAMPLE_ROWS, probe_values: int = K.PLAN_PROBE_VALUES,
) -> DataFrame:
    """(file, path_key): first column whose sampled values name an indexed image.

    ``records`` has file, archive, row_no and record (map). The sample is the rule itself: the first
    rows of each file and the first non-null values of each column among them.
    """
    first_rows = Window.partitionBy("file").orderBy("row_no")
    cells = (
        records.withColumn("_r", F.row_number().over(first_rows))
        .where(F.col("_r") <= sample_rows)
        .select("file", "archive", "_r",
                F.posexplode(F.map_entries("record")).alias("ordinal", "cell"))
        .where(F.col("cell.value").isNotNull())
    )
    first_values = Window.partitionBy("file", "ordinal").orderBy("_r")
    probes = (
        cells.withColumn("_v", F.row_number().over(first_values))
        .where(F.col("_v") <= probe_values)
        .select("file", "archive", "ordinal", F.col("cell.key").alias("column"),
                F.lower(strip(F.col("cell.value"))).alias("name"))
    )
    return probes.join(index, ["archive", "name"], "left_semi").groupBy("file").agg(
        F.min_by("column", "ordinal").alias("path_key"))


def first_records(records: DataFrame) -> DataFrame:
    """(file, record): the first row of every file, reduced on the map side."""
    return records.groupBy("file").agg(F.min_by("record", "row_no").alias("record"))


def discover_label_columns(first: DataFrame, path_columns: DataFrame | None = None) -> DataFrame:
    """(file, label_key, first_value): first magic-word column with a clean first value."""
    cells = first.select("file", F.posexplode(F.map_entries("record")).alias("ordinal", "cell"))
    if path_columns is not None:
        cells = cells.join(
            path_columns.select("file", F.col("path_key")), "file", "left"
        ).where(~F.col("cell.key").eqNullSafe(F.col("path_key")))
    ok = has_any_word(F.col("cell.key"), K.PLAN_MAGIC_WORDS) & ~is_label_noisy(F.col("cell.value"))
    return (
        cells.where(ok).groupBy("file").agg(F.min_by("cell", "ordinal").alias("_c"))
        .select("file", F.col("_c.key").alias("label_key"),
                F.col("_c.value").alias("first_value"))
    )


def file_plans(path_columns: DataFrame, label_columns: DataFrame) -> DataFrame:
    """(file, type, label_key, path_key, image_found) for files where either column was found."""
    return label_columns.select("file", "label_key").join(path_columns, "file", "full").select(
        "file", F.lit("column").alias("type"),
        F.coalesce("label_key", F.lit("unknown")).alias("label_key"),
        "path_key", F.col("path_key").isNotNull().alias("image_found"),
    )


# --- links ------------------------------------------------------------------

def link_name(value: Column) -> Column:
    """Lower-case image name of a record value; NULL for '', 'nan' and 'none'."""
    name = F.lower(strip(value))
    return F.when(~name.isin("", "nan", "none"), name)


def link_records(records: DataFrame, plans: DataFrame, index: DataFrame) -> DataFrame:
    """Records with ``image_path``: the image their plan's path column names, if it exists."""
    keyed = records.join(plans.select("file", "path_key"), "file", "left")
    named = keyed.withColumn(
        "name", link_name(F.try_element_at(F.col("record"), F.col("path_key"))))
    # most records may name no image: they must not meet in one task
    return spread_nulls(named, "name", "name").join(index, ["archive", "name"], "left").drop("name", "path_key")


def linked_images(linked: DataFrame) -> DataFrame:
    return linked.where("image_path IS NOT NULL").select(F.col("image_path").alias("path")
                                                         ).distinct()


def drop_linked_images(files: DataFrame, linked: DataFrame) -> DataFrame:
    """Files that are still tasks of their own: everything but the linked images."""
    return files.join(linked_images(linked), "path", "left_anti")


# --- schema cache -----------------------------------------------------------

def schema_cache(resolved: DataFrame) -> DataFrame:
    """(folder, label_key): the first label column found in each folder."""
    return resolved.where("label_key IS NOT NULL").groupBy("folder").agg(
        F.min_by("label_key", "seq").alias("label_key"))


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``updates`` replace rows of ``base`` with the same key."""
    return base.join(updates, key, "left_anti").unionByName(updates)
