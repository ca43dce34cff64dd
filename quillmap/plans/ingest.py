"""Ingestion: changed folders, new files, documents, vectors, domains, labels, catalog, contracts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap import constants as K
from quillmap.functions.embedders import (
    Embedder,
    HashingTextEmbedder,
    embed_image,
    embed_text,
)
from quillmap.functions.hashing import fingerprint, fingerprint_of_slices, record_hash
from quillmap.functions.text import archive_of, basename, dirname
from quillmap.functions.vectors import fuse
from quillmap.operators import catalog as C
from quillmap.operators import domains as D
from quillmap.operators import labels as L
from quillmap.operators import models as M
from quillmap.operators import structure as I
from quillmap.session import deal_evenly, spread_nulls, write_scratch
from quillmap.sources import extracts as E
from quillmap.sources import files as R
from quillmap.sources import ranges as G


@dataclass(frozen=True)
class IngestSettings:
    """Plug-ins and thresholds; ``None`` leaves a plug-in out."""

    domains: list[str] = field(default_factory=lambda: list(K.DEFAULT_DOMAINS))
    text_embedder: Callable[[], Embedder] = HashingTextEmbedder
    image_embedder: Callable[[], Embedder] | None = None
    ocr: Callable[[str, bytes], list[dict]] | None = None      # line_no, text, confidence
    pdf: Callable[[str, bytes], list[dict]] | None = None      # page_no, text
    h5: Callable[[str, bytes], list[dict]] | None = None       # name, nbytes, shape, dtype, ...
    model: Callable[[], M.Model] | None = None
    label_threshold: float = K.SEMANTIC_THRESHOLD
    strict_magic: bool = True
    use_suggested: bool = False
    signature_depth: str = "all"
    # the first arbitrated document of an archive decides for those behind it
    session_rule: bool = False


# --- documents to catalog rows ----------------------------------------------

def classify_documents(
    docs: DataFrame, contracts: DataFrame, labels: DataFrame | None = None,
    mapping: DataFrame | None = None, settings: IngestSettings = IngestSettings(),
    ingested_at: int | None = None,
) -> DataFrame:
    """Add vector, domain, label and extra to documents, ready for ``catalog_rows``.

    ``docs``: doc_id, path, archive, position, type, content, record, visual, file_hash, doc_hash,
    label_key, suggested_label, image_path. ``labels`` (archive, label) are the valid labels,
    ``mapping`` (archive, file_name, label) the explicit ones. Everything is row-local or a join
    with a dimension; nothing is keyed by archive alone except those joins, so one archive may
    hold most documents.
    """
    spark = docs.sparkSession
    is_record = F.col("record").isNotNull()
    make = settings.text_embedder
    context = D.context_text(F.col("path"), F.when(is_record, F.col("content")))
    # both texts in one projection: one Python stage embeds them
    docs = docs.withColumns({
        "_tv": embed_text(F.col("content"), make), "_ctx": embed_text(context, make),
    }).withColumn("vector", fuse(F.col("_tv"), F.col("visual"))).drop("_tv")
    refs = D.reference_matrix(
        D.prompt_centroids(spark, settings.domains, make), "domain", "centroid",
        settings.domains)
    docs = D.detect_domains(docs, *refs, F.col("_ctx"), F.col("vector"))

    decisions = None
    if settings.model is not None:
        docs = write_scratch(docs, "detected")         # read again by the model joins
        asked = docs.withColumns({
            "text": F.col("content"),
            "confused": F.col("confused") | (F.col("det_score") < K.ARBITRATION_BELOW)})
        decisions = M.arbitrate_domains(asked, settings.model, settings.domains)
    session = None
    if decisions is not None and settings.session_rule:
        decisions = write_scratch(decisions, "decisions")
        docs = docs.withColumn("seq", F.struct("path", "position"))
        unsure = docs.where(F.col("det_score") < K.ARBITRATION_BELOW).select("doc_id", "archive", "seq")
        session = D.session_decisions(unsure.join(decisions, "doc_id").select(
            "archive", "seq", F.col("final_domain").alias("domain"), F.col("confidence").alias("score")))
    docs = D.resolve_precedence(docs, contracts, decisions, session).drop("seq")

    docs = docs.withColumn("file_name", F.lower(basename(F.col("path"))))
    if mapping is not None:
        docs = docs.join(mapping.withColumnRenamed("label", "explicit_label"),
                         ["archive", "file_name"], "left")
    suggested = F.lower(F.trim(F.col("suggested_label")))
    docs = docs.withColumns({
        "suggested_label": suggested if settings.use_suggested else F.lit(None).cast("string"),
        "record_label": F.when(is_record, F.coalesce(
            L.record_label(F.col("record"), F.col("label_key"),
                           F.col("folder_key") if "folder_key" in docs.columns
                           else F.lit(None).cast("string"),
                           settings.strict_magic), F.lit("unknown"))),
        "folder_file_label": F.when(~is_record, L.folder_file_label(F.col("path"))),
    })
    if labels is None:
        labels = spark.createDataFrame([], "archive string, label string")
    vectors = labels.withColumn("vector", embed_text(F.col("label"), make))
    docs = L.cascade(docs, "content", "visual", labels, vectors, settings.label_threshold,
                     scope_col="archive")
    if settings.model is not None:
        needs = ~is_record & L.needs_refinement(F.col("label"), F.col("content"))
        docs = M.refine_labels(docs, settings.model, needs, text="content")
    at = int(time.time()) if ingested_at is None else ingested_at
    return docs.withColumns({
        "source": F.col("path"),
        "image_linked": F.col("image_path"),
        "extra": C.extra_json(
            detection_method=F.col("method"), label_method=F.col("label_method"),
            ingested_at=F.lit(at), justification=F.col("justification")),
    })


def remember_columns(docs: DataFrame, cache: DataFrame, settings: IngestSettings
                     ) -> tuple[DataFrame, DataFrame]:
    """(documents with folder_key, new cache): the label column remembered for each folder.

    A record that neither its file's plan nor the folder's column can label is searched for a magic
    word; the first such column counts for the later records of the folder and for later runs.
    """
    folder, seq = dirname(F.col("path")), F.struct("path", "position")
    known = docs.withColumn("folder", folder).join(
        cache.withColumnRenamed("label_key", "_cached"), "folder", "left")
    record = F.col("record")
    unlabelled = F.coalesce(L.record_value(record, F.col("label_key")),
                            L.record_value(record, F.col("_cached"))).isNull()
    found = known.where(record.isNotNull() & unlabelled).select(
        "folder", seq.alias("seq"), L.magic_key(record, settings.strict_magic).alias("label_key"))
    found = found.where("label_key IS NOT NULL").groupBy("folder").agg(
        F.min("seq").alias("_since"), F.min_by("label_key", "seq").alias("_found"))
    found = write_scratch(found, "columns")
    keyed = known.join(found, "folder", "left").withColumn(
        "folder_key", F.coalesce("_cached", F.when(seq >= F.col("_since"), F.col("_found"))))
    updates = found.select("folder", F.col("_found").alias("label_key"))
    return keyed.drop("folder", "_cached", "_since", "_found"), I.upsert(cache, updates, "folder")


def contract_updates(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """New contracts from catalog rows: the last known domain of each archive, its signature."""
    ordered = rows.select("archive", F.struct("source", "position").alias("seq"), "domain",
                          F.col("domain_score").cast("double").alias("score"))
    return D.archive_domain(ordered).join(signatures, "archive").select(
        F.col("archive").alias("folder_path"), "signature",
        F.col("domain").alias("assigned_domain"),
        F.col("score").cast("float").alias("confidence"), F.lit(0).alias("is_verified"))


def image_vector(settings: IngestSettings):
    """Vector of the image in ``content``; NULL where no image model is plugged in."""
    if settings.image_embedder is None:
        return F.lit(None).cast("array<double>")
    return embed_image(F.col("content"), settings.image_embedder)


# --- folders to documents ---------------------------------------------------

ERROR_SCHEMA = "path string, stage string, message string"


def load_documents(spark: SparkSession, tasks: DataFrame, settings: IngestSettings) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of the task files and of no others.

    Documents are (path, archive, file_hash, position, type, content, record, suggested_label,
    visual), errors (path, stage, message).
    """
    no_record = F.lit(None).cast("map<string,string>")
    no_text = F.lit(None).cast("string")
    names = R.DOCUMENT_COLUMNS
    of_type = {t: tasks.where(F.col("type") == t) for t in ("csv", "tsv", "json", "txt", "pdf", "h5", "image")}
    parts, errors = [], [spark.createDataFrame([], ERROR_SCHEMA)]

    def failed(rows: DataFrame, stage: str, message) -> None:
        errors.append(rows.select("path", F.lit(stage).alias("stage"), message.alias("message")))

    for kind in ("csv", "tsv"):
        rows, bad = R.delimited_documents(of_type[kind], kind)
        parts.append(rows)
        failed(bad, kind, F.col("message"))
    rows, bad = R.json_files(of_type["json"])
    parts.append(rows)
    failed(bad, "json", F.col("message"))
    texts, bad = R.whole_texts(of_type["txt"])
    parts.append(R.txt_documents(texts))
    failed(bad, "txt", F.col("message"))

    def extracted(kind: str, extractor, schema: str) -> DataFrame:
        """What an extractor makes of the task files; it sees each once."""
        files = G.contents(of_type[kind])
        failed(files.where("error IS NOT NULL"), kind, F.col("error"))
        rows = E.extract(files.where("error IS NULL").select("path", "content"), extractor, schema)
        rows = write_scratch(rows, f"{kind}-rows")
        failed(rows.where("error IS NOT NULL"), kind, F.col("error"))
        return rows.where("error IS NULL")

    if settings.pdf is not None:
        pages = extracted("pdf", settings.pdf, "path string, page_no int, text string, error string")
        parts.append(E.assemble_pages(pages).select(
            "path", F.lit(0).cast("bigint").alias("position"), F.lit("pdf").alias("type"),
            "content", no_record.alias("record"), no_text.alias("suggested_label")))
    if settings.h5 is not None:
        entries = extracted(
            "h5", settings.h5,
            "path string, name string, nbytes bigint, shape string, dtype string, value string, "
            "attrs map<string,string>, error string")
        parts.append(E.blob_documents(entries).select(
            "path", F.xxhash64(F.map_keys("record")[0]).alias("position"), "type", "content",
            "record", "suggested_label"))
    docs = spark.createDataFrame([], (
        "path string, position bigint, type string, content string, record map<string,string>, "
        "suggested_label string"))
    for part in parts:
        docs = docs.unionByName(part.select(*names))
    docs = docs.withColumn("visual", F.lit(None).cast("array<double>"))

    images = G.contents(of_type["image"]).where("error IS NULL").select(
        "path", F.lit(0).cast("bigint").alias("position"), F.lit("image").alias("type"),
        image_vector(settings).alias("visual"))
    if settings.ocr is not None:
        lines = extracted("image", settings.ocr,
                          "path string, line_no int, text string, confidence double, error string")
        images = images.join(E.assemble_ocr(lines), "path", "left")
    else:
        images = images.withColumn("content", F.lit(""))
    docs = docs.unionByName(images.select(
        "path", "position", "type", F.coalesce("content", F.lit("")).alias("content"),
        no_record.alias("record"), no_text.alias("suggested_label"), "visual"))
    all_errors = errors[0]
    for rows in errors[1:]:
        all_errors = all_errors.unionByName(rows)
    return docs.join(tasks.select("path", "archive", "file_hash"), "path"), all_errors


def link_images(docs: DataFrame, members: DataFrame, settings: IngestSettings) -> tuple[DataFrame, DataFrame]:
    """(documents, file plans): records take over the vector of the image they name.

    ``members`` are all files of the opened archives, so that a new record finds an image that an
    earlier run has seen. Linked images are no documents of their own any more.
    """
    index = I.image_index(members)
    records = docs.where("record IS NOT NULL").select(
        F.col("path").alias("file"), "archive", F.col("position").alias("row_no"), "record")
    path_cols = I.probe_path_columns(records, index)
    plans = I.file_plans(path_cols,
                         I.discover_label_columns(I.first_records(records), path_cols))
    if settings.model is not None:
        asked = M.map_columns(
            records.join(plans.where("label_key <> 'unknown'"), "file", "left_anti"),
            settings.model).where("label_key IS NOT NULL").select(
            "file", F.col("label_key").alias("_m"))
        plans = plans.join(asked, "file", "full").select(
            "file", F.coalesce("type", F.lit("column")).alias("type"),
            F.coalesce(F.nullif("label_key", F.lit("unknown")), "_m", F.lit("unknown")
                       ).alias("label_key"),
            "path_key", F.coalesce("image_found", F.lit(False)).alias("image_found"))
    plans = write_scratch(plans, "plans")
    keyed = docs.join(plans.select(F.col("file").alias("path"), "label_key", "path_key"),
                      "path", "left")
    named = keyed.withColumn(
        "name", I.link_name(F.try_element_at(F.col("record"), F.col("path_key"))))
    # most documents name no image: joins by a NULL would meet in one task
    linked = spread_nulls(named, "name", "name").join(index, ["archive", "name"], "left").drop("name", "path_key")
    fresh = docs.where("type = 'image'").select(
        F.col("path").alias("image_path"), F.col("visual").alias("_v"))
    # images outside this run's tasks: usually none, and then nothing is read
    older = linked.where("image_path IS NOT NULL").select("image_path").distinct().join(
        fresh, "image_path", "left_anti")
    older = older.withColumnRenamed("image_path", "path").join(members.select("path", "length"), "path")
    again = G.contents(write_scratch(older, "older-images")).where("error IS NULL").select(
        F.col("path").alias("image_path"),
        image_vector(settings).alias("_v"))
    vectors = fresh.unionByName(again)
    merged = spread_nulls(linked, "image_path", "_image").join(
        vectors.withColumnRenamed("image_path", "_image"), "_image", "left").withColumn(
        "visual", F.coalesce("visual", "_v")).drop("_v", "_image")
    return I.drop_linked_images(merged, linked.where("record IS NOT NULL")), plans


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, archive, type, length, file_hash): small files are read whole, of large ones three slices.

    A file that cannot be read now has no row; a later run meets it again."""
    known = files.select("path", "archive", "type", "length", "mtime")
    small = known.where(F.col("length") <= K.FINGERPRINT_FULL_BYTES)
    whole = G.contents(small).where("error IS NULL").join(small, "path").select(
        "path", fingerprint(F.col("content"), F.col("length"), F.col("mtime")).alias("file_hash"))
    large = known.where(F.col("length") > K.FINGERPRINT_FULL_BYTES)
    sliced = R.read_ranges(large, K.FINGERPRINT_SLICE_BYTES).select(
        "path", fingerprint_of_slices(F.col("slices"), F.col("length"), F.col("mtime")).alias("file_hash"))
    return known.drop("mtime").join(whole.unionByName(sliced), "path").select(
        "path", "archive", "type", "length", "file_hash")


def mapping_lines(files: DataFrame) -> DataFrame:
    """(archive, line, seq) of the mapping files, line by line."""
    lines = G.text_lines_of(files)
    return lines.join(files.select("path", "archive"), "path").select(
        "archive", "line", F.struct("path", "pos").alias("seq"))


@dataclass(frozen=True)
class IngestResult:
    batch: str
    n_archives: int
    rows: DataFrame            # the rows this run added
    errors: DataFrame          # (path, stage, message) of files that gave no or not all documents
    counters: DataFrame        # (status, n) of the files of the opened archives


def ingest(
    spark: SparkSession, root: str, catalog_path: str, contracts_path: str, mode: str = "c",
    settings: IngestSettings = IngestSettings(), batch: str | None = None,
    version: int | None = None,
) -> IngestResult:
    """Ingest the folders below ``root``: everything (``mode='r'``) or what has changed (``'c'``).

    Folder metadata alone decides which archives are opened, and only files whose contents the
    catalog does not know are read by the loaders.
    """
    batch = batch or uuid.uuid4().hex
    root = root.rstrip("/")
    contracts = C.read_contracts(spark, contracts_path)
    if mode == "r":
        contracts = contracts.where("false")
    found = write_scratch(R.list_files(spark, root), "files").withColumn(
        "archive", archive_of(F.col("path"), root))
    listing = R.supported_files(found)
    signatures = C.folder_signatures(listing, settings.signature_depth)
    changed = write_scratch(C.changed_archives(signatures, contracts), "changed")
    opened = changed.select("archive")
    n_archives = changed.count()
    unsupported = R.unsupported_files(found).select(
        "path", F.lit("route").alias("stage"), F.col("error").alias("message"))
    if not n_archives:
        none = spark.createDataFrame([], C.CATALOG_SCHEMA)
        if mode == "r":
            C.reset_catalog(none.drop("batch"), catalog_path, batch)
            C.reset_contracts(contracts.where("false"), contracts_path, batch)
        return IngestResult(batch, 0, none, unsupported,
                            spark.createDataFrame([], "status string, n bigint"))

    files = listing.join(opened, "archive", "left_semi")
    members = files = write_scratch(file_hashes(files), "members")

    def before() -> tuple[DataFrame, DataFrame]:
        """Rows of other runs, and the images that their records have taken over: these are in the catalog under
        the record's hash."""
        rows = C.read_catalog(spark, catalog_path).where(F.col("batch") != batch)
        rows = rows.where("false") if mode == "r" else rows
        return rows, rows.where("image_linked <> ''").select(
            F.col("image_linked").alias("path"), F.lit(True).alias("_linked")).distinct()

    others, linked = before()
    statuses = write_scratch(C.file_status(files, others).join(linked, "path", "left").withColumn(
        "status", F.when(F.col("_linked"), "linked").otherwise(F.col("status"))), "statuses")
    counters = C.ingest_counters(statuses)
    moved = statuses.where("status = 'moved'")
    if moved.limit(1).count():
        C.store_moves(spark, catalog_path, write_scratch(C.moved_sources(moved, others, found), "moves"))
        others, linked = before()                    # files of the catalog have been replaced
    tasks = write_scratch(C.new_files(files, others).join(linked, "path", "left_anti"), "tasks")

    # the sources are read once; linking and labelling work on the written documents
    docs, errors = load_documents(spark, tasks, settings)
    docs = write_scratch(docs, "documents")
    docs, _ = link_images(docs, members, settings)
    counts = docs.groupBy("path").agg(F.count("*").alias("_n"))
    docs = docs.join(counts, "path").withColumns({
        "doc_hash": record_hash(F.col("file_hash"), F.col("position"), F.col("_n")),
        "doc_id": F.md5(F.concat_ws("#", "path", F.col("position").cast("string"))
                        .cast("binary")),
    }).drop("_n")

    lines = mapping_lines(members.where(I.is_mapping_file(F.col("path"))))
    labels = I.mapping_labels(lines, ["archive"]).unionByName(
        I.folder_labels(members, ["archive"])).distinct()
    columns_path = f"{contracts_path}.columns"
    cache = spark.createDataFrame([], "folder string, label_key string")
    if mode != "r" and C.path_exists(spark, columns_path):
        cache = spark.read.schema(cache.schema).parquet(columns_path)
    docs, cache = remember_columns(docs, cache, settings)
    cache = write_scratch(cache, "columns")
    # short records fill few partitions by their bytes, but each goes through the embedder
    docs = deal_evenly(docs, "doc_id")
    rows = classify_documents(docs, contracts, labels, I.file_mapping(lines, ["archive"]), settings)
    rows = C.catalog_rows(rows)
    if mode == "r":
        C.reset_catalog(rows, catalog_path, batch)
    else:
        C.append_catalog(rows, catalog_path, batch)
    added = C.read_catalog(spark, catalog_path).where(F.col("batch") == batch)
    updates = contract_updates(added, changed)
    # folders whose files were all known get their new signature with the domain they had
    settled = changed.join(updates.select(F.col("folder_path").alias("archive")), "archive",
                           "left_anti")
    kept = settled.join(
        contracts.select(F.col("folder_path").alias("archive"), "assigned_domain", "confidence",
                         "is_verified"), "archive", "left"
    ).select(F.col("archive").alias("folder_path"), "signature",
             F.coalesce("assigned_domain", F.lit("unknown")).alias("assigned_domain"),
             F.coalesce("confidence", F.lit(0.0)).cast("float").alias("confidence"),
             F.coalesce("is_verified", F.lit(0)).alias("is_verified"))
    if mode == "r":
        C.reset_contracts(updates.unionByName(kept), contracts_path, batch)
    else:
        C.append_contracts(updates.unionByName(kept), contracts_path, batch,
                           time.time_ns() if version is None else version)
    C.replace_folder(spark, columns_path, lambda to: cache.coalesce(1).write.parquet(to))
    return IngestResult(batch, n_archives, added, unsupported.unionByName(errors), counters)
