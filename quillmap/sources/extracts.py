"""Sources whose decoding is a plug-in: page, scan-line and dataset-entry tables in, documents out.

A PDF, OCR or HDF5 library is the caller's extractor; ``extract`` runs it over file contents in
Arrow-sized batches and these functions assemble what it returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmap import constants as K


def extract(files: DataFrame, extractor: Callable[[str, bytes], list[dict]], schema: str
            ) -> DataFrame:
    """Run ``extractor(path, content)`` per file; its dicts become rows of ``schema``.

    ``schema`` must contain path and error. A file that fails yields one row with its error, so one
    bad file never drops the batch.
    """
    arrow_schema = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(),
                                     batch.column("content").to_pylist()):
                try:
                    rows += [{"path": path, **r} for r in extractor(path, content)]
                except Exception as e:        # noqa: BLE001 - the error becomes a row
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return files.select("path", "content").mapInArrow(run, schema)


def assemble_pages(pages: DataFrame, key: str = "path", order: str = "page_no",
                   text: str = "text") -> DataFrame:
    """(key, content, n_pages): page texts joined by line breaks in page order."""
    return pages.groupBy(key).agg(
        F.expr(f"listagg({text}, '\n') WITHIN GROUP (ORDER BY {order})").alias("content"),
        F.count("*").alias("n_pages"))


def assemble_ocr(lines: DataFrame, min_confidence: float = K.OCR_INGEST_CONFIDENCE,
                 key: str = "path", strip_text: bool = False) -> DataFrame:
    """(key, content): confident lines in order, joined by a space; '' when none is confident."""
    kept = lines.groupBy(key).agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY line_no) "
               f"FILTER (WHERE confidence > {min_confidence})").alias("_t"))
    content = F.coalesce("_t", F.lit(""))
    return kept.select(key, (F.trim(content) if strip_text else content).alias("content"))


def blob_summary(
    nbytes: Column, shape: Column, dtype: Column, value: Column,
    inline_bytes: int = K.BLOB_INLINE_BYTES,
) -> Column:
    """Value text of a small dataset, shape and type of a large one."""
    large = F.concat(F.lit("Large Dataset: shape="), shape, F.lit(", dtype="), dtype)
    return F.when(nbytes > inline_bytes, large).otherwise(
        F.coalesce(value, F.lit("Non-text binary data")))


def blob_label(attrs: Column) -> Column:
    """First non-empty of the label attributes."""
    return F.coalesce(*[
        F.nullif(F.try_element_at(attrs, F.lit(a)), F.lit("")) for a in K.BLOB_LABEL_ATTRS])


def blob_documents(entries: DataFrame, inline_bytes: int = K.BLOB_INLINE_BYTES) -> DataFrame:
    """One document per dataset entry (path, name, nbytes, shape, dtype, value, attrs)."""
    content = blob_summary(F.col("nbytes"), F.col("shape"), F.col("dtype"), F.col("value"),
                           inline_bytes)
    record = F.create_map(F.col("name"), content)
    return entries.select(
        "path", F.lit("h5").alias("type"), F.to_json(record).alias("content"),
        record.alias("record"), blob_label(F.col("attrs")).alias("suggested_label"))
