"""Content fingerprints and derived keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap import constants as K


def fingerprint(
    content: Column,
    length: Column,
    mtime: Column,
    full_bytes: int = K.FINGERPRINT_FULL_BYTES,
    slice_bytes: int = K.FINGERPRINT_SLICE_BYTES,
) -> Column:
    """md5 over ``size_mtime`` and the bytes: all of a small file, else start, middle and end.

    ``content`` is binary and ``mtime`` an integer (microseconds since the epoch).
    """
    head = F.encode(F.concat_ws("_", length.cast("string"), mtime.cast("string")), "UTF-8")
    middle = (F.floor(length / 2) + 1).cast("int")
    sliced = F.concat(
        F.substring(content, 1, slice_bytes),
        F.substring(content, middle, F.lit(slice_bytes)),
        F.substring(content, -slice_bytes, slice_bytes),
    )
    body = F.when(length <= full_bytes, content).otherwise(sliced)
    return F.md5(F.concat(head, body))


def fingerprint_of_slices(slices: Column, length: Column, mtime: Column) -> Column:
    """The same for a large file of which only the three slices were read."""
    head = F.encode(F.concat_ws("_", length.cast("string"), mtime.cast("string")), "UTF-8")
    return F.md5(F.concat(head, slices))


def record_hash(file_hash: Column, position: Column, n_records: Column) -> Column:
    """Key of one record: the file hash itself when the file holds a single record."""
    derived = F.md5(F.concat_ws("_", file_hash, position.cast("string")).cast("binary"))
    return F.when(n_records > 1, derived).otherwise(file_hash)
