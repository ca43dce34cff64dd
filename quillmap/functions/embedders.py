"""Embedding as a plug-in: a model is loaded once per task and fed Arrow batches.

An embedder is any callable that turns an Arrow array of inputs into a float matrix. Real models are
supplied by the caller as a factory; the two classes below are deterministic doubles for tables
and tests, not models.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from quillmap.functions.text import clean_text
from quillmap.functions.vectors import arrow_once, matrix_to_list_array

Embedder = Callable[[pa.Array], np.ndarray]


class HashingTextEmbedder:
    """Signed feature hashing of whole texts: md5 of a word picks the slot and the sign.

    Words are split and numbered by Arrow, so Python only ever sees the distinct words of a slice.
    """

    MAX_CACHED_WORDS = 500_000
    SLICE = 1024

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._slots = _Slots(dim)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        parts = [self._hash(texts.slice(i, self.SLICE)) for i in range(0, len(texts), self.SLICE)]
        return np.concatenate(parts)

    def _hash(self, texts: pa.Array) -> np.ndarray:
        n, width = len(texts), 2 * self.dim
        if len(self._slots) > self.MAX_CACHED_WORDS:
            self._slots.clear()
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self._slots.__getitem__, names), np.int64, len(names))
        rows = np.repeat(np.arange(n), np.asarray(words.value_lengths()))
        at = rows * width + slots[np.asarray(coded.indices)]
        counts = np.bincount(at, minlength=n * width).reshape(n, width)
        return counts[:, : self.dim] - counts[:, self.dim:]


class _Slots(dict):
    """word -> slot, plus ``dim`` where the word counts negatively; filled on first use."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode()).hexdigest()
        slot = int(digest[:8], 16) % self.dim + (0 if int(digest[8], 16) < 8 else self.dim)
        self[word] = slot
        return slot


def _embed(column: Column, make: Callable[[], Embedder], empty: str | bytes) -> Column:
    """Unit vectors of the non-empty inputs; the model is made once per task."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for batch in batches:
            usable = pc.fill_null(pc.not_equal(batch, pa.scalar(empty, batch.type)), False)
            rows = np.flatnonzero(np.asarray(usable))
            if not len(rows):
                yield pa.nulls(len(batch), pa.list_(pa.float64()))
                continue
            matrix = np.asarray(model(batch.filter(usable)), dtype=np.float64)
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            ok = norms > 0
            yield matrix_to_list_array(rows[ok], matrix[ok] / norms[ok, None], len(batch))

    return arrow_once(run, "array<double>")(column)


def embed_text(text: Column, make: Callable[[], Embedder] = HashingTextEmbedder) -> Column:
    """Unit vector of the cleaned text; NULL where nothing is left to embed."""
    return _embed(clean_text(text), make, "")


def embed_image(content: Column, make: Callable[[], Embedder]) -> Column:
    """Unit vector of image bytes; NULL where there is no image."""
    return _embed(content, make, b"")
