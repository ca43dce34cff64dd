"""SentencePiece encoding and decoding by a forward pass over the trie of distinct words.

A text is marked (every blank becomes the mark, one more stands in front) and cut where no piece can run
across. The distinct words of a stretch of texts are sorted, which lays them out as a depth-first traversal
of their trie: a word keeps the forward values of the prefix it shares with the word before it and
computes those of its other characters only.

* For a unigram model the forward value of a prefix is the best sum of scores, as in the Viterbi algorithm.
* The segmentation of a byte-pair model is not the one with the best sum of its scores, which are merge ranks.
  It has another property that a forward pass can use: a segmentation is the model's own exactly if each of
  its pieces and each pair of neighbours comes out of the merges unchanged. So each prefix has one last
  piece, and the forward value is that piece; pairs are merged once and remembered. Pieces are found by walking
  the vocabulary's own trie from every start that is still alive.

Words in which the mark repeats are merged directly, as their pieces share one rank. Characters without a piece
become byte pieces, or the unknown piece where the model has none.

Defined results: a null text counts as an empty one and has no pieces. Repeated rows are encoded each for itself; other
columns are not read; empty tables give empty results. The mark's own character in a text is read as a blank.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import row_slices, string_column

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Distinct words a process remembers; beyond it starts anew.
WORDS_KEPT = 500_000
PAIRS_KEPT = 600_000
#: Bits of a piece in the number of a pair: pieces, and behind them characters that are none.
PIECE_BITS = 22
#: Key of the piece that ends at a node of the vocabulary's trie; all other keys are characters.
PIECE = 0
NO_NODE: dict = {}
#: Below the lowest score, for a character without a piece.
UNKNOWN_PENALTY = 10.0

_loaded: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = PieceModel(f.read())
    return _loaded[path]


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; only the wire types that the model file uses."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            size = number() if size is None else size
            yield tag >> 3, data[at:at + size]
            at += size


def _shared(a: str, b: str) -> int:
    """Characters that both begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    for i in range(most):
        if a[i] != b[i]:
            return i
    return most


class PieceModel:
    """Pieces, scores and kind of a model file; ``encode`` and ``decode`` whole texts."""

    def __init__(self, proto: bytes, words_kept: int = WORDS_KEPT):
        import sentencepiece

        self.kind, charsmap, self.prefix = UNIGRAM, b"", True
        for field, value in _fields(proto):
            if field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                charsmap, self.prefix, squeeze = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        # a model with normalisation rules of its own has the library apply them
        self.normalise = self.library.normalize if charsmap or squeeze else None
        p, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        self.scores = {s: p.get_score(i) for s, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.unknown = p.unk_id()
        self.unknown_score = min(self.scores.values()) - UNKNOWN_PENALTY
        self.bytes = {int(p.id_to_piece(i)[1:-1], 16): i for i in range(n) if p.is_byte(i)}
        if any(MARK in s.lstrip(MARK) for s in self.ids):
            raise ValueError("a piece runs across words")
        lone = "\n" if not any("\n" in s for s in self.ids if len(s) > 1) else ""
        self.words = re.compile(f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" + "|\n" * bool(lone))
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.trie: dict = {}
        for s, i in self.ids.items() if self.kind == BPE else ():
            node = self.trie
            for char in s:
                node = node.setdefault(char, {})
            node[PIECE] = i
        self.limit = words_kept
        raw = [b""] * n
        for s, i in self.ids.items():
            raw[i] = s.replace(MARK, " ").encode()
        for byte, i in self.bytes.items():
            raw[i] = bytes([byte])
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = raw

    # one word

    def merge(self, word: str) -> list[str]:
        """The byte-pair merges themselves: always the pair of the best score, the first of equal ones."""
        parts, scores = list(word), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, piece: int) -> bool:
        """Whether the merges give the piece back whole."""
        text = self.text_of(piece)
        found = self.whole[piece] = self.merge(text) == [text]
        return found

    def text_of(self, piece: int) -> str:
        return self.pieces[piece] if piece < len(self.pieces) else chr(piece - len(self.pieces))

    def _neighbours(self, pair: int) -> bool:
        """Whether the merges leave the two pieces of a pair as they are."""
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        left, right = self.text_of(pair >> PIECE_BITS), self.text_of(pair & (1 << PIECE_BITS) - 1)
        found = self.pairs[pair] = self.merge(left + right) == [left, right]
        return found

    def _best_piece(self, word: str, end: int, best: list[float], last: list[str]) -> tuple[float, str]:
        """Viterbi's step: the best sum over the pieces that end here, the longest of equal ones."""
        found, piece = -float("inf"), ""
        for start in range(max(0, end - self.longest), end):
            part = word[start:end]
            score = self.scores.get(part)
            if score is None:
                if end - start > 1:
                    continue
                score = self.unknown_score
            if best[start] + score > found:
                found, piece = best[start] + score, part
        return found, piece

    # sorted words

    def learn(self, words: list[str]) -> None:
        """Segment sorted distinct words depth-first, keeping the forward values of shared prefixes."""
        if self.kind == BPE:
            self._learn_merges(words)
            return
        before, last, best = "", [""], [0.0]
        for word in words:
            shared = _shared(before, word)
            del last[shared + 1:], best[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                score, piece = self._best_piece(word, end, best, last)
                best.append(score)
                last.append(piece)
            parts, at = [], len(word)
            while at:
                parts.append(last[at])
                at -= len(last[at])
            self.memo[word] = self._as_ids(parts[::-1])
            before = word

    def _learn_merges(self, words: list[str]) -> None:
        """For each prefix, the one piece that can end it after the last pieces of shorter prefixes.

        Kept by the number of characters: that piece, where it starts, and the starts from which the vocabulary's trie
        can still be followed."""
        trie, pieces, whole, bits = self.trie, len(self.pieces), self.whole, PIECE_BITS
        before, last, begin, alive = "", [-1], [0], [[]]
        for word in words:
            if word.startswith(MARK + MARK):
                self.memo[word] = self._as_ids(self.merge(word))
                continue
            shared = _shared(before, word)
            del last[shared + 1:], begin[shared + 1:], alive[shared + 1:]
            live, end, plain = alive[shared], shared, True
            for char in word[shared:]:
                live = [(start, child) for start, node in live if (child := node.get(char)) is not None]
                live.append((end, trie[char] if char in trie else NO_NODE))
                pairs = self.pairs
                for start, node in live:
                    if PIECE in node:
                        piece = node[PIECE]
                        if start != end and not (whole[piece] if piece in whole else self._stays(piece)):
                            continue
                    elif start != end:
                        continue
                    else:
                        piece = pieces + ord(char)  # a character without a piece
                    if not start:
                        break
                    pair = last[start] << bits | piece
                    if pairs[pair] if pair in pairs else self._neighbours(pair):
                        break
                else:
                    raise AssertionError("a prefix without a segmentation")
                last.append(piece)
                begin.append(start)
                alive.append(live)
                end += 1
            found, at = [], len(word)
            while at:
                plain &= last[at] < pieces
                found.append(last[at])
                at = begin[at]
            found.reverse()
            self.memo[word] = self._packed(found) if plain else self._as_ids(list(map(self.text_of, found)))
            before = word

    def _packed(self, ids: list[int]) -> bytes:
        packed = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _as_ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for part in parts:
            if part in self.ids:
                out.append(self.ids[part])
            elif self.bytes:
                out.extend(self.bytes[b] for b in part.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return self._packed(out)

    # whole texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        words = []
        for text in texts:
            if text and self.normalise:
                text = self.normalise(text)
            elif text:
                text = MARK * self.prefix + text.replace(" ", MARK)
            words.append(self.words.findall(text))
        distinct = set().union(*words)
        new = distinct.difference(self.memo)
        if len(self.memo) + len(new) > self.limit:
            self.memo, new = {}, distinct
        self.learn(sorted(new))
        return [b"".join(map(self.memo.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype=self.dtype).tolist())).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", slice_rows: int = 512) -> DataFrame:
    """key, ids (binary, little-endian) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in row_slices(batches, slice_rows):
            yield pa.record_batch({key: batch.column(0), "ids": pa.array(model.encode([t or "" for t in batch.column(1).to_pylist()]), pa.binary())})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias(key), string_column(text, "text_")).mapInArrow(run, f"`{key}` {kind}, ids binary")


def decode_documents(encoded: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """key, text from the ids of ``encode_documents``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in row_slices(batches):
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({key: batch.column(0), "text": pa.array(texts, pa.string())})

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(f"`{key}`").alias(key), "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def encode_and_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pieces, ids_crc32 (of unsigned 32-bit ids), text_crc32 of the decoded text, round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in row_slices(batches, 512):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text_, ids in zip(texts, model.encode(texts), strict=True):
                back = model.decode(ids)
                wide = np.frombuffer(ids, dtype=model.dtype).astype("<u4")
                rows.append((len(wide), zlib.crc32(wide), zlib.crc32(back.encode()), back == text_))
            n, crc, back_crc, same = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))
            yield pa.record_batch({key: batch.column(0), "n_pieces": n, "ids_crc32": crc, "text_crc32": back_crc, "round_trip": same})

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_pieces bigint, ids_crc32 bigint, text_crc32 bigint, round_trip boolean"
    return docs.select(F.col(f"`{key}`").alias(key), string_column(text, "text_")).mapInArrow(run, schema)
