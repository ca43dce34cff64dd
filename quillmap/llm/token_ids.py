"""Token ids of whole texts through the tokenizers library, each distinct word encoded once per process.

The two vocabularies in use split a text before any merge, and no split piece runs from a visible character
into white space. So a text may be cut wherever white space follows a visible character, and the ids of the
cuts, one after the other, are the ids of the text. Words are kept in a bounded store in two generations;
where white space belongs to the word after it, the new words of many texts go to the library as one text, whose
ids are told apart by the tokens that begin with white space. Texts with rare kinds of white space, texts that hold
the string of an added token (which then is that token, as the library has it by default), and tokenizers of another
make go to the library in whole texts.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import unicodedata
from array import array
from itertools import chain

import numpy as np

#: White space other than blank, tab and line ends; the libraries disagree about some of these.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
WITH_SPACE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
#: Characters of a text that are split into words at a time.
STRETCH = 1 << 20
#: New words that go to the library as one text.
JOINED = 100
WHITE = (" ", "\t", "\n", "\r", "")
#: Distinct words of a generation; two generations are kept.
WORDS_KEPT = 250_000

_loaded: dict[str, TextEncoder] = {}


def encoder(path: str, words_kept: int = WORDS_KEPT) -> TextEncoder:
    """The process's encoder of a vocabulary file; the one who asks first says how many words it keeps."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path, words_kept)
    return _loaded[path]


def _make(path: str) -> str:
    """'spaced': white space belongs to the word after it. 'dropped': white space goes. Else 'whole'."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "spaced"
    steps = [x["type"] for x in pre.get("pretokenizers", [])]
    norms = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
        first, second = pre["pretokenizers"]
        if first["invert"] and first["behavior"] == "Removed" and not second.get("use_regex", True) and not second.get("add_prefix_space"):
            return "dropped"
    return "whole"


class Words(dict):
    """Ids of words; the generation before the present one is kept. Where white space goes they are found out when first asked for, else they are learnt."""

    def __init__(self, encode, merge, limit: int):
        self.encode, self.merge, self.limit = encode, merge, limit
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # words without the blank in front, and marks

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._find(word)
        self.turn()
        self[word] = ids
        return ids

    def turn(self) -> None:
        """A new generation, if the present one is full."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def learn(self, words: set[str], encode_all) -> None:
        """Take in words that this generation lacks. They begin with a line end, or stand for a word behind a blank."""
        new, tails = set(), {}
        for word in words:
            if (ids := self.old.get(word)) is not None:
                self[word] = ids
                continue
            if word[-1] in string.punctuation:  # behind a letter they are a piece of their own
                stem = word.rstrip(string.punctuation)
                if stem[-1:].isalpha():
                    tails[word] = stem
                    if stem in words or stem in self:
                        continue
                    if (ids := self.old.get(stem)) is not None:
                        self[stem] = ids
                        continue
                    word = stem
            new.add(word)
        self.update(encode_all(new))
        for word, stem in tails.items():
            self[word] = self[stem] + self.plain(word[len(stem):])

    def plain(self, word: str) -> bytes:
        """Of a word with its own white space in front, if any."""
        ids = self.bare.get(word)
        if ids is None:
            if len(self.bare) >= self.limit // 4:
                self.bare.clear()
            ids = self.bare[word] = self.encode(word)
        return ids

    def _find(self, word: str) -> bytes:
        # both vocabularies cut between a letter and a comma or stop
        if len(word) > 1 and word[-1] in ",." and word[-2].isalpha():
            return self[word[:-1]] + self.plain(word[-1])
        if word.isascii() and (low := word.lower()) != word:
            return self[low]
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):  # one piece for the merges
            return self.merge(word)
        return self.encode(word)


def _byte_characters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b if b in visible else 256 + hidden.index(b)) for b in range(256)]


class TextEncoder:
    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # their beginnings without letters, which no normalisation changes: a quick look for texts that may hold one
        self.marks = {t[:len(t) - len(t.lstrip("<|[>]_"))] for t in self.added}
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.code = "H" if self.vocabulary <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.make = _make(path)
        self.model, self.bytes = self.tokenizer.model, dict(enumerate(_byte_characters()))
        self.words = Words(self._library, self._merge, words_kept)
        if self.make == "spaced":
            self._note_white_space()

    def _note_white_space(self) -> None:
        white, vocabulary = (self.bytes[10], self.bytes[32]), self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(white)]] = True
        pairs = {pair for t in vocabulary for pair in zip(t, t[1:])}
        # no merge runs from a letter into the white space behind it, or from a line end into a letter, but for these letters
        last, first = {a for a, b in pairs if b in white}, {b for a, b in pairs if a == white[0]}
        self.before_white = {c for c in map(chr, range(0x250)) if self.bytes[c.encode()[-1]] in last}
        self.behind_line = {c for c in map(chr, range(0x250)) if self.bytes[c.encode()[0]] in first}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _library(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merge(self, word: str) -> bytes:
        """Of one word of letters, which no library rule splits: in lower case, straight to the model's merges."""
        if word.isascii():
            word = word.lower()
        else:
            low = unicodedata.normalize("NFC", word).lower()
            if not low.isalpha():  # a letter that becomes two characters
                return self._library(word)
            word = low.encode().decode("latin-1").translate(self.bytes)
        return self._pack([t.id for t in self.model.tokenize(word)])

    def _stretches(self, text: str):
        at = 0
        while len(text) - at > STRETCH and (m := CUT.search(text, at + STRETCH)):
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        out, held, size = [], [], 0
        for text in texts:
            out.append([])
            if self._may_hold_added(text):
                out[-1].append([self._library(text)])
                continue
            for stretch in self._stretches(text):
                ids, gaps, words = self._stretch(stretch)
                out[-1].append(ids)
                if gaps:
                    held.append((ids, gaps, words))
                    size += len(stretch)
                    if size >= STRETCH:
                        self._fill(held)
                        held, size = [], 0
        self._fill(held)
        return [parts[0][0] if len(parts) == 1 else b"".join(chain.from_iterable(parts)) for parts in out]

    def _fill(self, held: list[tuple[list[bytes | None], list[int], list[str]]]) -> None:
        """Put the ids of words met for the first time into their gaps."""
        if not held:
            return
        self.words.learn(set(chain.from_iterable(words for _, _, words in held)), self._encode_all)
        for ids, gaps, words in held:
            for at, word in zip(gaps, words, strict=True):
                ids[at] = self.words[word]
            ids[:] = [b"".join(ids)]
        self.words.turn()

    def _encode_all(self, words: set[str]):
        """Pairs of word and ids. Many words are one text, and words of letters, which are one piece, go straight to the merges."""
        letters, others = [], []
        for word in words:
            straight = word.isalpha() or word[0] == "\n" and word[1:].isalpha() and word[1] not in self.behind_line
            straight = straight and word[-1] not in self.before_white and (word.isascii() or max(word) < "\u0250")
            (letters if straight else others).append(word)
        ids: list[int] = []
        for text in self._joined(letters):
            pieces = text.encode().decode("latin-1").translate(self.bytes)
            ids += [t.id for t in self.model.tokenize(pieces)]
        for text in self._joined(others):
            if self._may_hold_added(text):
                return [(w, self._library(w if w[0] == "\n" else " " + w)) for w in words]
            ids += self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        packed = self._pack(ids)
        starts = np.flatnonzero(self.opens[np.frombuffer(packed, self.dtype)]) * self.dtype.itemsize
        bounds = [*starts.tolist(), len(packed)]
        return zip(letters + others, map(packed.__getitem__, map(slice, bounds, bounds[1:])), strict=True)

    @staticmethod
    def _joined(words: list[str]):
        for at in range(0, len(words), JOINED):
            yield "".join([w if w[0] == "\n" else " " + w for w in words[at:at + JOINED]])

    def _may_hold_added(self, text: str) -> bool:
        if not any(mark in text for mark in self.marks):
            return False
        low = text.lower()
        return any(t.lower() in low for t in self.added)

    def _stretch(self, text: str) -> tuple[list[bytes | None], list[int], list[str]]:
        """Ids in parts, the places of parts that are not known yet, and their words."""
        if self.make == "whole" or not text.replace("\n", "").isprintable() and RARE_SPACE.search(text):
            return [self._library(text)], [], []
        if self.make == "dropped":
            return [b"".join(map(self.words.__getitem__, text.split()))], [], []
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or "\t" in text or "\r" in text or text.endswith((" ", "\n\n")):
            pieces = WITH_SPACE.findall(text)
            words = [p if p[0] == "\n" else p[1:] if p[0] == " " else "" for p in pieces]
            words = [w if p[1:2] not in WHITE else "" for w, p in zip(words, pieces, strict=True)]
            ids = [self.words.get(w) if w else self.words.plain(p) for w, p in zip(words, pieces, strict=True)]
        else:
            words = text.replace("\n", " \n").split(" ")  # a line end belongs to the word after it like a blank
            ids = [self.words.plain(words[0]) if words[0] else b"", *map(self.words.get, words[1:])]
        gaps = [i for i, x in enumerate(ids) if x is None]
        return (ids, gaps, [words[i] for i in gaps]) if gaps else ([b"".join(ids)], [], [])
