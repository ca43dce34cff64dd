"""Token ids, packing and the coded files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmap.llm import packing, rans, token_ids
from quillmap.llm.common import write_scratch
from quillmap.session import scratch_dir
from tests.llm.helpers import documents

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "a  b", "a\n b", "\n\n a", "x \n  y\t z", "a\u00a0b \u3000 c", "don't 'll  it's", "\u00c1 e\u0301 \u0301x", "\u03a3\u0391\u03a3 \u039f\u0394\u039f\u03a3 ", "<|endoftext|> hi", "a <|endoftext|> b", "a<|ENDOFTEXT|>b", "<|startoftext|>x<|endoftext|><|endoftext|>", "x <| y |> <|endoftext |>",
    "a" * 5000, " " * 50 + "b", "tail  ", "tail\n\n", "\x1c\x1d a", "\u65e5\u672c \u8a9e", "\U0001f600 \U0001f600", "a\r\n\r\nb", "1 234 567's", " lead x", "a \n b",
    "x.\n\nY z", "q,\nR  s", "\n", "\na b", "A.B. c.d, E,", "\u00e9, \u00fc. \u00c9, x", "x\u0301, y", "foo,. bar.,", "\u0130 \u00df \ufb01", "THE The the, The.",
]


def library(path):
    t = Tokenizer.from_file(path)  # as it comes
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path, monkeypatch):
    rng, want = random.Random(1), library(path)
    texts = ODD + ["".join(rng.choice("abcABC .,'\n\t\u00e9\u00a0!1") for _ in range(200)) for _ in range(300)]
    for stretch, kept in ((1 << 20, 10_000), (16, 30)):
        monkeypatch.setattr(token_ids, "STRETCH", stretch)
        encode = token_ids.TextEncoder(path, kept)
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, encode.dtype).tolist() == want(text), repr(text)


def pack_brute(rows, path, end_id, capacity):
    ids_of, out = library(path), []
    for d, text in rows:
        ids = [*ids_of(text or ""), end_id]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], dtype="<u4")
            out.append((d, piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_packed(got, capacity):
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["tree", "sky", "run", "blue"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "word " * 1000), (None, "no id"), (5, rows[5][1]), (5, rows[5][1])]
    docs = documents(spark, [(*r, 7) for r in rows], "doc_id bigint, text string, length int")
    got = packing.pack_documents(docs, WORD, end_id=1, capacity=64).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == pack_brute(rows, WORD, 1, 64)
    lengths = np.bincount([r.length for r in got], minlength=65)
    assert check_packed(got, 64) <= sum(n for _, n in packing.best_fit(lengths)) + 1
    assert packing.pack_documents(documents(spark, []), WORD).collect() == []


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for capacity, low, high, n in ((64, 1, 65, 500), (64, 20, 65, 300), (100, 1, 10, 50), (16, 16, 17, 5), (16, 1, 2, 40), (50, 26, 51, 40), (1, 1, 2, 3)):
        counts = np.bincount(rng.integers(low, high, n), minlength=capacity + 1)
        runs = packing.plan(counts.copy())
        used = np.zeros_like(counts)
        for pattern, times in runs:
            assert sum(a * b for a, b in pattern) <= capacity and times > 0
            for length, copies in pattern:
                used[length] += copies * times
        assert (used[1:] == counts[1:]).all()
    assert packing.plan(np.zeros(65, dtype=np.int64)) == []


def test_exact_complements_come_first():
    counts = np.zeros(65, dtype=np.int64)
    counts[[40, 24, 30, 20, 14, 33, 11, 10]] = [2, 1, 1, 1, 1, 1, 1, 2]
    runs = packing.plan(counts)
    full = [p for p, n in runs if sum(a * b for a, b in p) == 64]
    assert {((40, 1), (24, 1)), ((40, 1), (14, 1), (10, 1)), ((33, 1), (20, 1), (11, 1))} <= set(full)


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.01, 70_000), 50_000).astype(np.int64)
    tokens, counts = np.unique(ids, return_counts=True)
    table = rans.Table.from_counts(tokens, counts)
    assert int(table.freq.sum()) == 1 << rans.TOTAL_BITS and table.freq.min() >= 1
    for n, lanes, steps in ((1, 4, 2), (5, 8, 4), (64, 1, 3), (5000, 8, 16), (70_000, 1024, 4), (70_000, 64, 1000)):
        payload = rans.encode_block([(3, ids[:n // 2]), (None, ids[:0]), (4, ids[n // 2:n])], 9, table, lanes, steps)
        block = rans.Block(payload, table)
        assert block.keys == [3, None, 4] and block.before == 9 and block.lengths.tolist() == [n // 2, 0, n - n // 2]
        assert (block.ids() == ids[:n]).all()
        for a, b in ((0, 1), (n // 3, n // 2), (n - 1, n), (n // 2, n // 2)):
            assert (block.ids(a, b) == ids[a:b]).all()
    bits = 8 * len(payload) / len(ids)
    p = counts / counts.sum()
    assert bits < -(p * np.log2(p)).sum() + 0.5


def test_coder_refuses_damage():
    table = rans.Table.from_counts(np.array([1, 2]), np.array([5, 3]))
    payload = bytearray(rans.encode_block([(1, np.array([1, 2] * 500))], 0, table))
    with pytest.raises(ValueError, match="another table"):
        rans.Block(bytes(payload), rans.Table.from_counts(np.array([1, 2]), np.array([1, 1])))
    payload[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.Block(bytes(payload), table)
    with pytest.raises(ValueError, match="format"):
        rans.Block(b"x" * 100, table)


def test_table_scales_any_counts():
    for counts in ([1], [1] * 50_000, [10 ** 12] + [1] * 40_000, [3, 10 ** 9]):
        table = rans.Table.from_counts(np.arange(len(counts)) * 2, np.array(counts))
        assert int(table.freq.sum()) == 1 << rans.TOTAL_BITS and table.freq.min() >= 1


def test_token_files(spark):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choice(["tree", "Sky", "run", "blue\n"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(1000, None), (1, ""), (700, "word " * 5000), (-5, "neg"), (9, "again"), (9, "again")]
    rng.shuffle(rows)
    docs = documents(spark, [(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(5)
    path = scratch_dir(spark, "files")
    rans.write_tokens(docs, path, BYTE, end_id=0)
    got = rans.read_documents(spark, path).orderBy("start").collect()
    ids_of, start = library(BYTE), 0
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    want = sorted((d, len(i) + 1, zlib.crc32(np.array([*i, 0], dtype="<u4").tobytes())) for d, i in ((d, ids_of(t or "")) for d, t in rows))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_special_strings_are_the_librarys(spark):
    """Ids, and the starts of the documents behind them."""
    texts = ["a <|endoftext|> b", "plain", "<|startoftext|> tree <|endoftext|>", "end"]
    docs = documents(spark, list(enumerate(texts)))
    ids_of, path = library(BYTE), scratch_dir(spark, "files")
    rans.write_tokens(docs, path, BYTE, end_id=0)
    got = rans.read_documents(spark, path).orderBy("start").collect()
    ids = [[*ids_of(t), 0] for t in texts]
    assert 50256 in ids[0] and [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(4)]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in ids]
    packed = packing.pack_documents(docs, WORD, end_id=1, capacity=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pack_brute(list(enumerate(texts)), WORD, 1, 64)


def test_token_files_without_rows_or_ids(spark):
    path = scratch_dir(spark, "files")
    rans.write_tokens(documents(spark, []), path, BYTE, end_id=0)
    assert rans.read_documents(spark, path).collect() == []
    path = scratch_dir(spark, "files")
    rans.write_tokens(write_scratch(documents(spark, [(None, "a"), (2, "b"), (None, None)]), "t"), path, BYTE, end_id=0)
    assert [r.doc_id for r in rans.read_documents(spark, path).orderBy("start").collect()] == [None, None, 2]


class Counted:
    """A tokenizer or model whose calls are counted."""

    def __init__(self, real, calls):
        self.real, self.calls = real, calls

    def __getattr__(self, name):
        def call(*args, **options):
            self.calls.append(name)
            return getattr(self.real, name)(*args, **options)
        return call


def test_new_words_share_calls():
    """Words of a batch that were not met before go to the library together, also those with marks, accents and line ends."""
    rng, want = random.Random(6), library(BYTE)
    ends = ["", "", ",", ".", "\nA", "&&&", "'s", "'", "'s.", "\n\nBa", "à", "à,", "\nº", "-", "3", "İ,"]
    texts = [" ".join("".join(rng.choice("thanderoiàü") for _ in range(9)) + rng.choice(ends) for _ in range(60)) for _ in range(50)]
    texts += [t.replace(" ", "  ", 1) for t in texts]
    for kept, at_most in ((10_000, 400), (40, 800)):
        encode, calls = token_ids.TextEncoder(BYTE, kept), []
        encode.tokenizer, encode.model = Counted(encode.tokenizer, calls), Counted(encode.model, calls)
        encode.words.encode, encode.words.merge = encode._library, encode._merge
        for _ in range(2):
            for text, ids in zip(texts, encode(texts), strict=True):
                assert np.frombuffer(ids, encode.dtype).tolist() == want(text), repr(text)
        assert len({w for t in texts for w in t.split()}) > 2500 and len(calls) < at_most
