import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from quillmap.llm import sentence_pieces as S
from tests.llm.helpers import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a  b", "\n\n x", "a\r\nb;\r\n", "日本語テキ \U0001f600", "x" * 300, " " * 40 + "the", " " * 17, "aaaaaaaaaaaaa aaaa",
    "for (int i = 0; i < 10; i++) {\r\n    return();\r\n}", "ΑΒΓ", "www.example.com/path?q=1", "1234567890" * 5, "\x00\x01 �",
]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("abcdeinorst ,.") for _ in range(80)) for _ in range(400)] + ["".join(rng.choice("aei ()\r;{}=<>/0123éß") for _ in range(60)) for _ in range(400)]


def test_byte_pair_ids_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    with open(PATH, "rb") as f:
        proto = f.read()
    for kept in (500_000, 50):
        model = S.PieceModel(proto, kept)
        for some in (texts(), texts()[5:]):
            for text, ids in zip(some, model.encode(some), strict=True):
                assert np.frombuffer(ids, model.dtype).tolist() == library.encode(text), repr(text)
                assert model.decode(ids) == library.decode(library.encode(text)) == text


def as_unigram(proto):
    """The same pieces and scores with the model type 'unigram'."""
    at = proto.index(b"\x18\x02", len(proto) - 2000)
    return proto[:at] + b"\x18\x01" + proto[at + 2:]


def test_unigram_words_have_the_best_score():
    with open(PATH, "rb") as f:
        proto = as_unigram(f.read())
    model = S.PieceModel(proto)
    assert model.kind == S.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    words = sorted({w for t in texts() for w in t.split() if w.isalnum() and w.isascii()})
    score = lambda ids: sum(library.get_score(i) for i in ids)

    def best(word):
        if not word:
            return 0.0
        return max(model.scores[word[:n]] + rest for n in range(1, len(word) + 1) if word[:n] in model.scores for rest in [best(word[n:])])

    for word, ids in zip(words, model.encode(words), strict=True):
        got = score(np.frombuffer(ids, model.dtype).tolist())
        assert got >= score(library.encode(word)), word
        if len(word) <= 12:
            assert got == best("▁" + word), word


def test_encode_and_decode(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts()[:60])] + [(None, "no id", 1), (70, None, 1), (3, "again", 1), (3, "again", 1), (71, "long word " * 30_000, 1)]
    docs = documents(spark, rows, "doc_id bigint, text string, n_pieces int")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes()), zlib.crc32((t or "").encode()), True) for d, t, i in ((d, t, library.encode(t or "")) for d, t, _ in rows)), key=repr)
    assert sorted((tuple(r) for r in S.encode_and_decode(docs, PATH).collect()), key=repr) == want
    back = S.decode_documents(S.encode_documents(docs, PATH), PATH)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t, _ in rows), key=repr)
    empty = documents(spark, [])
    assert S.encode_and_decode(empty, PATH).collect() == [] and S.decode_documents(S.encode_documents(empty, PATH), PATH).collect() == []
