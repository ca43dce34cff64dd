"""Hand-derived micro-cases of the text, label, path and score rules."""

import re

import pytest
from pyspark.sql import functions as F

from quillmap import constants as K
from quillmap.checks import fixtures as X
from quillmap.functions import text as T
from quillmap.operators import catalog as C
from quillmap.operators import labels as L
from quillmap.operators import search as S
from quillmap.sources import extracts as E
from quillmap.sources import files as R


def one(spark, values, use, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(use(F.col("x"))).collect()]


NOISY = ["", "ab", "2021", "12.5", "-12", "0601023abaaaaaa", "img123", "Vitamin B12 100mg tablet",
         "Image", "nan", None]
CLEAN = ["apple pie", "apple_pie", "Paracetamol tablets 50", "photos"]


def test_label_noise(spark):
    assert one(spark, NOISY, T.is_label_noisy) == [True] * len(NOISY)
    assert one(spark, CLEAN, T.is_label_noisy) == [False] * len(CLEAN)


def test_folder_or_file(spark):
    cases = {
        "food/apple_pie/134.jpg": "apple_pie", "cars/images/Ferrari_Enzo.JPG": "ferrari_enzo",
        "food/apple_pie/best_slice.jpg": "apple_pie", "images/img123.jpg": None,
        "x/ab/a.tar.gz": None,
    }
    assert one(spark, list(cases), L.folder_file_label) == list(cases.values())


def test_match_ratio(spark):
    rows = [("red apple pie", "Applepie red", 1.0), ("", "x", 0.0), ("!!!", "x", 0.0),
            ("a zebra", "a horse", 0.5), (None, "x", 0.0)]
    df = spark.createDataFrame(rows, "q string, t string, want double")
    got = df.select(T.text_match_ratio(F.col("q"), F.col("t"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_trust_score(spark):
    rows = [(0.2, "red pie", "red pie", "a", "b", 78.0), (0.2, "", "x", "a", "a", 82.86),
            (1.7, "", "x", "a", "b", 0.0), (0.2, "!!!", "x", "a", "b", 48.0)]
    df = spark.createDataFrame(
        rows, "d double, ocr string, t string, dom string, f string, want double")
    cols = S.trust_columns(F.col("d"), F.col("ocr"), F.col("t"), F.col("dom"), F.col("f"))
    got = S.trust_score(df.withColumns(cols)).select(F.round("confidence_raw", 2)).collect()
    assert [r[0] for r in got] == [r[5] for r in rows]


def test_clean_text_matches_python(spark, sf):
    def python(text):
        text = re.sub(rf"[^{K.CLEAN_KEEP}\s]", " ", text.lower())
        return re.sub(r"\s+", " ", text).strip()

    rows = X.table(spark, sf, "documents").select("text", T.clean_text(F.col("text"))).collect()
    assert all(r[1] == python(r[0]) for r in rows)


def test_outside_is_the_complement():
    pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}",
                                T.outside(K.CLEAN_KEEP)))
    kept = re.compile(f"[{K.CLEAN_KEEP}]")
    for code in [*range(0x3000), 0x1F600, 0x10FFFF]:
        assert bool(pattern.match(chr(code))) != bool(kept.match(chr(code)))


def test_most_frequent_word(spark):
    texts = ["bb ccc ccc aaa aaa", "été été x_y1", "a b", "", None]
    assert one(spark, texts, T.most_frequent_word) == [
        "auto_ccc", "auto_été", None, None, None]


def test_json_is_strict(spark):
    raw = ['x {"k": 1} y', '{"k": 1} {}', "none", '{"k": ', None]
    assert one(spark, raw, lambda c: T.json_salvage(c, "k int")["k"]) == [1, None, None, None, None]


def test_paths(spark):
    assert one(spark, ["a/b.TAR.gz", ".hid", "c"], T.extension) == [".gz", "", ""]
    assert one(spark, ["raw/x/y/f.txt", "raw/f.txt", "else/f.txt"],
               lambda c: T.archive_of(c, "raw")) == ["raw/x", "_root", "else"]
    assert one(spark, ["d/.x.csv", "d/x.csv"], T.is_hidden) == [True, False]


def test_signature_depth(spark):
    def signature(depth, mtime):
        files = spark.createDataFrame([("r/a/x.txt", 1, "r/a"), ("r/a/b/y.txt", mtime, "r/a")],
                                      "path string, mtime bigint, archive string")
        return C.folder_signatures(files, depth).head()["signature"]

    assert signature("all", 2) != signature("all", 3)
    assert signature("direct", 2) == signature("direct", 3)


def test_text_lists(spark):
    rows = [("two", "a b\nc d\n"), ("three", "aa b\n\nx\nc dd\n"), ("crlf", "a a\r\nbb bb\r\ncc cc"),
            ("prose", "\n".join(["w " * 40] * 3))]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {}
    for r in R.txt_documents(df).orderBy("path", "position").collect():
        got.setdefault(r["path"], []).append(r["content"])
    assert got["two"] == ["a b c d"]
    assert got["three"] == ["aa b", "c dd"]
    assert got["crlf"] == ["a a", "bb bb", "cc cc"]
    assert len(got["prose"]) == 1


def test_json_files(spark):
    rows = [("mixed", '[{"a": 1}, 5, {"a": 2}]'), ("object", '{"a": 3}'), ("broken", '{"a": '),
            ("scalar", "7"), ("trailing", '{"a": 1} x')]
    got = R.json_documents(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted((r["path"], r["position"], r["record"]["a"]) for r in got) == [
        ("mixed", 0, "1"), ("mixed", 2, "2"), ("object", 0, "3")]


def test_extractor_errors_become_rows(spark):
    def extractor(path, content):
        if path == "bad":
            raise ValueError("no pages")
        return [{"page_no": i, "text": t} for i, t in enumerate(content.decode().split("|"))]

    files = spark.createDataFrame([("ok", b"p0|p1"), ("bad", b"")], "path string, content binary")
    pages = E.extract(files, extractor, "path string, page_no int, text string, error string")
    assert pages.where("error IS NOT NULL").select("path").collect()[0][0] == "bad"
    whole = E.assemble_pages(pages.where("error IS NULL")).collect()
    assert [(r["path"], r["content"], r["n_pages"]) for r in whole] == [("ok", "p0\np1", 2)]


@pytest.mark.parametrize("strict,want", [(True, "apple pie"), (False, "x1")])
def test_magic_word(spark, strict, want):
    df = spark.createDataFrame([({"code_name": "X1", "title": "no", "label": "Apple Pie"},)],
                               "r map<string,string>")
    key = L.magic_key(F.col("r"), strict)
    assert df.select(L.record_value(F.col("r"), key)).collect()[0][0] == want
