"""Delimited files as they come: odd headers, quoted line breaks, splits of any size."""

import csv
import io
import os
import random
import time

from pyspark.sql import functions as F

from quillmap.sources import delimited as D
from quillmap.sources import files as R
from quillmap.sources import ranges as G
from quillmap.sources.delimited import Records, header_names
from quillmap.sources.files import read_mixed_delimited


def write(folder, name, text):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def rows(df):
    return {(os.path.basename(r["path"]), r["position"]): r["record"] for r in df.collect()}


def test_header_names():
    assert header_names(["", " a ", "a", "a", "a.1", ""]) == ["_c0", "a", "a.1", "a.2", "a.1.1", "_c5"]


def test_odd_headers_and_quoted_breaks(spark, tmp_path):
    folder = str(tmp_path)
    write(folder, "index.csv", ",name,size\n0,apple,3\n\n1,\"pear, ripe\",4\n")
    write(folder, "twice.csv", "name,name\na,b\n")
    write(folder, "breaks.csv", 'id,text\n1,"one\ntwo\n\nthree"\n2,plain\n3,"say ""hi"""\n')
    write(folder, "header.csv", '"first\npart",b\n1,2\n')
    write(folder, "short.csv", "a,b,c\n1\n1,2,3,4\n")
    write(folder, "only.csv", "a,b\n")
    write(folder, "a + b [%20].csv", "a\n1\n")
    write(folder, "breaks {é}.csv", 'a\n"1\n2"\n')
    write(folder, "empty.csv", "")
    got = rows(read_mixed_delimited(spark, folder))
    assert got == {
        ("index.csv", 0): {"_c0": "0", "name": "apple", "size": "3"},
        ("index.csv", 1): {"_c0": "1", "name": "pear, ripe", "size": "4"},
        ("twice.csv", 0): {"name": "a", "name.1": "b"},
        ("breaks.csv", 0): {"id": "1", "text": "one\ntwo\n\nthree"},
        ("breaks.csv", 1): {"id": "2", "text": "plain"},
        ("breaks.csv", 2): {"id": "3", "text": 'say "hi"'},
        ("header.csv", 0): {"first\npart": "1", "b": "2"},
        ("a + b [%20].csv", 0): {"a": "1"},
        ("breaks {é}.csv", 0): {"a": "1\n2"},
        ("short.csv", 0): {"a": "1", "b": None, "c": None},
        ("short.csv", 1): {"a": "1", "b": "2", "c": "3", "_c3": "4"},
    }


def whole_file(text, sep=","):
    """Records of a file read as one stream."""
    out, names, reader = [], None, Records(sep, False)
    for line in text.split("\n")[:-1] + ([text.split("\n")[-1]] if text.split("\n")[-1] else []):
        for piece, ending in D._pieces([line]):
            if (done := reader.feed(piece, ending)) is not None:
                out.append(D.cells_of(done[1], sep))
    if (done := reader.rest()) is not None:
        out.append(D.cells_of(done[1], sep))
    if not out:
        return []
    names = header_names(out[0])
    found = []
    for cells in out[1:]:
        wide = header_names([*names, *[""] * max(0, len(cells) - len(names))])
        found.append(dict(zip(wide, cells + [None] * (len(names) - len(cells)))))
    return found


def test_records_do_not_depend_on_ranges(spark, tmp_path):
    """Quoted breaks, stray quotes, blank lines, open ends and all line ends, cut everywhere."""
    rng = random.Random(4)
    cell = lambda: rng.choice(["a", "", '""', '"x\ny"', '"p,q"', '"say ""hi"""', '5" pipe', '"open', "é", '"\n\n"', '"a"b', " ", '"z\r\nw"', '"""', "1"])
    texts = {}
    for i in range(12):
        end = rng.choice(["\n", "\n", "\r\n", "\r"])
        lines = [",".join(cell() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
        texts[f"f{i:02}.csv"] = end.join(["a,b,c", *lines]) + rng.choice(["", end])
    for name, text in texts.items():
        write(str(tmp_path), name, text)
    files = R.list_files(spark, str(tmp_path))
    want = {(n, at): r for n, text in texts.items() for at, r in enumerate(whole_file(text))}
    for size in (5, 16, 1000):
        docs, errors = R.delimited_documents(files, "csv", size)
        assert rows(docs) == want, size
        assert errors.collect() == []


def test_states_agree_with_the_csv_module():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice('ab,""\n') for _ in range(rng.randint(0, 14)))
        lines, state, n = text.split("\n"), False, 0
        for line in lines:
            n += not state and line != ""
            state = D.is_open(line, ",", state)
        found = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        assert len(found) == n, repr(text)


def test_an_open_quote_costs_linear_time(spark, tmp_path):
    write(str(tmp_path), "open.csv", 'a,b\n"never closed,1\n' + "x,2\n" * 200_000)
    write(str(tmp_path), "inch.csv", "a,b\n" + '5" pipe,1\n' * 200_000)
    start = time.time()
    docs, errors = R.delimited_documents(R.list_files(spark, str(tmp_path)), "csv", 1_000_000)
    counts = {os.path.basename(r["path"]): r["count"] for r in docs.groupBy("path").count().collect()}
    assert counts == {"open.csv": 1, "inch.csv": 200_000} and errors.count() == 0
    assert time.time() - start < 60


def test_long_records_are_errors_of_their_file(spark, tmp_path):
    """Ranges, lines, records and headers beyond the limit; the other records stay."""
    write(str(tmp_path), "line.csv", "a,b\n1,2\n" + "x" * 100 + "\n3,4\n")
    write(str(tmp_path), "record.csv", 'a,b\n1,2\n"' + "y\n" * 60 + '",5\n3,4\n')
    write(str(tmp_path), "header.csv", '"' + "h\n" * 60 + '",b\n1,2\n')
    write(str(tmp_path), "fine.csv", "a,b\n1,2\n")
    old = G.MAX_RECORD, G.BLOCK_BYTES
    try:
        G.MAX_RECORD, G.BLOCK_BYTES = 40, 16
        assert D.read_header(str(tmp_path / "header.csv"), ",") is None
        assert [x for part in G.lines_of(str(tmp_path / "line.csv"), 0, 10**6) for x in part] == ["a,b", "1,2", None, "3,4"]
        found = []
        for start in range(0, 120, 10):
            found += [x for part in G.lines_of(str(tmp_path / "line.csv"), start, start + 10) for x in part]
        assert found == ["a,b", "1,2", None, "3,4"]
        reader = D.Records(",", False)
        out = []
        for part in G.lines_of(str(tmp_path / "record.csv"), 0, 10**6):
            for piece, ending in D._pieces(part):
                if (done := reader.feed(piece, ending)) is not None:
                    out.append(done)
        assert out == [(0, "a,b", True), (1, "1,2", True), (2, None, True), (3, "3,4", True)]
    finally:
        G.MAX_RECORD, G.BLOCK_BYTES = old


def test_files_that_go_away_are_errors(spark, tmp_path):
    write(str(tmp_path), "here.csv", "a\n1\n")
    files = spark.createDataFrame([(str(tmp_path / "here.csv"), 4), (str(tmp_path / "gone.csv"), 9)], "path string, length bigint")
    docs, errors = R.delimited_documents(files)
    assert rows(docs) == {("here.csv", 0): {"a": "1"}}
    assert [os.path.basename(r["path"]) for r in errors.collect()] == ["gone.csv"]
    found = {os.path.basename(r["path"]): (r["content"], r["error"] is None) for r in G.contents(files).collect()}
    assert found == {"here.csv": (bytearray(b"a\n1\n"), True), "gone.csv": (None, False)}


def test_listing(spark, tmp_path):
    for name in ("a/b/c/deep.txt", "a/x.csv", "top.txt", "_temporary/t.csv", "a/.hidden", "k=v/p.csv", "_d=1/q.csv", "a + b [%20]/{é}.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {(os.path.relpath(r["path"], tmp_path), r["length"]) for r in R.list_files(spark, str(tmp_path)).collect()}
    assert got == {(n, len(n.encode())) for n in ("a/b/c/deep.txt", "a/x.csv", "top.txt", "k=v/p.csv", "_d=1/q.csv", "a + b [%20]/{é}.csv")}
    again = {(os.path.relpath(r["path"], tmp_path), r["length"]) for r in R.list_files(spark, [f"{tmp_path}/a", str(tmp_path / "top.txt")]).collect()}
    assert again == {x for x in got if x[0].startswith("a/") or x[0] == "top.txt"}
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", F.unix_micros("modificationTime").alias("m"))
    want = {(os.path.basename(r["path"]), r["m"]) for r in by_spark.collect() if "%" not in r["path"]}
    assert want <= {(os.path.basename(r["path"]), r["mtime"]) for r in R.list_files(spark, str(tmp_path)).collect()}


def test_text_lines(spark, tmp_path):
    text = "\n".join(f"line {i} é" for i in range(500)) + "\r\nlast"
    (tmp_path / "t.txt").write_bytes(text.encode())
    old = G.RANGE_BYTES
    try:
        G.RANGE_BYTES = 100
        got = G.text_lines_of(R.list_files(spark, str(tmp_path))).orderBy("pos").collect()
    finally:
        G.RANGE_BYTES = old
    assert [r["line"] for r in got] == text.replace("\r", "").split("\n")


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    write(str(tmp_path), "big.csv", "id,text\n" + "".join(f"{i},{'x' * (i % 90)}\n" for i in range(20_000)))
    write(str(tmp_path), "small.csv", "id,text\n0,a\n")
    files = R.list_files(spark, str(tmp_path))
    found = [rows(R.delimited_documents(files, "csv", size)[0]) for size in (64_000, 200_000, 100_000_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 20_001
    assert all(r["id"] == str(at) for (name, at), r in found[0].items() if name == "big.csv")


def test_odd_headers_are_written_by_many_tasks(spark, sf, tmp_path, monkeypatch):
    from check_oracles import compare, database
    from quillmap.checks import queries as Q

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        monkeypatch.setattr(Q, "scratch_dir", lambda spark, name: str(tmp_path / name))
        ok, note = compare(spark, database(sf), sf, "csv_odd_headers")
    finally:
        spark.conf.unset(key)
    assert ok, note
    folders = sorted((tmp_path / "odd-csv").glob("g=*"))
    files = {f: sorted(f.glob("part-*")) for f in folders}
    assert len(folders) == 7 and all(len(x) > 1 for x in files.values())
    heads = {p.read_text().splitlines()[0] for x in files.values() for p in x}
    assert [[c.strip() for c in h.split(",")] for h in heads] == [["", "name", "name"]]
