"""Folders to catalog: formats, links, incremental runs, streams."""

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from quillmap.checks.doubles import DigestImageEmbedder, RuleModel
from quillmap.operators import catalog as C
from quillmap.operators import models as M
from quillmap.plans import ingest as P
from quillmap.session import scratch_dir, spread_nulls
from quillmap.streaming import watch as W


def put(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


FILES = {
    "shop/items.csv": "product_name, picture\nRed Apple,A1.jpg\nGreen Pear,none\n",
    "shop/other.csv": "id,code\n1,\"x, y\"\n",
    "shop/pics/a1.jpg": b"\x01\x02",
    "shop/pics/b2.PNG": b"\x03",
    "notes/labels.txt": "scan7.txt = Blue Cheese\nold town\nmill house\n",
    "notes/raw/scan7.txt": "one two three",
    "notes/raw/scan8.txt": "we met in the Old Town yesterday",
    "data/list.json": '[{"title": "First Thing"}, 4, {"title": "Second Thing"}]',
    "data/bad.json": '{"title": ',
    "data/t.tsv": "name\tsize\nBig Box\t4\n",
    "data/.hidden.csv": "name\nsecret\n",
    "data/skip.bmp": b"zz",
}


@pytest.fixture()
def paths(spark, tmp_path):
    root = str(tmp_path / "set")
    put(root, FILES)
    return root, scratch_dir(spark, "cat"), scratch_dir(spark, "con")


SETTINGS = P.IngestSettings(image_embedder=DigestImageEmbedder)


def listing(spark, cat):
    return {(os.path.basename(r["source"]), r["label"], os.path.basename(r["image_linked"]))
            for r in C.read_catalog(spark, cat).collect()}


def test_all_formats_and_links(spark, paths):
    root, cat, con = paths
    P.ingest(spark, root, cat, con, "r", SETTINGS, batch="1")
    got = listing(spark, cat)
    assert ("items.csv", "red apple", "a1.jpg") in got
    assert ("items.csv", "green pear", "") in got
    assert ("other.csv", "unknown", "") in got
    assert ("scan7.txt", "blue cheese", "") in got
    assert ("scan8.txt", "old town", "") in got
    assert {("list.json", "first thing", ""), ("list.json", "second thing", ""),
            ("t.tsv", "big box", "")} <= got
    names = {g[0] for g in got}
    assert "a1.jpg" not in names and "b2.PNG" in names       # the linked image is no document
    assert not names & {"bad.json", ".hidden.csv", "skip.bmp"}
    rows = C.read_catalog(spark, cat).where("image_linked LIKE '%a1.jpg'").collect()
    assert len(rows) == 1 and rows[0]["visual"] is not None
    assert '"x, y"' in C.read_catalog(spark, cat).where(
        "source LIKE '%other.csv'").head()["content"]


def test_incremental_equals_reset(spark, paths, tmp_path):
    root, cat, con = paths
    P.ingest(spark, root, cat, con, "r", SETTINGS, batch="1")
    n = C.read_catalog(spark, cat).count()
    assert P.ingest(spark, root, cat, con, "c", SETTINGS, batch="2").n_archives == 0
    assert C.read_catalog(spark, cat).count() == n
    put(root, {"notes/raw/scan9.txt": "a mill house by the sea"})
    result = P.ingest(spark, root, cat, con, "c", SETTINGS, batch="3")
    assert result.n_archives == 1 and result.rows.count() == 1
    assert result.rows.head()["label"] == "mill house"
    put(root, {"shop/late.csv": "product_name,picture\nOld Apple,A1.jpg\n"})
    late = P.ingest(spark, root, cat, con, "c", SETTINGS, batch="4").rows.collect()
    assert [r["label"] for r in late] == ["old apple"]
    assert late[0]["image_linked"].endswith("a1.jpg") and late[0]["visual"] is not None
    assert C.read_contracts(spark, con).count() == 3
    whole = scratch_dir(spark, "cat")
    P.ingest(spark, root, whole, scratch_dir(spark, "con"), "r", SETTINGS, batch="1")
    key = ["source", "doc_hash"]
    assert (C.read_catalog(spark, cat).select(*key).exceptAll(
        C.read_catalog(spark, whole).select(*key)).count() == 0)
    assert C.read_catalog(spark, cat).count() == C.read_catalog(spark, whole).count()


def test_model_arbitrates(spark, paths):
    root, cat, con = paths
    P.ingest(spark, root, cat, con, "r", P.IngestSettings(model=RuleModel), batch="1")
    methods = {r[0] for r in C.read_catalog(spark, cat).select(
        F.get_json_object("extra", "$.detection_method")).collect()}
    assert "model_arbitration" in methods


def test_model_failures_are_kept(spark):
    def make():
        def model(prompt):
            if "bad" in prompt:
                raise RuntimeError("down")
            return 'ok {"refined_label": "new name", "is_document": true}'
        return model

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "doc_id int, p string")
    got = {r["doc_id"]: r for r in M.call_model(df, F.col("p"), make, M.REFINEMENT).collect()}
    assert got[1]["reply"]["refined_label"] == "new name" and got[1]["reply_error"] is None
    assert got[2]["reply"] is None and "down" in got[2]["reply_error"]
    assert got[3]["reply"] is None and got[3]["reply_error"] is None


def test_stream_equals_batch(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "in"), scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    put(root, {"a/x.txt": "one", "a/y.txt": "two", "a/.z.txt": "hidden", "a/w.bmp": b"0"})

    def run():
        W.append_new(W.watch_files(spark, root, 1), out, ckpt).awaitTermination()
        return spark.read.parquet(out).count()

    assert W.ingest_mode(spark, out) == "r"
    assert run() == 2 and run() == 2
    put(root, {"b/v.txt": "three"})
    assert run() == 3 and W.ingest_mode(spark, out) == "c"


def test_folder_stream_equals_batch_runs(spark, tmp_path):
    """Files that arrive in three goes, one of them replayed: catalog and contracts are those of one ingest."""
    root, cat, con, ck = str(tmp_path / "s"), scratch_dir(spark, "cat"), scratch_dir(spark, "con"), scratch_dir(spark, "ck")
    goes = [{"a/x.csv": "product_name\nRed Apple\n", "a/.z.txt": "hidden"}, {"b/y.txt": "we met in the old town"}, {"a/z.json": '[{"title": "Big Box"}]'}]
    for files in goes:
        put(root, files)
        W.watch_folder(spark, root, cat, con, ck).awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    columns = ["source", "position", "doc_hash", "domain", "label", "content"]
    whole, contracts = scratch_dir(spark, "cat"), scratch_dir(spark, "con")
    P.ingest(spark, root, whole, contracts, "r", batch="1")
    want = rows(C.read_catalog(spark, whole).select(*columns))
    assert rows(C.read_catalog(spark, cat).select(*columns)) == want and len(want) == 3
    pick = ["folder_path", "signature", "assigned_domain"]
    assert rows(C.read_contracts(spark, con).select(*pick)) == rows(C.read_contracts(spark, contracts).select(*pick))
    assert {r["batch"] for r in C.read_catalog(spark, cat).collect()} == {"stream-0", "stream-1", "stream-2"}
    P.ingest(spark, root, cat, con, "c", batch="stream-2")    # the last batch once more
    assert rows(C.read_catalog(spark, cat).select(*columns)) == want


def test_moved_files_get_their_new_source(spark, tmp_path):
    """Only partitions that hold a moved file are written again; a copy moves nothing."""
    root, cat, con = str(tmp_path / "s"), scratch_dir(spark, "cat"), scratch_dir(spark, "con")
    put(root, {"a/one.txt": "first words here", "b/two.txt": "other words there", "c/three.txt": "a third text"})
    P.ingest(spark, root, cat, con, "r", batch="1")
    C.append_catalog(C.read_catalog(spark, cat).where("source LIKE '%two.txt'").drop("batch"), cat, "0")
    part = lambda: {os.path.join(d, f) for d, _, fs in os.walk(cat.removeprefix("file:")) for f in fs if f.startswith("part-")}
    before = part()
    os.makedirs(os.path.join(root, "d"))
    os.rename(os.path.join(root, "a/one.txt"), os.path.join(root, "d/moved.txt"))
    shutil.copy2(os.path.join(root, "c/three.txt"), os.path.join(root, "d/copy.txt"))
    result = P.ingest(spark, root, cat, con, "c", batch="2")
    assert {(r["status"], r["n"]) for r in result.counters.collect()} == {("moved", 2)}
    sources = {os.path.relpath(r["source"], root) for r in C.read_catalog(spark, cat).collect()}
    assert sources == {"d/moved.txt", "b/two.txt", "c/three.txt"} and result.rows.count() == 0
    kept = before & part()
    assert any("batch=0" in f for f in kept) and not any("batch=0" in f for f in part() - before)


def test_the_first_arbitrated_document_decides_for_its_archive(spark, tmp_path):
    root, cat, con = str(tmp_path / "s"), scratch_dir(spark, "cat"), scratch_dir(spark, "con")
    put(root, {f"a/{i}.txt": f"text number {i}" for i in range(4)})
    settings = P.IngestSettings(model=RuleModel, session_rule=True)
    P.ingest(spark, root, cat, con, "r", settings, batch="1")
    rows = C.read_catalog(spark, cat).orderBy("source").select(
        "domain", F.get_json_object("extra", "$.detection_method").alias("m")).collect()
    methods = [r["m"] for r in rows]
    first = methods.index("model_arbitration")
    assert methods.count("model_arbitration") == 1 and set(methods[first + 1:]) == {"session_cache"}
    assert len({r["domain"] for r in rows[first:]}) == 1


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 5, F.col("id").cast("string")).alias("k"))
    spread = spread_nulls(rows, "k", "j")
    assert spread.select("j").distinct().count() == 1000
    other = spark.createDataFrame([("3", "x")], "j string, v string")
    assert [tuple(r) for r in spread.join(other, "j", "left").where("v IS NOT NULL").select("k", "v").collect()] == [("3", "x")]


def test_a_batch_reads_only_the_hashes_it_may_hold(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def go(hashes):
        spark.createDataFrame([(h,) for h in hashes], "file_hash string").coalesce(1).write.mode("append").parquet(src)
        W.append_new(spark.readStream.schema("file_hash string").parquet(src), out, ck).awaitTermination()
        return sorted(r["file_hash"] for r in spark.read.parquet(out).collect())

    assert go(["a", "b", "a"]) == ["a", "b"]
    assert go(["b", "c"]) == ["a", "b", "c"]
    fresh = spark.createDataFrame([("a",)], "file_hash string")
    known = W.known_hashes(fresh, out, "1")
    assert [r[0] for r in known.collect()] == ["a"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix#\d+ = ", plan), plan
    assert W.known_hashes(fresh, out, "0").count() == 0        # a batch does not know itself
    shutil.rmtree(out + ".hashes")                             # a table from before there was a store
    assert go(["c", "d"]) == ["a", "b", "c", "d"]


def test_debounce(spark):
    at = [0, 10, 21, 25, 100]
    df = spark.createDataFrame([("u", t) for t in at] + [("v", 3)], "k string, s int").select(
        "k", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r["k"], r["start_us"] // 10**6, r["end_us"] // 10**6, r["n"])
                 for r in W.debounce_sessions(df, "k", "ts", 10).collect())
    assert got == [("u", 0, 10, 2), ("u", 21, 25, 2), ("u", 100, 100, 1), ("v", 3, 3, 1)]


def test_debounce_stream(spark, tmp_path):
    path = str(tmp_path / "ev")
    events = spark.createDataFrame([("u", t) for t in (0, 10, 21, 25, 5000)], "k string, s int")
    events.select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(path)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(path)
    q = W.debounce_stream(stream, "k", "ts", 10).writeStream.format("memory").queryName(
        "debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["start_us"] // 10**6, r["n"]) for r in spark.table("debounced").collect())
    assert got == [(0, 2), (21, 2)]


def test_only_new_files_are_opened(spark, paths, tmp_path):
    """Two images are known: the second run reads and decodes the third only."""
    root, cat, con = paths
    calls = str(tmp_path / "calls")
    os.makedirs(calls)

    def ocr(path, content):
        with open(os.path.join(calls, os.path.basename(path) + f".{os.urandom(4).hex()}"), "w"):
            return [{"line_no": 0, "text": f"read {len(content)} bytes", "confidence": 0.9}]

    settings = P.IngestSettings(image_embedder=DigestImageEmbedder, ocr=ocr)
    P.ingest(spark, root, cat, con, "r", settings, batch="1")
    assert len(os.listdir(calls)) == 2
    put(root, {"shop/pics/c3.jpg": b"\x04\x05"})
    result = P.ingest(spark, root, cat, con, "c", settings, batch="2")
    seen = [x.rsplit(".", 1)[0] for x in os.listdir(calls)]
    assert sorted(seen) == ["a1.jpg", "b2.PNG", "c3.jpg"] and result.rows.count() == 1
    assert {(r["status"], r["n"]) for r in result.counters.collect()} == {("exists", 3), ("linked", 1), ("new", 1)}


def test_errors_are_reported(spark, paths):
    root, cat, con = paths

    def pdf(path, content):
        raise ValueError("no pages")

    put(root, {"notes/x.pdf": b"%PDF"})
    result = P.ingest(spark, root, cat, con, "r", P.IngestSettings(pdf=pdf), batch="1")
    got = {(os.path.basename(r["path"]), r["stage"], r["message"]) for r in result.errors.collect()}
    assert got == {("bad.json", "json", "not valid JSON"), ("skip.bmp", "route", "no reader for this extension"),
                   ("x.pdf", "pdf", "ValueError: no pages")}


def test_files_in_the_root_and_files_beyond_the_binary_limit(spark, tmp_path):
    root, cat, con = str(tmp_path / "s"), scratch_dir(spark, "cat"), scratch_dir(spark, "con")
    big = "id,name\n" + "".join(f"{i},thing {i}\n" for i in range(120_000))
    put(root, {"loose [1].txt": "a loose file with words", "sub/big.csv": big, "sub/metadata.csv": "big.csv=huge\n"})
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1_500_000)
    try:
        assert os.path.getsize(os.path.join(root, "sub/big.csv")) > 1_500_000
        result = P.ingest(spark, root, cat, con, "r", batch="1")
        by_name = {os.path.basename(r["source"]): r["n"] for r in result.rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert by_name["big.csv"] == 120_000 and by_name["loose [1].txt"] == 1


def test_a_failed_reset_keeps_the_old_catalog(spark, paths):
    root, cat, con = paths
    P.ingest(spark, root, cat, con, "r", SETTINGS, batch="1")
    rows = C.read_catalog(spark, cat)
    n = rows.count()
    bad = rows.drop("batch").withColumn("label", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        C.reset_catalog(bad, cat, "2")
    assert C.read_catalog(spark, cat).count() == n
    empty = root + "-empty"
    os.makedirs(empty)
    P.ingest(spark, empty, cat, con, "r", batch="3")
    assert C.read_catalog(spark, cat).count() == 0


def test_columns_are_remembered_by_folder(spark, tmp_path):
    """A noisy value is no label by itself, but it is one in the column its folder is known for."""
    root, cat, con = str(tmp_path / "s"), scratch_dir(spark, "cat"), scratch_dir(spark, "con")
    put(root, {"shop/a.csv": "product_name,n\nimg_1,1\nRed Apple,2\nimg_2,3\n"})

    def labels(result):
        return {(os.path.basename(r["source"]), r["position"]): r["label"] for r in result.rows.collect()}

    first = labels(P.ingest(spark, root, cat, con, "r", batch="1"))
    assert first == {("a.csv", 0): "unknown", ("a.csv", 1): "red apple", ("a.csv", 2): "img_2"}
    put(root, {"shop/b.csv": "product_name,n\nimg_3,1\n", "other/c.csv": "product_name,n\nimg_4,1\n"})
    later = labels(P.ingest(spark, root, cat, con, "c", batch="2"))
    assert later == {("b.csv", 0): "img_3", ("c.csv", 0): "unknown"}
    again = labels(P.ingest(spark, root, cat, con, "r", batch="3"))
    assert again[("a.csv", 0)] == "unknown" and again[("b.csv", 0)] == "img_3"
