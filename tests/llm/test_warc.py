import gzip
import hashlib
import pathlib
import random
import zlib

import pytest

from quillmap.llm import warc as W
from quillmap.session import scratch_dir

SCHEMA = "page_id bigint, url string, html string, payload_bytes int, record_type string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute(rows, least):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in data:
        ids = [j for j, c in data if c == b and j is not None]
        last = max(ids) if ids and len(b) >= least else None
        again = last is not None and i != last
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


BIG, OTHER = "a<b>\r\n" * 300, "é\n " * 400
ODD = [
    (1, "http://a/ b\r\nX: y\x7f", BIG), (2, None, BIG), (3, "u", BIG), (3, "u", BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""),
    (None, "u", BIG), (8, "http://é/?q=%41", OTHER), (9, "u", OTHER), (None, None, "no id " * 300), (None, "z", "no id " * 300), (10, "u", "\r\n\r\n"), (11, "u", "x\r\n"),
    (12, "u", "x\r\n\r\n\r"), (13, "u", "\r\n" * 600), (14, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"), (15, "u", "y" * 300_000), (-4, "u", "x" * 1000), (16, "v", "x" * 1000),
    (17, "v", "x" * 999), (18, "v", "x" * 999), (19, "v", "\x00\x01 \x1f\x0b"), (20, "u", "a\r"), (21, "u", "\n"),
]


@pytest.mark.parametrize("bounded", [True, False])
def test_awkward_pages(spark, monkeypatch, bounded):
    if not bounded:
        monkeypatch.setattr(W, "collect_bounded", lambda df: None)
    pages = table(spark, ODD).repartition(3)
    path = scratch_dir(spark, "warc")
    got = W.archive_pages(pages, path, least=1000)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ODD, 1000)


def files(path):
    return [f for f in pathlib.Path(path.removeprefix("file:")).iterdir() if f.name.startswith("part-")]


def test_archives_members_and_sidecar(spark):
    path = scratch_dir(spark, "warc")
    W.archive_pages(table(spark, ODD).repartition(3), path)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files(f"{path}/raw"))
    normal = [f.read_bytes() for f in files(f"{path}/members")]
    assert sorted(b"".join(gzip.decompress(x) for x in normal)) == sorted(raw)
    for f in files(f"{path}/raw"):  # one member a file
        one = zlib.decompressobj(31)
        one.decompress(f.read_bytes())
        assert one.eof and not one.unused_data
    index = spark.read.parquet(f"{path}/index")
    rows = index.collect()
    assert len(rows) == len(ODD)
    whole = {f.name: f.read_bytes() for f in files(f"{path}/members")}
    for r in rows:
        record = gzip.decompress(whole[r.file.rsplit("/", 1)[1]][r.offset:r.offset + r.length])
        fields, http, payload = W.parse(record)
        assert fields["warc-record-id"] == r.record_id and (r.record_type == "revisit" or len(payload) == r.payload_bytes == int(http["content-length"]))
    named = {r.record_id for r in rows if r.record_type == "response"}
    fetched = W.read_members(index.where("record_type = 'revisit'")).collect()
    assert fetched and all(W.parse(r.record)[0]["warc-refers-to"] in named for r in fetched)


def test_sidecar_does_not_depend_on_splits(spark):
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 4000)))) for i in range(300)]
    path = scratch_dir(spark, "warc")
    W.archive_pages(table(spark, rows).coalesce(1), path)
    had = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1000", "4097", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            again = W.index_archives(spark, f"{path}/members")
            assert sorted(map(tuple, again.collect())) == sorted(map(tuple, spark.read.parquet(f"{path}/index").select(again.columns).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had[0])
        spark.conf.set("spark.sql.files.openCostInBytes", had[1])


def test_empty_table(spark):
    assert W.archive_pages(table(spark, []), scratch_dir(spark, "warc")).collect() == []


def test_streams_of_others(spark, tmp_path):
    """Archives that this module has not written: records of other types, blank lines between them, several members."""
    record = lambda kind, block: b"WARC/1.0\r\nWARC-Type: %s\r\ncontent-length:%d\r\n\r\n%s\r\n\r\n" % (kind, len(block), block)
    parts = [record(b"warcinfo", b"software: x\r\n"), record(b"metadata", b""), record(b"resource", b"\xff\xfe\r\n\r\nbinary\r\n\r\n")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.warc.gz").write_bytes(gzip.compress(parts[0] + b"\r\n" + parts[1]) + gzip.compress(parts[2]))
    W.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "members"))
    data = b"".join(f.read_bytes() for f in files(str(tmp_path / "members")))
    assert gzip.decompress(data) == b"".join(parts)
    assert [W.inflate(x) for x in data.split(W.SEPARATOR)[:-1]] == parts


def test_damage_is_found(spark, tmp_path):
    stream = W.RecordStream("f")
    with pytest.raises(ValueError, match="should begin"):
        stream.feed(b"no record")
    stream = W.RecordStream("f")
    stream.feed(b"WARC/1.1\r\nContent-Length: 3")
    with pytest.raises(ValueError, match="longer"):
        stream.feed(b"abcdefgh")
    stream = W.RecordStream("f")
    stream.feed(b"WARC/1.1\r\nContent-Length: 3")
    with pytest.raises(ValueError, match="within"):
        stream.close()
    data = bytearray(W.member(b"x" * 1000))
    data[-5] ^= 1
    with pytest.raises(zlib.error):
        W.inflate(bytes(data))
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="damaged"):
        W.facts(bad)
