"""JSON arrays cut into their elements over byte ranges, against the parsed file."""

import json
import os
import random

from quillmap.sources import files as R
from quillmap.sources import json_ranges as J
from quillmap.sources import ranges as G


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    text = lambda: "".join(rng.choice('ab"\\\\[]{},: é\n') for _ in range(rng.randint(0, 9)))
    if kind < 2:
        return text()
    if kind < 5:
        return [rng.randint(0, 99), None, True][kind - 2]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {text(): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def chained(path, size, cut):
    """Elements through all three steps, without Spark."""
    inside, depth, index, found = False, 0, 0, {}
    for start in range(0, size, cut):
        stop = min(size, start + cut)
        for at, data, _ in J.elements(path, start, stop, inside, depth, index):
            found[at] = found.get(at, b"") + data
        fact = J.range_facts(path, start, stop)[int(inside)]
        index += fact["commas"].get(1 - depth, 0)
        depth, inside = depth + fact["depth"], fact["inside"]
    assert depth == 0 and not inside
    return [found[i].decode() for i in sorted(found)]


def test_elements_do_not_depend_on_ranges(tmp_path, monkeypatch):
    rng = random.Random(3)
    path = str(tmp_path / "x.json")
    for n in range(60):
        items = [value(rng) for _ in range(rng.randint(1, 8))]
        text = json.dumps(items, ensure_ascii=bool(n % 2), indent=rng.choice([None, 1]))
        data = (" \n" * (n % 3) + text + "\n" * (n % 2)).encode()
        with open(path, "wb") as f:
            f.write(data)
        for cut in (1, 2, 5, 17, 10_000):
            monkeypatch.setattr(G, "BLOCK_BYTES", rng.choice([1, 3, 1 << 20]))
            assert [json.loads(x) for x in chained(path, len(data), cut)] == items, (text, cut)


def test_large_files_give_the_documents_of_small_ones(spark, tmp_path):
    rng = random.Random(4)
    items = [{"k": value(rng), "n": str(i)} if i % 3 else value(rng) for i in range(60)]
    files = {
        "array.json": json.dumps(items), "indented.json": json.dumps(items[:20], indent=2), "empty.json": " [ ] ", "lone.json": json.dumps([{"a": 1}]),
        "open.json": json.dumps(items)[:-1], "after.json": json.dumps(items) + " 1", "two.json": "[1][2]", "comma.json": "[1,]", "word.json": "[1, oops]",
        "string.json": '["a]', "blank.json": "   ",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    listed = R.list_files(spark, str(tmp_path))
    small, bad = R.json_files(listed)
    large, worse = R.json_files(listed, whole_bytes=0, range_bytes=600)
    rows = lambda df: sorted((os.path.basename(r["path"]), r["position"], r["content"]) for r in df.collect())
    assert rows(large) == rows(small) and len(rows(small)) > 40
    names = lambda df: sorted((os.path.basename(r["path"]), r["message"]) for r in df.collect())
    assert names(worse) == names(bad) and len(names(bad)) == 7


def test_a_large_object_and_a_long_element_are_errors(spark, tmp_path):
    (tmp_path / "object.json").write_text(json.dumps({"a": "x" * 100}))
    docs, errors = R.json_files(R.list_files(spark, str(tmp_path)), whole_bytes=50, range_bytes=40)
    assert docs.count() == 0 and [r["message"] for r in errors.collect()] == [J.INVALID]
    old = J.MAX_ELEMENT
    try:
        J.MAX_ELEMENT = 40
        path = str(tmp_path / "long.json")
        data = json.dumps(["a", "x" * 60, "b"]).encode()
        with open(path, "wb") as f:
            f.write(data)
        assert [x[1] for x in J.elements(path, 0, len(data), False, 0, 0)] == [b'"a"', None, b' "b"']
    finally:
        J.MAX_ELEMENT = old
