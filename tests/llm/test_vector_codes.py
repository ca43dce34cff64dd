import hashlib
import math
import random

import numpy as np
import pytest

from quillmap.llm import vector_codes as C
from quillmap.llm import vectors as V

INF, NAN = float("inf"), float("nan")


def brute(rows, scale=1024, parts=4, entries=256, rounds=4):
    """(id, code, error, label) of each row that takes part, and the digest of the codebooks."""
    good = [(i, v, s) for i, v, s in rows if v is not None and all(x is not None and math.isfinite(x * scale) for x in v)]
    if not good:
        return [], hashlib.sha256(b"").hexdigest()
    sizes = [len(v) for _, v, _ in good]
    length = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    good = [(i, [math.floor(x * scale) for x in v], s, v) for i, v, s in good if len(v) == length]
    where = C.cuts(length, parts)
    first = {}
    for i, v, _, x in good:
        if i is not None and (i not in first or x < first[i][1]):
            first[i] = (v, x)
    books = [[tuple(first[i][0][s]) for i in sorted(first)[:entries]] for s in where]

    def nearest(p, point):
        return min((sum((a - b) ** 2 for a, b in zip(point, e, strict=True)), at) for at, e in enumerate(books[p]))

    for _ in range(rounds):
        for p, s in enumerate(where):
            held = {}
            for _, v, _, _ in good:
                held.setdefault(nearest(p, v[s])[1], []).append(v[s])
            for at, points in held.items():
                books[p][at] = tuple(sum(c) // len(points) for c in zip(*points, strict=True))
    out = []
    for i, v, label, _ in good:
        found = [nearest(p, v[s]) for p, s in enumerate(where)]
        out.append((i, "".join(f"{at:02x}" for _, at in found), sum(d for d, _ in found), label))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **options):
    rows = [(i, v and [x if x is None else float(x) for x in v], s) for i, v, s in rows]
    table = spark.createDataFrame([(*r, "0", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, error int")
    books = C.fit_codebooks(table, scale=1024, **options)
    coded, (want, digest) = C.encode_vectors(table, books, "vec_id", "embedding", "label"), brute(rows, **options)
    assert books.digest() == digest
    got = [(r.vec_id, r.code.hex(), r.error, r.label) for r in coded.collect()]
    fits = lambda e: e if e <= V.MOST else None
    assert sorted(got, key=repr) == sorted([(i, c, fits(e), s) for i, c, e, s in want], key=repr)
    return table, want, digest


@pytest.mark.parametrize("limit", [None, 0])
def test_awkward_rows(spark, monkeypatch, limit):
    rng = random.Random(1)
    vec = lambda n=9: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vec(), rng.choice([0, 1, 2, None])) for i in range(300)]
    same = vec()
    rows += [(i, same, 3) for i in range(400, 550)]  # a third of all rows are equal
    rows += [(900, None, 1), (901, [0.1, None] + vec(7), 1), (902, [NAN] + vec(8), 1), (903, [INF] + vec(8), 1), (904, [1.7e308] + vec(8), 1)]
    rows += [(905, [], 1), (906, vec(4), 1), (None, vec(), 5), (3, vec(), 1), (3, vec(), None), rows[0], rows[0], (-7, vec(), 2)]
    rng.shuffle(rows)
    if limit is not None:  # more labels than may be shipped
        monkeypatch.setattr(C, "collect_bounded", lambda df: None)
    table, want, digest = check(spark, rows, entries=40)
    monkeypatch.setattr(C, "ENTRIES", 40)
    monkeypatch.setattr(C, "fit_codebooks", lambda *a, f=C.fit_codebooks, **k: f(*a, entries=40, **k))
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in C.compress(table).collect()]
    total = {}
    for *_, e, s in want:
        total[s] = total.get(s, 0) + e
    assert sorted(got, key=repr) == sorted([(i, c, e, total[s], digest) for i, c, e, s in want], key=repr)


def test_components_of_any_size(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e-3, 1.0, 1e5, 1e12, 1e30]) * rng.uniform(-1, 1) for _ in range(8)], i % 2) for i in range(60)]
    check(spark, rows, entries=7, rounds=3)
    check(spark, [(i, [1e9 * rng.uniform(-1, 1) for _ in range(4)], i % 2) for i in range(60)], entries=7, rounds=3)


def test_few_rows_short_vectors_and_none(spark):
    check(spark, [(5, [0.5, 0.25], 1), (2, [0.5, 0.25], None), (9, [-1.0, 3.0], 1)])
    check(spark, [(1, [], 1), (2, [], 1)])
    check(spark, [(1, None, 1)])
    check(spark, [])


def test_rows_without_any_id(spark):
    table = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], 1)], "vec_id bigint, embedding array<double>, label int")
    assert C.compress(table).collect() == []  # there is nothing that a codebook could start from


def test_search_finds_the_nearest_of_equally_near_entries():
    rng = np.random.default_rng(3)
    for length, entries, high in ((1, 50, 4), (3, 200, 3), (16, 256, 1000), (2, 1, 5)):
        book = rng.integers(-high, high + 1, (entries, length))
        points = rng.integers(-high, high + 1, (400, length)).astype(float)
        at, far = C.Neighbours([tuple(map(int, e)) for e in book]).search(points)
        apart = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (at == apart.argmin(axis=1)).all() and (far == apart.min(axis=1)).all()


def test_search_leaves_far_entries_out():
    """Entries beyond twice the current distance are never measured."""
    book = C.Neighbours([(i * 1000,) for i in range(200)])
    measured = []

    class Counting(np.ndarray):
        def __sub__(self, other):
            measured.append(len(other))
            return np.asarray(self) - np.asarray(other)

    points = (np.arange(200.0) * 1000 + 10)[:, None].view(Counting)
    at, _ = book.search(points)
    assert at.tolist() == list(range(200))
    assert sum(measured) < 200 * 30


def test_decode():
    books = C.Codebooks([[(1, 2), (3, 4)], [(5,), (6,)]], 3, 1, 6.0)
    assert books.decode(bytes([1, 0])) == [3, 4, 5]
