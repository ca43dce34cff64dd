import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import hard_negatives as H
from quillmap.llm import vectors as V

INF, NAN = float("inf"), float("nan")


def ended(x):
    return max(-V.MOST, min(V.MOST, x))


def brute(rows, every, positives=5, negatives=3, scale=256):
    good = [(i, s, [x * scale for x in v]) for i, v, s in rows if i is not None and s is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v)]
    asked = {}
    for i, s, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, (s, v)), (s, v))
    good = [(i, s, [math.floor(x) for x in v]) for i, s, v in good]
    out = []
    for q, (label, v) in asked.items():
        v = [math.floor(x) for x in v]
        scored = [(-ended(sum(a * b for a, b in zip(v, w, strict=True))), i, s) for i, s, w in good if len(w) == len(v)]
        near = sorted((n, i) for n, i, s in scored if s == label and i != q)[:positives]
        for n, p in near:
            fits = sorted((m, i) for m, i, s in scored if s != label and -50 * n <= -100 * m <= -95 * n)[:negatives]
            out += [(q, p, r + 1, i, -n, -m) for r, (m, i) in enumerate(fits)]
    return sorted(out)


def check(spark, rows, every=10):
    rows = [(i, v and [x if x is None else float(x) for x in v], s) for i, v, s in rows]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, score string, rank int")
    got = H.mine_hard_negatives(table, F.pmod("id", F.lit(every)) == 0)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    want = brute(rows, every)
    assert sorted(map(tuple, got.collect())) == want
    return want


def clustered(rng, n, length=12, labels=4, spread=0.5):
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(labels)]
    rows = []
    for i in range(n):
        s = rng.randrange(labels)
        rows.append((i, [x + rng.gauss(0, spread) + 0.5 for x in centres[s]], s if rng.random() < 0.8 else rng.randrange(labels)))
    return rows


def test_awkward_rows(spark):
    rng = random.Random(1)
    rows = clustered(rng, 300)
    vec = lambda n=12: [rng.uniform(-1, 1) for _ in range(n)]
    same = [x * 0.7 for x in rows[0][1]]
    rows += [(i, same, 1 + i % 2) for i in range(500, 650)]  # a third of all rows are equal
    rows += [(700, None, 1), (710, [0.1, None], 1), (720, [NAN] + vec(11), 1), (730, [INF] + vec(11), 1), (740, vec(), None), (None, vec(), 1)]
    rows += [(750, [], 1), (751, [], 1), (752, [], 2), (760, vec(2), 1), (761, vec(2), 1), (762, vec(2), 2), (770, vec(70), 9)]
    rows += [(-20, vec(), 1), (10, vec(), 3), (10, vec(), 0), rows[20], rows[20], rows[31]]
    rng.shuffle(rows)
    assert len(check(spark, rows)) > 300


def test_blocks_groups_and_tiles(spark, monkeypatch):
    for name, value in (("BLOCK_COMPONENTS", 60), ("ROWS_IN_GROUP", 40), ("CELLS", 30), ("ANCHOR_TILE", 3), ("ROW_TILE", 17), ("PAIRS", 5)):
        monkeypatch.setattr(H, name, value)
    assert check(spark, clustered(random.Random(2), 200), every=7)


def test_few_rows_and_none(spark):
    check(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.6, 0.0], 2), (3, [0.95, 0.0], 2), (4, [0.5, 0], 2), (5, [0.4, 0], 2)])
    check(spark, [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)])  # a band of the single score 0
    check(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.7], 2)])  # no band below a negative score
    check(spark, [(0, [1.0], 1)])
    check(spark, [])


def test_components_of_any_size(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1.0, 1e6, 1e12, 1e30, 1e200]) * rng.uniform(0, 1) for _ in range(3)], i % 3) for i in range(80)]
    check(spark, rows, every=5)
    check(spark, [(i, [1e7 * rng.uniform(0, 1), 1.0], i % 2) for i in range(80)], every=5)


@pytest.mark.parametrize("length", [1, 3, 64, 100])
def test_intervals_hold_every_score_and_spare_most(length):
    rng = np.random.default_rng(length)
    centres = rng.normal(0, 40, (8, length))
    x = np.floor(centres[rng.integers(0, 8, 900)] + rng.normal(0, 4, (900, length)))
    q = x[:60]
    low, high = H.Anchors(q).intervals(slice(0, 60), H.Codes(x), slice(0, 900))
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    if length == 64:
        width = (high - low) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1)))
        assert np.median(width) < 1.3


def test_intervals_spare_work():
    rng = np.random.default_rng(5)
    centres = rng.choice([-60.0, 60.0], (10, 64))
    of = rng.integers(0, 10, 4000)
    x = np.floor(centres[of] + rng.normal(0, 3, (4000, 64)))
    block = H.Block([(np.arange(40), np.zeros(40, dtype=np.int64), x[:40].ravel(), None)], 64, 5, False)
    block.meet(np.arange(4000), np.zeros(4000, dtype=np.int64), x)
    assert block.scored < 40 * 4000 * 0.65  # rotated codes leave about 0.6 of each length over
    order = np.lexsort((np.arange(4000)[None, :].repeat(40, 0), -(x[:40] @ x.T)), axis=1)
    for a in range(40):
        assert block.best.id[a].tolist() == [i for i in order[a] if i != a][:5]


def test_codes():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 10, (50, 70))
    codes, turn = H.Codes(x), H.rotation(70)
    assert np.allclose(turn @ turn.T, np.eye(70))
    unit = np.sign(x @ turn) / np.sqrt(70)
    assert np.allclose(codes.along, ((x @ turn) * unit).sum(axis=1))
    left = (x @ turn) - codes.along[:, None] * unit
    assert np.allclose(codes.left, np.sqrt((left ** 2).sum(axis=1)))
