import math
import random

from pyspark.sql import functions as F

from quillmap.llm import exact_topk as T

INF, NAN = float("inf"), float("nan")


def brute(rows, k, scale, every):
    good = [(i, [math.floor(x * scale) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        hits = sorted((-max(-T.MOST, min(T.MOST, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return sorted(out)


def check(spark, rows, k=10, every=100):
    rows = [(i, v and [x if x is None else float(x) for x in v], s) for i, v, s in rows]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = T.exact_top_k(table, F.pmod("id", F.lit(every)) == 0, k, 1024)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == brute(rows, k, 1024, every)


def test_awkward_rows(spark):
    rng = random.Random(1)
    vec = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vec(), "x") for i in range(420)]
    same = vec()
    rows += [(i, same, None) for i in range(500, 900)]  # a third of all rows are equal: ties go to small ids
    rows += [(1000, None, "x"), (1001, [0.1, None, 0.2, 0.3], "x"), (1100, [0.1, NAN, 0, 0], "x"), (1200, [INF, 0, 0, 0], "x"), (None, vec(), "x")]
    rows += [(1300, [], "x"), (1301, [], "x"), (1400, vec(2), "x"), (1401, vec(2), "x"), (1500, vec(9), "x")]
    rows += [rows[0], rows[7], (-100, vec(), "x"), (100, vec(), "second vector of an id")]
    check(spark, rows)


def test_several_rounds_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BINS", 4)
    monkeypatch.setattr(T, "SLACK", 0)
    monkeypatch.setattr(T, "QUERIES_IN_BLOCK", 7)
    monkeypatch.setattr(T, "CANDIDATES_IN_GROUP", 60)
    monkeypatch.setattr(T, "TILE", 16)
    rng = random.Random(2)
    check(spark, [(i, [rng.randint(-3, 3) / 64 for _ in range(3)], "x") for i in range(200)], k=5, every=10)


def test_fewer_rows_than_k_and_none(spark):
    check(spark, [(0, [0.5], "x"), (1, [-0.5], "x"), (2, [0.25], "x")])
    check(spark, [(0, [0.5], "x")])
    check(spark, [(1, [0.5], "x")])
    check(spark, [])


def test_components_of_any_size(spark):
    check(spark, [(i, [1e5 * (i - 3), 1e4], "x") for i in range(6)], every=2)
    check(spark, [(0, [1e300], "x"), (1, [1.0], "x"), (2, [5e12], "x"), (100, [1.0], "x"), (3, [-1e200], "x")])
    rng = random.Random(3)
    check(spark, [(i, [rng.choice([1.0, 1e7, 1e12, 1e30]) * rng.uniform(-1, 1) for _ in range(3)], "x") for i in range(200)], every=20)


def test_many_cells_in_few_partitions(spark, monkeypatch):
    """100 groups by 100 blocks need no more than 200 partitions."""
    for name, value in (("QUERIES_IN_BLOCK", 1), ("CANDIDATES_IN_GROUP", 4), ("CELLS", 10_000), ("PARTITIONS", 200)):
        monkeypatch.setattr(T, name, value)
    seen = []
    real = T._pass
    monkeypatch.setattr(T, "_pass", lambda rows, queries, groups, blocks, k, bins: seen.append((groups, blocks, (df := real(rows, queries, groups, blocks, k, bins)).rdd.getNumPartitions())) or df)
    rng = random.Random(4)
    check(spark, [(i, [rng.uniform(-1, 1) for _ in range(2)], "x") for i in range(400)], k=3, every=4)
    assert seen and all(g == 100 and b == 100 and n <= 200 for g, b, n in seen)


def test_rows_above_a_range_count_once(spark):
    """Clusters whose bins are not divided evenly: rows above the next range have been counted before."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    for spread in (1e-3, 3e-3, 1e-2):
        rows = [(i, [x + rng.gauss(0, spread) for x in centres[i % 3]], "x") for i in range(1200)]
        rows[0] = (0, [50 * x for x in rows[0][1]], "x")
        check(spark, rows, every=12)


def test_scores_of_all_64_bits(spark):
    """Scores between 2^62 and 2^63 are integers like others."""
    rows = [(i, [s * (2.1e6 + i), 1.0], "x") for i in range(40) for s in [1 if i % 2 else -1]]
    assert T.MOST == 2 ** 63 - 1
    check(spark, rows, every=10)
