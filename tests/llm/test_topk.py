import math
import random

from tidemark.llm.topk import search


def brute(rows, k, every):
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and v}
    out = []
    for q in sorted(i for i in good if i % every == 0):
        hits = sorted(((sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])), key=lambda h: (-h[0], h[1]))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(hits)]
    return out


def test_equals_brute_force_with_ties(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(700)]
    rows += [(700, None), (701, [0.1, None, 0.2, 0.3, 0.1, 0.1]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (None, [0.1] * 6), (704, []), (750, [0.5, 0.5]), (760, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, block string")
    got = [tuple(r) for r in search(df, "vec_id % 50 = 0", shard_rows=150, query_rows=6, leaf=8).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 5, 50)


def test_real_vectors_and_large_values(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1e5 if i % 3 == 0 else 1) for _ in range(16)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search(df, "vec_id % 50 = 0", shard_rows=100).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 5, 50)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema), "vec_id % 50 = 0").count() == 0
    rows = [(0, [1.0, 2.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5])]
    got = [tuple(r) for r in search(spark.createDataFrame(rows, schema), "vec_id % 50 = 0").collect()]
    assert got == [(0, n, 3, 256 * 128 + 512 * 128) for n in (1, 2)]


def test_different_vectors_of_one_id_all_count(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 2.5]), *[(i, [0.5, 0.25]) for i in range(3, 40)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search(df, "vec_id % 50 = 0", shard_rows=10, leaf=2).orderBy("rank").collect()]
    pairs = sorted(((sum(int(256 * a) * int(256 * b) for a, b in zip(q, v)), i) for _, q in rows[:2] for i, v in rows[2:]), key=lambda h: (-h[0], h[1]))
    assert got == [(0, n + 1, i, s) for n, (s, i) in enumerate(pairs[:5])]


def test_equal_rows_count_each(spark):
    """As candidates and as queries; more copies than k, and copies that push others out of the k best."""
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([0.25, 0.5, -0.5]) for _ in range(4)]) for i in range(120)]
    rows += [rows[i] for i in (50, 7, 7, 9)] + [(200, [0.5] * 4)] * 3 + [(31, [2.0] * 4)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search(df, "vec_id % 50 = 0", shard_rows=30, leaf=4).orderBy("query_id", "rank").collect()]
    want = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        pairs = sorted(((sum(int(256 * a) * int(256 * b) for a, b in zip(x, v)), i) for j, x in rows if j == q for i, v in rows if i != q), key=lambda h: (-h[0], h[1]))
        want += [(q, n + 1, i, s) for n, (s, i) in enumerate(pairs[:5])]
    assert got == want
