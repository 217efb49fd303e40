import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm.mixing import due_time, in_training_order, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= over


def corpus(seed=1, n=600):
    rnd = random.Random(seed)
    sources = ["zeta", "alpha", "beta", None, "Ünï", "omega", "b"]
    return [(i, " ".join("w" for _ in range(rnd.randrange(0, 80))), "en", rnd.choices(sources, [30, 5, 3, 2, 1, 8, 1])[0]) for i in range(n)] + [(n, None, "en", "alpha"), (n + 1, "a\x0bb\x0cc d", "en", "empty?")]


def test_targets_and_takes(documents):
    rows = corpus()
    got = mix(documents(rows)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    sums = defaultdict(int)
    for i in size:
        sums[source[i]] += size[i]
    want = targets(sums)
    taken = defaultdict(int)
    for r in got:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == sums[source[i]]
        assert abs(r["target"] - want[source[i]]) < 1e-6 * max(1, want[source[i]])
        assert 0 <= r["taken"] <= 2 * size[i] and r["taken"] == r["size"] * r["copies"] and len(r["positions"]) == r["copies"]
        taken[source[i]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(size[i] for i in size if source[i] == s), (s, taken[s], t)


def test_reruns_and_partitions_agree(documents):
    df = documents(corpus(2))
    a, b = (sorted(map(str, mix(d).collect())) for d in (df, df.repartition(7)))
    assert a == b


def test_due_time_inverts_the_schedule(spark):
    knots = ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5))
    shares = [k / 50 for k in range(51)]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", due_time(F.col("s"), knots).alias("t"))

    def demand(t):
        return (0.5 * t + t * t) if t <= 0.5 else 0.5 + 1.5 * (t - 0.5) - (t - 0.5) ** 2

    for r in df.collect():
        assert abs(demand(r["t"]) - r["s"]) < 1e-9


def test_order_follows_positions_and_holds_every_copy(documents):
    mixed = mix(documents(corpus(3)), keep=["text", "source", "lang"])
    ordered = in_training_order(mixed).collect()
    at = [r["position"] for r in ordered]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert len(ordered) == sum(r["copies"] for r in mixed.collect())


def test_defined_results_for_odd_rows(edge, nothing, documents):
    rows = mix(edge).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["size"] == by[2]["size"] == by[3]["size"] == 0 and by[1]["taken"] == 0
    assert mix(nothing).count() == 0
    assert [r["taken"] for r in mix(documents([(1, ""), (2, None)])).collect()] == [0, 0]
