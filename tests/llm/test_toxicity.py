import math
import random
import zlib

import numpy as np

from tidemark.llm.common import WindowHash
from tidemark.llm.toxicity import GramReader, classify, count_features, fit, fit_linear

BAD = ["idiot", "trash", "scum", "worthless"]


def make(n=400, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(20, 200))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, documents):
    docs, labels = make()
    out = classify(documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), sample_rows=200).collect()
    truth = dict(labels)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    docs, labels = make(120)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    score = lambda rows: {r["doc_id"]: r["score"] for r in classify(documents(docs), spark.createDataFrame(rows, "doc_id long, toxic int"), sample_rows=50).collect()}
    assert score(labels) == score(flipped)


def test_features_are_a_set():
    read = GramReader()
    once, twice = read("some words here"), read("some words here some words here")
    assert len(set(once.tolist())) == len(once) and set(once.tolist()) <= set(twice.tolist())
    assert read("").size == 0 or len(read("")) < 8


def test_defined_results_for_odd_rows(spark, edge, nothing, documents):
    docs, labels = make(80)
    many = documents(docs + [(1000, None), (1001, ""), (None, "no id"), (1002, "w " * 40_000)])
    rows = classify(many, spark.createDataFrame(labels + [(0, None), (1, None)], "doc_id long, toxic int"), sample_rows=40).collect()
    assert len(rows) == 84 and all(r["score"] is not None for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1000]["score"] == by[1001]["score"] and by[None]["held_out"] is False
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in classify(edge, none).collect()} == {0.5}
    assert classify(nothing, none).count() == 0


def test_copies_do_not_fill_the_sample(spark, documents):
    """A thousand copies of one text of each label: the sample is of different texts, and held-out rows are told apart."""
    docs, labels = make()
    copies = [(10_000 + i, docs[i % 2][1]) for i in range(2_000)]
    marks = [(10_000 + i, labels[i % 2][1]) for i in range(2_000)]
    out = classify(documents(docs + copies), spark.createDataFrame(labels + marks, "doc_id long, toxic int"), sample_rows=60).collect()
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9


def features(text, grams=(4, 5, 6), bits=18):
    """Plainly: every n-gram of the lower-cased text between blanks, hashed by itself."""
    data = " ".join(["", *[text], ""]).encode().lower()
    data = bytes(32 if 9 <= c <= 13 else c for c in data)
    every = {data[i : i + n] for n in grams for i in range(len(data) - n + 1)}
    return {int(WindowHash(np.frombuffer(g, np.uint8)).every(len(g))[0] >> np.uint64(64 - bits)) for g in every}


def sample_of(n, seed):
    docs, labels = make(n, seed)
    texts = [t[:60] for _, t in docs[: n - 4]] + ["Über IDIOT\tscum", "", "Trash trash TRASH", "日本語 worthless"]
    return texts, [y for _, y in labels[: n - 4]] + [1, 0, 1, 1]


def test_counts_equal_brute_force(spark):
    texts, marks = sample_of(60, 3)
    want = {}
    for t, y in zip(texts, marks):
        for f in features(t):
            want.setdefault(f, [0, 0])[y] += 1
    train = spark.createDataFrame(list(zip(texts, marks)), "text string, label int").repartition(3)
    assert {r["feature"]: [r["clean"], r["toxic"]] for r in count_features(train).collect()} == want


def test_weights_and_scores_equal_brute_force(spark, documents):
    """The same objective by plain dense gradient steps, and scores as sums of the weights of a text's features."""
    texts, marks = sample_of(40, 4)
    sets, y = [features(t, bits=10) for t in texts], np.array(marks)
    n = [(y == k).sum() for k in (0, 1)]
    held = np.array([[f in s for f in range(1 << 10)] for s in sets], float)
    share = [(held[y == k].sum(0) + 1.0) / (n[k] + 2.0) for k in (0, 1)]
    ratio = np.log(share[1] / share[0])
    x, weigh = held * ratio, np.where(y == 1, 0.5 / n[1], 0.5 / n[0])

    def loss(w, b):
        z = x @ w + b
        return (weigh * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-4 * (w**2).sum()

    w, b = np.zeros(1 << 10), 0.0
    step = 4.0 / (weigh * ((x**2).sum(1) + 1)).sum()
    for _ in range(20_000):
        g = weigh * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - step * (x.T @ g + 1e-4 * w), b - step * g.sum()
    order = sorted(range(len(texts)), key=lambda i: (marks[i], texts[i]))
    found = fit_linear([texts[i] for i in order], y[order], ratio, (4, 5, 6), 10, rounds=2_000)
    seen = ratio != 0
    assert loss(np.where(seen, found[:-1] / np.where(seen, ratio, 1), 0), found[-1]) <= loss(w, b) + 1e-4
    # fit() sees the same rows, as each text is one of the sample
    train = spark.createDataFrame(list(zip(texts, marks)), "text string, label int")
    weights = fit(train, bits=10)
    short = fit_linear([texts[i] for i in order], y[order], ratio, (4, 5, 6), 10)
    assert len(set(texts)) == len(texts) and np.allclose(weights, short, atol=1e-5)
    out = classify(documents(list(enumerate(texts))), spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"), bits=10).collect()
    learned = fit(spark.createDataFrame([(t, m) for i, (t, m) in enumerate(zip(texts, marks)) if zlib.crc32(str(i).encode()) % 5], "text string, label int"), bits=10)
    for r in out:
        z = sum(learned[f] for f in sets[r["doc_id"]]) + learned[-1]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), abs_tol=1e-6)


def test_sample_is_bounded_in_bytes(spark, documents):
    """Texts over the bound are counted but not sampled; where no text of a label is short enough, there is no model."""
    docs, labels = make(120)
    huge = [(9_000 + i, f"idiot scum {i} " * 4_000) for i in range(3)]
    marked = spark.createDataFrame(labels + [(d, 1) for d, _ in huge], "doc_id long, toxic int")
    tight = classify(documents(docs + huge), marked, sample_bytes=32_000).collect()
    assert len(tight) == 123 and len({r["score"] for r in tight}) > 1
    assert sum(r["predicted"] == dict(labels).get(r["doc_id"], 1) for r in tight) / len(tight) > 0.8
    none = classify(documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), sample_bytes=16).collect()
    assert len(none) == 120 and {r["score"] for r in none} == {0.5}
