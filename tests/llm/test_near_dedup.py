import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import common, near_dedup
from tidemark.llm.near_dedup import bag_signatures, classes, one_of_each
from tidemark.llm.shingles import multisets, word_shingles


def shingles(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, similarity=0.8):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [shingles(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            union = sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (union and shared / union >= similarity - 1e-12):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def corpus(seed=7, groups=12, copies=9):
    rnd = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(40, 160))]
        for k in range(copies):
            words = list(base)
            for _ in range(rnd.randrange(0, 5) if k else 0):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    rnd.shuffle(rows)
    return rows


def test_signatures_estimate_weighted_jaccard():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    a = [rnd.choice(words) for _ in range(400)]
    b = a[:320] + [f"x{i}" for i in range(80)]
    texts = [" ".join(a).encode(), " ".join(b).encode()]
    o, h, c = multisets(*word_shingles(texts, 1))  # single words: counts far over one
    s = bag_signatures(o, h, c, 2, 4096)
    want = sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values())
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_classes_equal_brute_force(documents):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in classes(documents(rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("options", [{"stars": 1, "growth": 2, "few": 2}, {"broadcast_rows": -1, "few": 2}])
def test_every_way_through_the_rounds_equals_brute_force(documents, options, monkeypatch):
    """No stars after the first, pivots deferred in any bucket over two, texts by shuffle, keys hot from three rows on."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = corpus(seed=8, groups=3, copies=14)
    got = {r["doc_id"]: r["class_id"] for r in classes(documents(rows), **options).collect()}
    assert got == brute(rows)


def test_chain_through_a_base_that_is_not_the_pivot(documents):
    """Copies that are near the base but not each other still share its class."""
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        words = list(base)
        for j in range(3):
            words[(k * 5 + j * 61) % 200] = f"c{k}-{j}"
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in classes(documents(rows)).collect()}
    assert got == brute(rows)
    assert set(got.values()) == {0}


def test_defined_results_for_odd_rows(edge, nothing):
    rows = classes(edge).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["class_id"] == by[2]["class_id"] == 1  # null is as empty
    assert by[3]["class_size"] == 1 and by[4]["class_size"] == 2
    assert [r["class_id"] for r in rows if r["doc_id"] is None] == [None]
    assert classes(nothing).count() == 0


def test_one_of_each_keeps_columns_and_one_row(edge, documents):
    kept = one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7]
    rows = corpus(groups=4)
    want = set(brute(rows).values())
    assert {r["doc_id"] for r in one_of_each(documents(rows)).collect()} == want


def test_overlap_share():
    a = (np.array([1, 2, 3], np.uint64), np.array([1, 2, 1]))
    b = (np.array([2, 3, 9], np.uint64), np.array([1, 1, 5]))
    assert near_dedup.overlap_share(a, b) == 2 / (4 + 7 - 2)


def test_one_of_each_keeps_a_row_of_a_class_with_null_ids(documents):
    base = [f"b{i}" for i in range(100)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (0, 99)]
    for null_first in (True, False):  # whichever node is the smaller
        texts = sorted(near, key=lambda t: hashlib.md5(t.encode()).hexdigest(), reverse=null_first)
        rows = [(7, texts[0]), (None, texts[1]), (9, "a text of quite another kind")]
        assert sorted(r["doc_id"] for r in one_of_each(documents(rows)).collect()) == [7, 9]
