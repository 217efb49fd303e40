import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.winnow import decontaminate, gram_hashes, winnowed, words_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items):
    spans = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            spans[tuple(w[i : i + 10])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(s) for s in spans}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in spans:
                    ids |= spans[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()), key=str)
    assert got == brute(docs, items)
    return got


def test_words_fold_ascii_letters_alone():
    texts = ["It's ÄÖ a2B_c\x00d\x7f~é", "", "日本 語", "\x80"]
    counts, one, two = words_of([t.encode() for t in texts])
    assert list(counts) == [len(words(t)) for t in texts]
    again = words_of([" ".join(words(t)).encode() for t in texts])
    assert all(np.array_equal(a, b) for a, b in zip((counts, one, two), again))


@pytest.mark.parametrize("seed", range(5))
def test_every_window_holds_a_fingerprint(seed):
    rnd = np.random.default_rng(seed)
    grams = gram_hashes(rnd.integers(0, 4, 300).astype(np.uint64), 6)
    places = set(winnowed(grams, 5))
    for i in range(len(grams) - 4):
        own = grams[i : i + 5]
        assert i + 4 - int(np.argmin(own[::-1])) in places
    assert not len(winnowed(grams[:3], 5))


def test_random_texts_of_few_words(spark):
    """Few different words, so that short and long items occur often, with repeats and overlaps."""
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(["a", "B", "c", "Éa", "d,"]) for _ in range(n))
    docs = [(i, text(rnd.randrange(0, 90))) for i in range(60)]
    items = [(i, text(rnd.choice([3, 5, 7, 9, 10, 11, 14]))) for i in range(40)] + [(i, " ".join(docs[i][1].split()[2:16])) for i in range(41, 50)]
    got = check(spark, docs, items)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_a_small_filter_changes_no_result(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(str(rnd.randrange(50)) for _ in range(n))
    docs = [(i, text(200)) for i in range(30)]
    items = [(i, " ".join(docs[i][1].split()[50 : 60 + i])) for i in range(20)]
    check(spark, docs, items, filter_bits=1 << 7)


def test_short_items_long_spans_and_borders_of_texts(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, ten), (2, ten + " eleven"), (3, "one two three four five"), (4, "six seven eight nine ten"), (5, "x " + ten.upper() + "!"), (6, "one"), (7, "ONE-two"), (8, ten + " " + ten)]
    check(spark, docs, [(1, ten), (2, "One."), (3, ten + " eleven twelve"), (4, "two"), (11, ten), (5, "zero " + ten)])


def test_a_passage_of_many_items_in_many_documents(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(i, f"a{i} b {passage} c{i}") for i in range(1500)] + [(9_000 + i, f"clean text {i}") for i in range(20)]
    check(spark, docs, [(i, f"{passage} {i}") for i in range(40)] + [(50, "a3 b w0 w1 w2 w3 w4 w5 w6 w7 w8")])


def test_odd_rows(spark, edge, nothing, documents):
    items = spark.createDataFrame([(1, "twice the same row"), (2, None), (3, ""), (None, "word"), (4, " ".join(["word"] * 30)), (4, "x" * 50_000)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in decontaminate(edge, items).collect()), key=str)
    assert got == brute(rows, [tuple(r) for r in items.collect()])
    assert decontaminate(nothing, items).count() == 0
    none = decontaminate(edge, items.limit(0)).collect()
    assert len(none) == 9 and not any(r["contaminated"] for r in none)
