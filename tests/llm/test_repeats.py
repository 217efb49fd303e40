import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import common
from tidemark.llm.repeats import led_runs, remove_repeats


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[p : p + length] for _, r in raw for p in range(len(r) - length + 1))
    out = []
    for d, r in raw:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7)))
    passages = [" ".join(word() for _ in range(rnd.randrange(4, 30))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randrange(1, 25))) for _ in range(rnd.randrange(1, 6))]
        text = " ".join(parts)
        a = rnd.randrange(len(text))
        rows.append((i, text[a:] if rnd.random() < 0.3 else text))
    rows += [(n, rows[0][1]), (n + 1, "abab" * 60), (n + 2, "q" * 90), (n + 3, "r" * 41)]
    return rows


def test_removal_equals_brute_force(documents):
    for seed, (length, gram, block) in enumerate([(40, 10, 8), (40, 25, 4), (24, 6, 8)]):
        rows = corpus(seed)
        got = remove_repeats(documents(rows), length, gram, block).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect())) == brute(rows, length)


def brute_passages(rows, words):
    held = Counter(p for _, t in rows for p in {tuple(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)})
    return {d for d, t in rows if any(held[tuple(t.split()[k : k + words])] > 1 for k in range(len(t.split()) - words + 1))}


@pytest.mark.parametrize("broadcast_rows", [1_000_000, -1])
def test_every_way_through_the_joins(documents, monkeypatch, broadcast_rows):
    """Keys hot from three rows on, texts by broadcast and by shuffle; passages against brute force."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = corpus(11)
    got = remove_repeats(documents(rows), 40, 10, 8, passage=12, broadcast_rows=broadcast_rows).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows, 40)
    want = brute_passages(rows, 12)
    assert {r["doc_id"] for r in got if r["shares_passage"]} == want and 0 < len(want) < len(rows)


def test_kept_bytes_are_the_remainder(documents):
    rows = corpus(5, 20)
    for r in remove_repeats(documents(rows), 40, 10, 8, kept=True).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_every_start_is_led_once():
    data = np.frombuffer(bytes(random.Random(1).choices(b"abc", k=500)), np.uint8)
    text, lead, first, last, _, _ = led_runs(data, np.array([0, 200, 500]), 40, 10)
    starts = [p for a, b in zip(first, last) for p in range(a, b + 1)]
    assert starts == [*range(0, 161), *range(200, 461)]
    assert all(a <= m + 30 and m >= b for m, a, b in zip(lead, lead - 30, last)) and (lead - first <= 30).all()


def test_defined_results_for_odd_rows(edge, nothing):
    rows = remove_repeats(edge).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_bytes"] == by[2]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[6]["n_removed"] == 50_000 and by[6]["n_spans"] == 1  # every string of it starts elsewhere too
    assert by[5]["n_removed"] == 150_000 and by[5]["shares_passage"] == 0  # its passages are in no other row
    assert by[4]["n_removed"] == 0  # copies shorter than the length
    assert remove_repeats(nothing).count() == 0
