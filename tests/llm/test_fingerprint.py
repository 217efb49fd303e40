import hashlib
import random

import numpy as np

from tidemark.llm.fingerprint import WINDOW, _entropy_bins, digests, fingerprint_edits, likeness


def prose(seed, words=300):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(words))


RANK = np.arange(1024)


def test_entropy_of_every_window():
    data = np.frombuffer(prose(1).encode()[:400], np.uint8)
    for start, got in enumerate(_entropy_bins(data)):
        _, n = np.unique(data[start : start + WINDOW], return_counts=True)
        want = 6 - (n * np.log2(n)).sum() / WINDOW
        assert abs(got - want / 6 * 1024) <= 1.01


def test_digest_depends_on_the_text_alone():
    texts = [prose(i, 50 * i).encode() for i in range(1, 8)] + [b"", b"short", b"y" * 90]
    together = digests(texts, RANK)
    for t, d in zip(texts, together):
        assert (digests([t], RANK)[0] == d).all() and digests([t], RANK)[0].shape == d.shape


def test_likeness_orders_edits():
    base = prose(3, 600)
    some = base[: len(base) * 9 // 10] + prose(4, 60)
    other = prose(5, 600)
    a, b, c = digests([base.encode(), some.encode(), other.encode()], RANK)
    assert likeness(a, a) == 1.0 and likeness(a, b) > 0.7 > 0.3 > likeness(a, c)
    assert abs(likeness(a, b) - likeness(b, a)) < 1e-12
    assert likeness(a[:0], a[:0]) == 1.0 and likeness(a[:0], a) == 0.0


def test_edits_follow_descending_ids_across_ranges(documents):
    rows = [(i * 3, prose(i, 20 + i % 7)) for i in range(60)]
    got = {r["doc_id"]: r for r in fingerprint_edits(documents(rows), rows_per_block=7).collect()}
    ids = sorted((d for d, _ in rows), reverse=True)
    text = dict(rows)
    assert len(got) == 60
    for k, d in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        half = len(text[d]) // 2
        edited = text[d][: len(text[d]) - half] + after[:half]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["n_chars"] == len(text[d]) and 0 <= got[d]["near_next"] <= 1 and 0 <= got[d]["near_edited"] <= 1


def test_defined_results_for_odd_rows(edge, nothing, documents):
    rows = fingerprint_edits(edge).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "" and by[1]["n_chars"] == 0
    twice = [r["fingerprint"] for r in rows if r["doc_id"] == 4]
    assert twice[0] == twice[1]
    assert fingerprint_edits(nothing).count() == 0
    alone = fingerprint_edits(documents([(9, prose(9))])).first()
    assert alone["near_next"] == 1.0  # after the last comes the first


def test_no_text_but_an_empty_one_has_an_empty_fingerprint():
    rank = RANK.copy()
    rank[: 1024 // 6] = 1024  # low entropy: never selected, as in entropy_ranks()
    texts = [prose(i, 200).encode()[:i] for i in range(1, 301)] + [b"z" * n for n in range(1, 301)] + [b"ab" * 3000, b"y" * 50_000]
    found = digests([b"", *texts], rank)
    assert len(found[0]) == 0 and all(len(d) for d in found[1:])
    for t, d in zip(texts[126:141], found[127:142]):
        assert (digests([t], rank)[0] == d).all()
    a, b = digests([prose(1).encode()[:130], prose(2).encode()[:130]], rank)
    assert likeness(a, b) < 0.5
