import os
import random

import numpy as np
import pytest

from tidemark.llm.pieces import Encoder, PieceModel, decode, encode_documents
from tidemark.llm.registry import PIECE_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    return PieceModel(PIECE_MODEL)


def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def texts(seed=1, n=400):
    rnd = random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCxyz0123456789", "aab", "éèüßñ çàö", "日本語漢字かな", "🎉🎈𝕏‍", "(){}[]=+-*/;:.,!?\"'", "\n\t  \x00", "▁ a"]
    out = ["", " ", "   ", "\n", "a  b", " a", "x   ", "\x00a", "▁x", "a" * 300, " " * 40 + "x", "Hello, World!"]
    for _ in range(n):
        out.append(" ".join("".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randrange(1, 14))) for _ in range(rnd.randrange(1, 25))))
    return out


def test_equals_the_library(model):
    data = texts()
    got = Encoder(model).encode(data)
    want = library().encode(data)
    assert [g.tolist() for g in got] == want
    assert decode(model, got) == [library().decode(w) for w in want]


def test_round_trip(model):
    data = [t for t in texts(2)]
    assert decode(model, Encoder(model).encode(data)) == [t.replace("▁", " ") for t in data]


def test_long_texts_without_blanks_equal_the_library(model):
    rnd = random.Random(5)
    letters = "".join(rnd.choice("etaoinshrdlu") for _ in range(200_000))
    mixed = "".join(rnd.choice(["the", "ing", "日本", "é", "🎉", "x", "123", "==", "-"]) for _ in range(40_000))
    data = [letters, mixed, "a" * 30_000, "=" * 5_000 + "ab" * 9_000, " " * 7_000 + "x", letters[:577], letters[:641]]
    assert [g.tolist() for g in Encoder(model).encode(data)] == library().encode(data)


def test_five_megabytes_without_a_blank(model):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789/-_") for _ in range(5_000_000))
    got = Encoder(model).encode([text])
    assert decode(model, got) == [text]
    assert got[0].tolist() == library().encode(text)


def test_occurrences_equal_brute_force(model):
    text = "the quick onion ioning thethe"
    codes = np.array([int(np.searchsorted(model.alphabet, ord(c))) + 2 if c != " " else 0 for c in text])
    start, row = model.occurrences(codes)
    got = {(int(s), model.pieces[model.coded[r]]) for s, r in zip(start, row)}
    pieces = {model.pieces[i] for i in model.coded}
    want = {(i, text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in pieces and " " not in text[i:j]}
    assert got == want


def test_words_kept_or_dropped_do_not_matter(model):
    small, data = Encoder(model, most_chars=10), texts(3, 60)
    once = [g.tolist() for t in data for g in small.encode([t])]
    assert once == [g.tolist() for g in Encoder(model).encode(data)]


def test_defined_results_for_odd_rows(edge, nothing):
    rows = encode_documents(edge, PIECE_MODEL).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["ids"] == [] and by[2]["n_pieces"] == 0
    assert all(r["round_trip"] for r in rows)
    assert encode_documents(nothing, PIECE_MODEL).count() == 0


def test_kept_columns_may_bear_names_of_the_result(edge):
    docs = edge.withColumnRenamed("size", "ids").withColumnRenamed("score", "n_pieces")
    out = encode_documents(docs, PIECE_MODEL, keep=docs.columns)
    assert {"input_ids", "input_n_pieces", "ids", "n_pieces"} <= set(out.columns)
    assert {r["input_ids"] for r in out.collect()} == {"x"}
