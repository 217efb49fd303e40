"""Corpus queries with SQL against DuckDB on the bundled tables and on small odd ones."""

import duckdb
import pandas as pd
import pytest

from tidemark.llm import mixing, registry, repeats, secrets

TABLES = ("documents", "embeddings", "benchmark", "conversations", "pages")


def compare(got, want):
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    a, b = sorted((tuple(r) for r in got.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert a == b, next(((r, s) for r, s in zip(a, b) if r != s), (len(a), len(b)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_oracle(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    compare(registry.QUERIES[name](spark, f"/root/testdata/{sf}"), con.execute(registry.ORACLES[name]))


def in_duck(docs):
    con, rows = duckdb.connect(), docs.select("doc_id", "text", "source").collect()
    documents = pd.DataFrame({"doc_id": pd.array([r.doc_id for r in rows], "Int64"), "text": pd.array([r.text for r in rows], "string"), "source": pd.array([r.source for r in rows], "string")})
    con.register("documents", documents)
    return con


OPERATORS = {
    "op2_repeats": repeats.remove_repeats,
    "op6_secrets": lambda d: secrets.scan_secrets(d).drop("text_hash", "span_list"),
    "op10_mixing": mixing.mix,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_equal_the_oracle(edge, name):
    compare(OPERATORS[name](edge), in_duck(edge).execute(registry.ORACLES[name]))


def test_linked_parts_equal_the_oracle(documents):
    """Candidates with and without their complements, at the scope's edge, overlapping, beside marks and wide characters."""
    key, material, bare = "token = 'abcd+1234/x=='", "Ab3" * 9 + "==", "0123456789abcdef" * 3
    texts = [
        f"client_id: app-1 {material}", f"client_id: app-1 {'ü ' * 128}{material}", f"client_id: app-1{' ' * 256}{material}", f"client_id: app-1{' ' * 257}{material}",
        material, "user=someone", f"https://a.example/path {key}", f"https://a.example/path {key} account : some.one", f"AKIA{'A1' * 8} {material} ftp://x.example y",
        f"{bare} username: someone \U0001f389 {material}", f"PASSWORD='{material}' api-key: no apikey:'short' Api_Key=\"{bare}\"", f"toKen={bare} ſecret={bare}",
        f"access_key_id={'AKIA' + 'Z9' * 7} secret:{bare}", f"x{material} {material}_ ={material} {material}= {key}", ("word " * 60 + f"user: name{key} ") * 40,
    ]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)] + [(0, texts[0], "en", "a"), (0, texts[2], "en", "a")])
    got = OPERATORS["op6_secrets"](docs)
    assert got.where("n_linked > 0").count() > 5
    compare(got, in_duck(docs).execute(registry.ORACLES["op6_secrets"]))


def test_mixes_equal_the_oracle(documents):
    """Sources that are filled at once, after others, or never; empty ones; ties of doc_id and size; null ids and sources."""
    sizes = {"a": [3] * 5, "b": [40, 7, 0, 900], "c": [2], None: [15, 15, 1], "d": [], "e": [0, 0], "f": [5000, 1]}
    rows = [(len(s or "z") * 10 + i % 3, "w " * n, "en", s) for s, each in sizes.items() for i, n in enumerate(each)]
    docs = documents(rows + [(None, "no id here", "en", "b"), (None, None, "en", "f")])
    compare(mixing.mix(docs), in_duck(docs).execute(registry.ORACLES["op10_mixing"]))
