import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, score string, position string, block string"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents from (doc_id, text) or more, with extra columns whose names operators use themselves."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *[None] * (4 - len(r)))[:4] if len(r) < 4 else r[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", "p", "b"))
        return spark.createDataFrame(full, DOCS)

    return make


EDGE_ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (None, "a text without an id", "en", None), (4, "twice the same row", "en", "b"), (4, "twice the same row", "en", "b"),
    (5, "word " * 30_000, "en", "b"), (6, "x" * 50_000, "de", "b"), (7, "ünïcödé 日本語 🎉 text", "ja", "c"),
]


@pytest.fixture(scope="session")
def edge(documents):
    """Nulls, empty, white space, repeated rows, very long texts."""
    return documents(EDGE_ROWS)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([]).limit(0)
