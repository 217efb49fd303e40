import re

import corpus_pipeline
from tidemark.llm import registry
from tidemark.llm.registry import PIECE_MODEL
from tests.llm.test_near_dedup import brute as near_classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == columns
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert bad <= {r["doc_id"] for r in kept.collect()}  # what is trusted stays
    once = corpus_pipeline.drop_near_copies(spark, docs, SF)
    want = set(near_classes([(r["doc_id"], r["text"]) for r in rows]).values())
    assert once.columns == columns and {r["doc_id"] for r in once.collect()} == want
    clean = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert clean.columns == columns and clean.count() == len(rows)
    assert not [r for r in clean.collect() if re.search(r"[0-9a-f]{32,}", r["text"])]
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    words = sum(len(r["text"].split()) for r in rows)
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) / words - 1.5) < 0.2


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == docs.columns
    key = lambda r: (r["doc_id"], r["text"], r["n_pieces"])
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_stages_take_odd_tables(spark, edge, nothing):
    """Nulls, empty and very long texts, repeated rows, columns with names that operators use, and an empty table."""
    docs = edge.withColumnRenamed("size", "taken").withColumnRenamed("node", "_id").withColumnRenamed("block", "ids")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        last = name.startswith("SentencePiece")
        assert last or out.columns == docs.columns
        n = out.count()
        assert n == 9 if name.startswith(("quality", "secret", "Sentence")) else 0 < n <= 18
        assert stage(spark, nothing, SF).count() == 0


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert PIECE_MODEL.endswith(".model")
