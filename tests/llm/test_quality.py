import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm.quality import _UNIT, assess, discounts, drawn, log_perplexity, probabilities, train, without_rejected


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in texts:
        b = bytes(order - 1) + t.encode()
        for i in range(len(b) - order + 1):
            counts[order][b[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = []
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        d = discounts(n[1], n[2], n[3], n[4])
        total, back = defaultdict(int), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            back[g[:-1]] += d[min(c, 3) - 1]
        tables.append((counts[k], d, total, back))

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        c, d, total, back = tables[k - 1]
        h = g[:-1]
        low = p(g[1:])
        if h not in total:
            return low
        return (c[g] - d[min(c[g], 3) - 1] if c[g] else 0) / total[h] + back[h] / total[h] * low

    return p


def prose(seed, n):
    rnd = random.Random(seed)
    words = ["the", "river", "and", "stone", "wind", "éclat", "over", "light", "house", "of"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


def test_probabilities_equal_the_definition(spark, documents):
    texts = prose(1, 40)
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    p = brute_model(texts, 3)
    asked = ["the", "he ", "zzz", "wi\x00", "é", " lt", "hzq"]
    codes = [int.from_bytes(a.encode()[:3].rjust(3, b"\0"), "big") for a in asked]
    got = {r["gram"]: r["log_p"] for r in probabilities(spark.createDataFrame([(c,) for c in set(codes)], "gram long"), model).collect()}
    for a, c in zip(asked, codes):
        assert math.isclose(got[c] * _UNIT, math.log(p(a.encode()[:3].rjust(3, b"\0"))), rel_tol=1e-5)
    # probabilities of all bytes after a context add up to one
    for context in (b"th", b"zz", b"\0\0"):
        assert math.isclose(sum(p(context + bytes([x])) for x in range(256)), 1, rel_tol=1e-9)


def test_document_sums_equal_the_definition(spark, documents):
    texts = prose(2, 30)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100, "", "en"), (101, None, "fr"), (102, "日本語 text", "ja")]
    model = train(spark.createDataFrame([(t,) for t in texts[:20]], "text string"), 4)
    p = brute_model(texts[:20], 4)
    for r in log_perplexity(documents(rows), model, block_bytes=900).collect():
        b = bytes(3) + (dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "").encode()
        want = -sum(math.log(p(b[i : i + 4])) for i in range(len(b) - 3))
        assert r["n_bytes"] == len(b) - 3 and math.isclose(r["nll"], want, rel_tol=1e-4, abs_tol=1e-9)


def test_discounts_are_between_nothing_and_the_count():
    for n in ((10, 5, 5, 100), (1, 10, 100, 1), (5, 0, 1, 1), (1, 100, 1, 1), (100, 40, 20, 10), (0, 0, 0, 0)):
        assert all(0 < d < k + 1 for k, d in enumerate(discounts(*n)))


def test_an_unseen_gram_after_frequent_ones_spoils_no_score(spark, documents):
    """Most counts are 4, so that the discount of 3 or more would be under 0; texts with unseen n-grams stand among others."""
    often = [1, 2, 3, *[4] * 20]
    words = [chr(0x41 + 2 * i) + chr(0x42 + 2 * i) for i in range(len(often))]
    texts = [w for w, n in zip(words, often) for _ in range(n)]
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"), 2)
    p = brute_model(texts, 2)
    rows = [(i, words[i % len(words)] + ("~" if i % 3 == 0 else words[5]), "en") for i in range(60)]
    for r in log_perplexity(documents(rows), model).collect():
        b = bytes(1) + rows[r["doc_id"]][1].encode()
        want = -sum(math.log(p(b[i : i + 2])) for i in range(len(b) - 1))
        assert r["nll"] is not None and math.isclose(r["nll"], want, rel_tol=1e-4)


def test_junk_goes_and_prose_stays(spark, documents):
    rnd = random.Random(5)
    good = [(i, t, "en") for i, t in enumerate(prose(6, 300))]
    junk = [(1000 + i, "".join(chr(rnd.randrange(33, 126)) for _ in range(300)), "en") for i in range(20)]
    docs = documents(good + junk)
    trusted = spark.createDataFrame([(i,) for i in range(0, 200)], "doc_id long")
    kept = {r["doc_id"] for r in without_rejected(docs, trusted).collect()}
    assert kept == {i for i, _, _ in good}
    assert without_rejected(docs, trusted).columns == docs.columns


def test_defined_results_for_odd_rows(spark, edge, nothing):
    trusted = spark.createDataFrame([(1,), (4,), (5,), (None,)], "doc_id long")
    rows = assess(edge, trusted).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["keep"] and by[2]["keep"] and by[1]["perplexity"] == 1.0
    assert assess(nothing, trusted).count() == 0
    none = trusted.where(F.lit(False))
    assert all(r["keep"] for r in assess(edge, none).collect())


def test_held_out_good_documents_stay_in_every_language(spark):
    sf = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = assess(docs, labels.where("quality = 1").where(~held)).join(labels.where(held), "doc_id")
    rate = {(r["quality"], r["lang"]): r["rate"] for r in found.groupBy("quality", "lang").agg(F.avg((~F.col("keep")).cast("int")).alias("rate")).collect()}
    assert {lang for _, lang in rate} == {"de", "en", "es", "fr"}
    assert all(r <= 0.05 for (quality, _), r in rate.items() if quality == 1), rate
    assert all(r >= 0.75 for (quality, _), r in rate.items() if quality == 0), rate


def test_few_judges_reject_nothing_that_many_would_not(spark, documents):
    """One, two or five judges in a language do not set its threshold alone; a pool of as few rejects nothing."""
    assert drawn(1.0, 0, 3.0, 5.0) == 3.0 and drawn(None, 0, 3.0, 5.0) == 3.0 and drawn(1.0, 5, 3.0, 5.0) == 2.0 and drawn(1.0, 3, None, 5.0) == 1.0
    many, foreign = prose(8, 400), [t.replace("e", "ø").replace("o", "y") for t in prose(9, 60)]
    repeated = "word " * 3_000  # a judge as easy as none, that would let nothing else pass
    for n in (1, 2, 5):
        rows = [(i, t, "en") for i, t in enumerate(many)] + [(1_000 + i, t, "fø") for i, t in enumerate(foreign)] + [(2_000 + i, repeated + str(i), "fø") for i in range(60)]
        trusted = [*range(300), *range(1_000, 1_040), *range(2_000, 2_000 + 5 * n)]
        kept = {r["doc_id"] for r in without_rejected(documents(rows), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
        assert len([i for i in range(1_040, 1_060) if i in kept]) >= 19 and len([i for i in range(300, 400) if i in kept]) >= 97
        alone = assess(documents([r for r in rows if r[2] == "fø"]), spark.createDataFrame([(2_000 + i,) for i in range(n)], "doc_id long"))
        assert alone.where("not keep").count() == 0


def test_batches_change_no_row(spark):
    sf = "/root/testdata/sf0.01"
    docs, trusted = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    name, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    try:
        for rows in ("37", "5000"):
            spark.conf.set(name, rows)
            found.append(sorted(map(tuple, assess(docs, trusted).collect())))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1]


def test_an_order_is_one_join(spark):
    """One table an order, so few exchanges at once: the driver holds a broadcast and threads for each."""
    model = train(spark.createDataFrame([(t,) for t in prose(4, 30)], "text string"), 4)
    plan = probabilities(spark.range(5).selectExpr("id + 97 gram"), model)._jdf.queryExecution().optimizedPlan().toString()
    assert len(model) == 4 and plan.count("Join ") == 4
