"""Quality: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over UTF-8 bytes, which suit every language. Its counts are tables keyed by n-gram, built and joined by
Spark; no task holds the whole model. Documents are dealt into blocks; a block asks the tables for its own distinct
n-grams and sums their log-probabilities document by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, text_slices, write_shared

ORDER = 5
FOLDS = 5
_CHUNK = 1 << 18
#: Log-probabilities are whole numbers of this part of a nat: sums are exact, whatever the order of rows and batches.
_UNIT = 2.0**-26


def gram_codes(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram codes, lengths in bytes) of runs of texts: one n-gram ends at each byte, order - 1 zero bytes come before a text."""
    at = 0
    while at < len(texts):
        parts, lengths, size = [], [], 0
        while at < len(texts) and (not size or size + len(texts[at]) <= _CHUNK):
            raw = texts[at]
            parts.append(bytes(order - 1) + raw)
            lengths.append(len(raw))
            size += len(raw) + order - 1
            at += 1
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        codes = np.zeros(max(0, len(data) - order + 1), np.int64)
        for k in range(order):
            codes = (codes << 8) | data[k : k + len(codes)]
        lengths = np.array(lengths)
        starts = np.cumsum(lengths + order - 1) - lengths - (order - 1)
        inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        yield codes[inside], lengths


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n over all the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sums() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], ["gram", "n"])
                held.clear()

        for _, part in text_slices(batches):
            held += [np.unique(codes, return_counts=True) for codes, _ in gram_codes(part, order)]
            if len(held) >= 16:
                held[:] = [_merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield from sums()
        yield from sums()

    return texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(back, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more.

    Half a count and so on where they are undefined or not between 0 and the count: a discount of 0 would leave nothing
    to the lower order, and unseen n-grams without a probability.
    """
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 0.75, 1.0


def train(texts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For each order from 1: context, kept (of each byte that follows it, its count less the discount), total and back.

    The probability of a gram is its byte's share of total in kept plus back of its context times the probability one
    order lower; uniform over bytes at order 0. Orders below the highest count the distinct bytes that come before a
    gram. A context is one row with at most 256 bytes in it, so that a gram meets its order in one join.
    """
    counts, model = write_shared(count_grams(texts, order), "quality-counts"), []
    for k in range(order, 0, -1):
        if k < order:
            counts = write_shared(counts.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(F.count("*").alias("n")), "quality-counts")
        seen = {r["n"]: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
        d = discounts(*(seen.get(i, 0) for i in (1, 2, 3, 4)))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c = counts.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n", cut.alias("cut"))
        kept = F.map_from_entries(F.collect_list(F.struct("byte", F.col("n") - F.col("cut"))))
        model.append(c.groupBy("context").agg(kept.alias("kept"), F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("back")))
    return model[::-1]


def probabilities(grams: DataFrame, model: list[DataFrame]) -> DataFrame:
    """gram, log_p (natural, in units of 2**-26) of distinct grams of the highest order, by a join with each order's contexts."""
    q = grams.withColumn("p", F.lit(1 / 256))
    for k, contexts in enumerate(model, 1):
        if k <= 2:  # 1 and 256 contexts at most, whatever the corpus; by their keys a task would get a large share of the grams
            contexts = F.broadcast(contexts)
        q = q.withColumn("context", F.shiftright(F.col("gram").bitwiseAND(F.lit(_mask(k))), 8)).join(contexts, "context", "left")
        part = F.try_element_at("kept", F.col("gram").bitwiseAND(F.lit(255)).cast("int")) / F.col("total")
        q = q.select("gram", (F.coalesce(part, F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
    return q.select("gram", F.round(F.log("p") / _UNIT).cast("long").alias("log_p"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each block within a batch as one compressed Arrow stream: texts cross the network at a third of their size."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        at, blocks, streams = batch.column("block").to_numpy(), [], []
        order = np.argsort(at, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
            sink = pa.BufferOutputStream()
            rows = batch.take(pa.array(part)).drop_columns(["block"])
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows)
            blocks.append(at[part[0]])
            streams.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(streams, pa.binary())], ["block", "rows"])


def _unpack(packed: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for stream in packed["rows"]:
        yield pa.ipc.open_stream(stream).read_all().to_pandas(integer_object_nulls=True)


def log_perplexity(docs: DataFrame, model: list[DataFrame], block_bytes: int = 24 << 20, keys: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The keys, n_bytes and nll (negative log-likelihood, natural) of each row. Null or empty text: 0 and 0.

    Rows are dealt into blocks of about block_bytes bytes of text by the hash of id and text.
    """
    order, text = len(model), text_or_empty()
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int")
    dealt = docs.select(*keys, text.alias("text"), block.alias("block"))
    dealt = dealt.mapInArrow(_pack, "block int, rows binary").repartition(blocks, "block")

    def asked(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.zeros(0, np.int64)]
        for rows in _unpack(pdf):
            for codes, _ in gram_codes([t.encode() for t in rows["text"]], order):
                held.append(np.unique(codes))
                if len(held) == 16:
                    held = [np.unique(np.concatenate(held))]
        grams = np.unique(np.concatenate(held))
        return pd.DataFrame({"block": np.full(len(grams), pdf["block"].iloc[0], np.int32), "gram": grams})

    needs = write_shared(dealt.groupBy("block").applyInPandas(asked, "block int, gram long"), "quality-needs")
    known = needs.join(probabilities(needs.select("gram").distinct(), model), "gram").select("block", "gram", "log_p")

    def add_up(packed: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if table["log_p"].isna().any():
            raise ValueError("an n-gram has no probability")
        order_of = np.argsort(table["gram"].to_numpy())
        grams, log_p = table["gram"].to_numpy()[order_of], table["log_p"].to_numpy()[order_of].astype(np.int64)
        out = [pd.DataFrame(columns=[*keys, "n_bytes", "nll"])]
        for rows in _unpack(packed):
            sums, sizes = [], []
            for codes, lengths in gram_codes([t.encode() for t in rows["text"]], order):
                ends = np.cumsum(lengths)
                total = np.concatenate([[0], np.cumsum(log_p[np.searchsorted(grams, codes)])])
                sums.append(total[ends] - total[ends - lengths])
                sizes.append(lengths)
            out.append(rows[list(keys)].assign(n_bytes=np.concatenate(sizes), nll=-_UNIT * np.concatenate(sums)))
        return pd.concat(out[1:], ignore_index=True) if len(out) > 1 else out[0]

    types = dict(docs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", n_bytes long, nll double"
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(add_up, schema)


def assess(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = 0.98, slack: float = 0.1, prior_bytes: int = 200, prior_judges: float = 5.0, broadcast_rows: int = 2_000_000, folds: int = FOLDS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte), score, threshold, keep, text_hash for each row of docs.

    trusted: doc_ids of text of good quality. One in folds of it, by the hash of the text so that copies lie together,
    is not learned from but judges: medians and quantiles are of its scores, which are out of sample as those of most
    documents are; the model is counted on the others. (Where one of the two parts is empty, all of it does both.)
    score is the log-perplexity, drawn towards the language's median as if prior_bytes bytes more had it, so that a
    short text is not judged by a few bytes. A document is rejected if its score is over the language's quantile plus
    slack times the median; both are drawn towards those of all judges as if prior_judges judges more had these, and the
    quantile of all towards HIGHEST. So languages without judges go by all judges, and few judges reject little. A null language is one of its own. Null or empty text: perplexity 1, kept. Nothing trusted: everything is kept. Repeated rows: equal results. Very long texts
    are judged whole. Empty table: no rows. Extra columns do not matter.

    The ids of trusted rows are broadcast only if they are counted to be few (broadcast_rows); else the join shuffles.
    """
    ids = write_shared(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "quality-trusted")
    small = ids.count() <= broadcast_rows
    marks = ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_trusted"))
    held = docs.select("doc_id", "lang", "text", F.xxhash64(text_or_empty()).alias("text_hash"))
    held = held.join(F.broadcast(marks) if small else marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    # 0 judges, the others learn; the seed of the hash is not that of the blocks
    held = held.select("doc_id", "lang", "text", "text_hash", F.when(F.col("_trusted"), F.pmod(F.xxhash64(F.lit("fold"), "text_hash"), F.lit(folds))).cast("int").alias("fold"))
    if not small:
        held = write_shared(held, "quality-marked")  # the join shuffles the texts: once
    judges, learners = held.where("fold is not null and text <> ''").agg(F.count_if(F.col("fold") == 0), F.count_if(F.col("fold") > 0)).first()
    both = judges and learners
    learn = held.where("fold > 0" if both else "fold is not null").select(text_or_empty().alias("text"))
    scores = write_shared(log_perplexity(held, train(learn, order), keys=("doc_id", "lang", "text_hash", "fold")), "quality-scores")

    rate = F.when(F.col("n_bytes") > 0, F.col("nll") / F.col("n_bytes"))
    good = scores.where("fold = 0" if both else "fold is not null").where("n_bytes > 0")
    # A row a language: few. Medians first, for the score depends on them.
    median = _drawn(good, rate, 0.5, prior_judges)
    score = F.coalesce((F.col("nll") + prior_bytes * median) / (F.col("n_bytes") + prior_bytes), F.lit(0.0))
    threshold = _drawn(good.withColumn("score", score), F.col("score"), quantile, prior_judges, HIGHEST) + slack * median
    return scores.select(
        "doc_id", "lang", "n_bytes", F.exp(F.coalesce(rate, F.lit(0.0))).alias("perplexity"), score.alias("score"), threshold.alias("threshold"),
        F.coalesce((F.col("n_bytes") == 0) | (score <= threshold), F.lit(True)).alias("keep"), "text_hash",
    )


def without_rejected(docs: DataFrame, trusted: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """The rows of docs that assess() keeps, with all their columns."""
    gone = assess(docs, trusted, **options).where(~F.col("keep")).select(F.col("doc_id").alias("_tidemark_id"), F.col("text_hash").alias("_tidemark_hash")).distinct()
    gone = write_shared(gone, "quality-rejected")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_tidemark_id")) & (F.xxhash64(text_or_empty()) == F.col("_tidemark_hash")), "left_anti")


#: A log-perplexity a byte that no text is known to exceed: twice that of bytes drawn evenly.
HIGHEST = 2 * math.log(256)


def drawn(value: float | None, judges: int, towards: float | None, prior: float) -> float | None:
    """value of so many judges, drawn towards another as if prior judges more had that."""
    return towards if value is None else value if towards is None else (judges * value + prior * towards) / (judges + prior)


def _drawn(good: DataFrame, value: Column, quantile: float, prior: float, towards: float | None = None) -> Column:
    """The quantile of value for each language, drawn towards that of all, and that of all towards another; a row's by its lang."""
    found = F.percentile_approx(value, quantile, 10_000).alias("q"), F.count(value).alias("n")
    all_ = good.agg(*found).first()
    overall = drawn(all_["q"], all_["n"], towards, prior)
    by_lang = {r["lang"]: drawn(r["q"], r["n"], overall, prior) for r in good.groupBy("lang").agg(*found).collect()}
    out = F.lit(overall).cast("double")
    for lang, q in by_lang.items():
        out = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(q)).otherwise(out)
    return out
