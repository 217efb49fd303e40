"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

n-grams of the lower-cased UTF-8 text are hashed to a fixed number of features. Counts by label over all training
rows give each feature's log-count ratio r; a logistic regression is then fitted on the presence of features times r.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WindowHash, text_or_empty, write_shared

BITS = 18
GRAMS = (4, 5, 6)


class GramReader:
    """Distinct hashed n-grams of one text after another."""

    def __init__(self, grams: Sequence[int] = GRAMS, bits: int = BITS):
        self.grams, self.shift = grams, np.uint64(64 - bits)
        self.last = np.zeros(1 << bits, np.int64)
        self.table = np.arange(256, dtype=np.uint8)
        self.table[65:91] += 32  # A-Z to a-z; line ends and tabs to blanks
        self.table[9:14] = 32

    def __call__(self, text: str) -> np.ndarray:
        data = self.table[np.frombuffer(f" {text} ".encode(), np.uint8)]
        windows = WindowHash(data)
        ids = np.concatenate([(windows.every(n) >> self.shift).astype(np.int64) for n in self.grams])
        at = np.arange(len(ids))
        self.last[ids] = at  # a feature counts where it stands last
        return ids[self.last[ids] == at]


def _log_odds(counts: DataFrame, rows: tuple[int, int], smooth: float, bits: int) -> np.ndarray:
    """Log-count ratio of each feature; counts has a row for each feature seen, 2**bits at most."""
    seen = np.zeros((2, 1 << bits))
    for feature, clean, toxic in counts.select("feature", "clean", "toxic").toPandas().itertuples(index=False):
        seen[:, feature] = clean, toxic
    share = [(seen[k] + smooth) / (rows[k] + 2 * smooth) for k in (0, 1)]
    return np.log(share[1] / share[0])


def count_features(train: DataFrame, grams: Sequence[int] = GRAMS, bits: int = BITS) -> DataFrame:
    """feature, clean, toxic: the number of training texts (text, label 0/1) of each kind that hold the feature."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, n = GramReader(grams, bits), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                n[label, read(text)] += 1
        f = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"feature": f, "clean": n[0, f], "toxic": n[1, f]})

    return train.mapInPandas(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_linear(texts: Sequence[str], labels: np.ndarray, ratio: np.ndarray, grams: Sequence[int], bits: int, rounds: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a logistic regression on presence times ratio, both labels weighing the same.

    Full gradients with Nesterov's momentum; steps by each feature's own curvature bound keep it stable.
    """
    read = GramReader(grams, bits)
    ids = [read(t).astype(np.int32) for t in texts]
    sizes = np.array([len(i) for i in ids])
    starts, flat = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate(ids)
    row_of = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    weigh = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    # norm of the rows bounds the curvature
    norm = np.bincount(row_of, (ratio[flat] ** 2), len(ids)) + 1.0
    step = 4.0 / (weigh * norm).sum()
    w, b = np.zeros(len(ratio)), 0.0
    pw, pb = w.copy(), b
    for k in range(rounds):
        m = k / (k + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        scaled = yw * ratio
        z = np.add.reduceat(scaled[flat], starts) + yb
        g = weigh * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        grad = np.bincount(flat, g[row_of], len(ratio)) * ratio + l2 * yw
        pw, pb, w, b = w, b, yw - step * grad, yb - step * g.sum()
    return np.append(w * ratio, b)


def fit(labelled: DataFrame, grams: Sequence[int] = GRAMS, bits: int = BITS, sample_rows: int = 1500, sample_bytes: int = 8 << 20, smooth: float = 1.0) -> np.ndarray | None:
    """Feature weights with the bias last, from text and label (0/1); None if a label has no rows to fit on.

    The counts behind the log-count ratios cover all rows. The linear part is fitted on a bounded sample of whole
    texts, in one task: of each label the different texts with the smallest hashes, sample_rows and sample_bytes at
    most, none longer than a sixteenth of sample_bytes. Copies count once there, so no group of them fills the sample,
    and hashes and lengths are chosen by before any text moves. A label whose texts are all longer than that leaves no
    sample, and there is no model, as without rows of it.
    """
    labelled = labelled.select(text_or_empty().alias("text"), F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    labelled = write_shared(labelled, "toxicity-train")
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    ratio = _log_odds(count_features(labelled, grams, bits), (n[0], n[1]), smooth, bits)
    hashed = labelled.withColumn("text_hash", F.xxhash64("text"))
    keys = hashed.groupBy("label", "text_hash").agg(F.max(F.octet_length("text")).cast("long").alias("bytes")).where(F.col("bytes") <= sample_bytes // 16)
    picked = [keys.where(F.col("label") == k).orderBy("text_hash").limit(sample_rows) for k in (0, 1)]
    upto = F.sum("bytes").over(Window.partitionBy("label").orderBy("text_hash"))  # over 2 * sample_rows hashes at most
    picked = F.broadcast(picked[0].unionByName(picked[1]).withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("label", "text_hash"))
    sample = hashed.join(picked, ["label", "text_hash"]).groupBy("label", "text_hash").agg(F.min("text").alias("text"))

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["label", "text"])
        if sample["label"].nunique() < 2:
            return pd.DataFrame({"weights": []})
        w = fit_linear(sample["text"].tolist(), sample["label"].to_numpy(), ratio, grams, bits)
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()]})

    found = sample.select("label", "text", F.lit(0).alias("one")).groupBy("one").applyInPandas(train, "weights binary").first()
    return np.frombuffer(found["weights"], "<f4").astype(np.float64) if found else None


def score(docs: DataFrame, weights: np.ndarray | None, grams: Sequence[int] = GRAMS, bits: int = BITS, columns: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """The columns, and score: the probability of label 1, for each row. Null text: as empty. No model: 0.5."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read, w = GramReader(grams, bits), None if weights is None else weights
        for texts in batches:
            if w is None:
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                z = np.array([w[read(t)].sum() for t in texts]) + w[-1]
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    probability = F.pandas_udf(run, "double")
    return docs.select(*columns, probability(text_or_empty()).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, broadcast_rows: int = 2_000_000, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Labels (doc_id, toxic) are learned from rows whose crc32(doc_id as text) mod folds is not 0; the others are held
    out. Nothing but the text enters a score. Null or empty text: a score as well, from the bias. Null labels are not
    learned from; of repeated labels of a document the largest counts. Repeated documents: equal scores. A null doc_id
    has no label and is not held out. With no label rows of one kind, or none short enough to fit on, every score is
    0.5. Very long texts are scored whole, one at a time. Extra columns do not matter. The labels are broadcast to the
    texts only if they are counted to be few (broadcast_rows); else the join shuffles.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = write_shared(known, "toxicity-labels")
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    train = docs.select("doc_id", "text").where(~held).join(known, "doc_id")
    weights = fit(train, **options)
    use = {k: v for k, v in options.items() if k in ("grams", "bits")}
    out = score(docs, weights, columns=("doc_id", held.alias("held_out")), **use)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
