"""Document fingerprints: digests of improbable features, compared by the bits that they share.

Every window of 64 bytes is a possible feature. Windows are ranked by how rare their entropy is in the corpus; those
that lead their neighbours often enough are selected and inserted into a chain of Bloom filters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WindowHash, sliding_min, text_or_empty, write_shared

WINDOW = 64
BINS = 1024
#: Windows of fewer bits of entropy a byte than this are runs of a few bytes and never selected.
LEAST_BITS = 1.0
_COUNT_BITS = np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)])
_STEP = np.round(np.diff(_COUNT_BITS) * (1 << 20)).astype(np.int64)
_CHUNK = 1 << 19


def _entropy_bins(data: np.ndarray) -> np.ndarray:
    """Bin of the entropy of each 64-byte window, by start: whole numbers all through, so a window has one bin anywhere.

    As the window moves, the byte that comes and the byte that goes change c*log2(c) by a step that depends on how
    often they stand among the other 63.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        back[d:] += same
        ahead[:-d] += same
    change = _STEP[back]
    change[WINDOW:] -= _STEP[ahead[:-WINDOW]]
    total = np.cumsum(change)[WINDOW - 1 :]  # sum of c*log2(c), scaled; 64 * 6 at most
    return np.minimum(((384 << 20) - total) * BINS // (384 << 20), BINS - 1)


def _joined(texts: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, starts) of runs of whole texts of about half a MB each."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _CHUNK):
            size += len(texts[last])
            last += 1
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[first:last]])])
        yield first, np.frombuffer(b"".join(texts[first:last]), np.uint8), starts
        first = last


def _inside(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of each window by start: does it lie within one text?"""
    ends = np.repeat(starts[1:], np.diff(starts))
    return np.arange(n) + width <= ends[:n]


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy bin, rarest first, over all 64-byte windows of all texts: a fixed number of rows to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, data, starts in _joined([t.encode() for t in batch["text"]]):
                bins = _entropy_bins(data)
                n += np.bincount(bins[_inside(starts, WINDOW, len(bins))], minlength=BINS)
        yield pd.DataFrame({"bin": np.arange(BINS), "n": n})

    seen = np.zeros(BINS, np.int64)
    for row in docs.select(text_or_empty().alias("text")).mapInPandas(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[row["bin"]] = row["n"]
    rank = np.empty(BINS, np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(BINS)
    rank[: int(LEAST_BITS / 6 * BINS)] = BINS  # never selected
    return rank


def digests(texts: Sequence[bytes], rank: np.ndarray, lead: int = 16, near: int = 64, per_filter: int = 160) -> list[np.ndarray]:
    """Bloom filters (n x 256 bytes) of each text.

    A window is selected if it is the rarest (of equals the first) in at least lead of the runs of near windows that
    hold it. A text without such a window gives its rarest one (of low entropy, if there is no other), one shorter
    than a window its whole, an empty text nothing. Each filter takes the next per_filter features, five bits of 2048 each.
    """
    out: list[np.ndarray] = []
    for first, data, starts in _joined(texts):
        count = len(starts) - 1
        hashes = WindowHash(data)
        bins = _entropy_bins(data)
        owner, value = [], []
        if len(bins):
            ok = _inside(starts, WINDOW, len(bins))
            r = np.where(ok, rank[bins], BINS + 1)
            packed = (r << 32) | np.arange(len(r))
            if len(packed) >= near:
                whole = _inside(starts, WINDOW + near - 1, len(packed) - near + 1)
                leaders = sliding_min(packed, near)[whole]
                at, led = np.unique(leaders[leaders < (BINS << 32)] & 0xFFFFFFFF, return_counts=True)
                at = at[led >= lead]
                owner.append(np.searchsorted(starts, at, "right") - 1)
                value.append(hashes.value(at, at + WINDOW))
        bare = np.diff(starts) > 0
        if owner:
            bare[owner[0]] = False
        for k in np.flatnonzero(bare):
            a, b = starts[k], starts[k + 1]
            if b - a >= WINDOW:
                a = a + int(np.argmin(rank[bins[a : b - WINDOW + 1]]))
                b = a + WINDOW
            owner.append(np.array([k]))
            value.append(hashes.value(np.array([a]), np.array([b])))
        if not owner:
            out += [np.zeros((0, 256), np.uint8)] * count
            continue
        owner, value = np.concatenate(owner), np.concatenate(value)
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
        n_of = np.bincount(owner, minlength=count)
        ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        filters_of = -(-n_of // per_filter)
        base = np.cumsum(filters_of) - filters_of
        bits = np.zeros((int(filters_of.sum()), 2048), bool)
        for j in range(5):
            bits[base[owner] + ordinal // per_filter, ((value >> np.uint64(11 * j)) & np.uint64(2047)).astype(np.int64)] = True
        filters = np.packbits(bits, axis=1)
        out += [filters[base[k] : base[k] + filters_of[k]] for k in range(count)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0..1: shared bits over what chance gives, normalised by the most that could be shared.

    Each filter of the shorter chain counts by its best match in the longer one, weighed by its bits; of chains of one
    length both ways are averaged. Two empty fingerprints are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    shared = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(2)
    chance = na[:, None] * nb[None, :] / 2048
    room = np.minimum(na[:, None], nb[None, :]) - chance
    score = np.clip(np.where(room > 0, (shared - chance) / np.where(room > 0, room, 1), 0), 0, 1)
    ways = []
    if len(a) <= len(b):
        ways.append((score.max(1) * na).sum() / na.sum())
    if len(b) <= len(a):
        ways.append((score.max(0) * nb).sum() / nb.sum())
    return float(np.mean(ways))


def _shown(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, rows_per_block: int = 4096, most_blocks: int = 20_000) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likeness to each other and to the next document.

    The edited text has the last half of the code points replaced by as many of the next document, in descending
    order of doc_id (null last; of one doc_id by text), after the last the first. Null text: empty. Rows are dealt by
    ranges of doc_id and streamed in order within a range; the head of each range also goes to the end of the one
    before, so no range sees more than its own rows and its neighbour's head. Only the heads' ids reach the driver, as
    many as there are ranges (most_blocks at most). Repeated rows follow one another. Empty table: no rows.
    """
    low = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text_or_empty().alias("text"))
    rank = entropy_ranks(docs)
    blocks = int(min(most_blocks, -(-docs.count() // rows_per_block)))
    cut = rows.agg(F.percentile_approx("doc_id", [(k + 1) / blocks for k in range(blocks)], max(10_000, 20 * blocks)).alias("h")).first()["h"] if blocks else []
    heads = np.array(sorted(set(cut or [])), np.int64)

    @F.pandas_udf("array<struct<block:int,guest:int>>")
    def places(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(heads, ids.to_numpy())  # heads[at - 1] < id <= heads[at]
        last = len(heads) - 1
        return pd.Series([[(int(k), 0)] + ([(int(k + 1) if k < last else 0, 1)] if heads[k] == i else []) for k, i in zip(at, ids)])

    dealt = rows.select("doc_id", "no_id", "text", F.explode(places("doc_id")).alias("p")).select("doc_id", "no_id", "text", "p.block", "p.guest")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "guest", F.col("doc_id").desc(), "no_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: list[tuple] = []  # the last row, whose next one is not there yet
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                fresh = list(zip(part["doc_id"], part["no_id"], part["text"], part["block"], part["guest"], digests([t.encode() for t in part["text"]], rank)))
                rows = carried + fresh
                carried = rows[-1:]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[3] == b[3] and not a[4]]
                if not pairs:
                    continue
                edited = []
                for a, b in pairs:
                    half = len(a[2]) // 2
                    edited.append((a[2][: len(a[2]) - half] + b[2][:half]).encode())
                of_edited = digests(edited, rank)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if a[1] else a[0] for a, _ in pairs], "Int64"),
                        "n_chars": [len(a[2]) for a, _ in pairs],
                        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                        "fingerprint": [_shown(a[5]) for a, _ in pairs],
                        "edited_fingerprint": [_shown(e) for e in of_edited],
                        "near_edited": [likeness(a[5], e) for (a, _), e in zip(pairs, of_edited)],
                        "near_next": [likeness(a[5], b[5]) for a, b in pairs],
                    }
                )

    return dealt.mapInPandas(run, _RESULT)
