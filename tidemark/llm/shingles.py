"""Word shingles of many texts at once, as hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from .common import WindowHash, mix64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x3C6EF372FE94F82B * k & (1 << 64) - 1 | 1) for k in range(64)]


def words_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.searchsorted(begin, start, "right") - 1, WindowHash(data).value(start, end)


def word_shingles(texts: Sequence[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle of this many words, in order. A text of fewer words, but one at least, is a shingle as a whole."""
    owner, word = words_of(texts)
    n = len(word)
    n_of = np.bincount(owner, minlength=len(texts)) if n else np.zeros(len(texts), int)
    first = np.cumsum(n_of) - n_of
    whole = max(0, n - words + 1)
    h = np.zeros(whole, np.uint64)
    for k in range(words):
        h += word[k : k + whole] * _ODD[k]
    ok = owner[:whole] == owner[words - 1 :] if whole else np.zeros(0, bool)
    owners, hashes = owner[:whole][ok], mix64(h[ok])
    short = np.flatnonzero((n_of > 0) & (n_of < words))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = n_of[short] > k
            extra[has] += word[first[short[has]] + k] * _ODD[k]
        owners, hashes = np.concatenate([owners, short]), np.concatenate([hashes, mix64(extra + n_of[short].astype(np.uint64))])
        order = np.argsort(owners, kind="stable")
        owners, hashes = owners[order], hashes[order]
    return owners, hashes


def multisets(owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of each text."""
    order = np.lexsort((hashes, owners))
    o, h = owners[order], hashes[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]) if len(o) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return o[at], h[at], np.diff(np.concatenate([at, [len(o)]]))


def in_chunks(texts: Sequence[bytes], size: int = 1 << 20) -> Iterator[tuple[int, Sequence[bytes]]]:
    """(number of the first, texts) of runs of whole texts of about this many bytes."""
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= size):
            held += len(texts[last])
            last += 1
        yield first, texts[first:last]
        first = last
