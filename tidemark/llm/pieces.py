"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch of texts are laid end to end and their suffixes sorted to the length of the longest piece; a
binary search per piece finds the range of its occurrences. Each occurrence is an edge from its first to its last
position; edges are sorted by end and relaxed in that order.

The models handled are of the BPE kind, whose result is not a shortest path by score. What makes an edge relax is
that its piece can follow the piece that the path to its start ends with: two pieces can be neighbours if merging
their text in order of the model's scores yields just them. A row of pieces is the model's encoding exactly if all
neighbours can be, so every position is reached by one edge at most, and the result equals the merging procedure's.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices
from .shingles import in_chunks

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNKNOWN_CHAR = 1 << 24
_NEVER = 1 << 40
#: Characters of new words that are matched at a time: their edges, about four a character, are in memory together.
WORD_CHARS = 1 << 16
#: Longer words are cut into sections of so many characters, which overlap by MARGIN on both sides.
SECTION, MARGIN = 512, 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = {5: 4, 1: 8}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    """Pieces, and what the neighbour test needs of them: how each piece is merged, and which pairs merge to what."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        rows = [dict(_fields(v)) for n, v in fields if n == 1]
        self.pieces = [r[1].decode() for r in rows]
        scores = [struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows]
        self.kinds = np.array([r.get(3, NORMAL) for r in rows], np.int8)
        trainer = next((dict(_fields(v)) for n, v in fields if n == 2), {})
        normal = next((dict(_fields(v)) for n, v in fields if n == 3), {})
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are handled")
        if normal.get(2):
            raise ValueError("only models that do not rewrite characters are handled")
        if (self.kinds == USER).any():
            raise ValueError("user-defined pieces are not handled")
        self.dummy_prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        if self.squeeze:
            raise ValueError("models that drop extra blanks are not handled")
        n = len(self.pieces)
        merged = [i for i in range(n) if self.kinds[i] in (NORMAL, UNUSED)]
        self.ids = {self.pieces[i]: i for i in merged}
        self.byte_ids = np.full(256, -1)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.unknown_id = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        # characters without a piece of their own that stand in others get numbers past the pieces
        alphabet = sorted({c for i in merged for c in self.pieces[i]})
        extra = [c for c in alphabet if c not in self.ids]
        self.symbols = self.pieces + extra
        known = self.ids | {c: n + k for k, c in enumerate(extra)}
        self.alphabet = np.array([ord(c) for c in alphabet])
        self.symbol_of = np.array([known[c] for c in alphabet])
        self.width = max(len(self.pieces[i]) for i in merged)
        by_score = sorted(merged, key=lambda i: -scores[i])
        m = len(self.symbols) + 1  # the last one stands for any unknown character
        self.rank = np.full(m, _NEVER)
        rank = 0
        for k, i in enumerate(by_score):
            rank += k > 0 and scores[i] != scores[by_score[k - 1]]
            self.rank[i] = rank
        keys, made = [], []
        for i in merged:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = known.get(p[:cut]), known.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * m + b)
                    made.append(i)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = np.array(keys)[order], np.array(made)[order]
        pairs = dict(zip(keys, made))
        self.left, self.right = np.full(m, -1), np.full(m, -1)
        self.whole = np.zeros(m, bool)  # pieces that merging their own text yields
        for s in range(len(self.symbols)):
            self.whole[s] = len(self.symbols[s]) == 1 if s >= n or self.kinds[s] in (NORMAL, UNUSED) else False
        for i in merged:
            p = self.pieces[i]
            if len(p) > 1:
                row, last = [known[c] for c in p], None
                while len(row) > 1:
                    best = min(((self.rank[c], k, c) for k in range(len(row) - 1) if (c := pairs.get(row[k] * m + row[k + 1])) is not None), default=None)
                    if best is None:
                        break
                    k, last = best[1], (row[best[1]], row[best[1] + 1])
                    row[k : k + 2] = [best[2]]
                if row == [i]:
                    self.whole[i], (self.left[i], self.right[i]) = True, last
        self.birth = np.where(self.left >= 0, self.rank, -1)
        #: Blanks only begin pieces, so what stands before a blank never merges with it.
        self.by_words = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in merged)
        coded = [i for i in merged if self.whole[i]]
        self.coded = np.array(coded)
        self.codes = np.zeros((len(coded), -(-self.width // 16) * 16), np.int64)
        self.lengths = np.array([len(self.pieces[i]) for i in coded])
        for row, i in enumerate(coded):
            self.codes[row, : self.lengths[row]] = np.searchsorted(self.alphabet, [ord(c) for c in self.pieces[i]]) + 2
        raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b stand after piece a?

        Undo the merges of both, the latest first: at each moment the symbols at the seam must not merge before the
        next merge that either of them takes part in. Of equal ranks the left one comes first.
        """
        m = len(self.rank)
        r, l = np.minimum(a, m - 1), np.minimum(b, m - 1)
        r_end, l_end = np.full(len(r), _NEVER), np.full(len(l), _NEVER)
        ok, on = np.ones(len(r), bool), np.arange(len(r))
        while len(on):
            key = r[on] * m + l[on]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.rank[self.pair_made[at]], _NEVER)
            bad = (rank < r_end[on]) & (rank <= l_end[on]) & (rank < _NEVER)
            ok[on[bad]] = False
            br, bl = self.birth[r[on]], self.birth[l[on]]
            go = ~bad & ((br >= 0) | (bl >= 0))
            on, br, bl = on[go], br[go], bl[go]
            undo = br > bl
            x, y = on[undo], on[~undo]
            r_end[x], r[x] = br[undo], self.right[r[x]]
            l_end[y], l[y] = bl[~undo], self.left[l[y]]
        return ok

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece number in coded) of every occurrence: suffixes sorted by 4, 8, 16 ... symbols, a range per piece."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(4, np.int64)])
        key = (padded[:n] << 48) | (padded[1 : n + 1] << 32) | (padded[2 : n + 2] << 16) | padded[3 : n + 3]
        codes, lengths = self.codes, self.lengths
        chunk = codes.reshape(len(codes), -1, 4)
        size = np.clip(lengths[:, None] - np.arange(0, codes.shape[1], 4), 0, 4)
        low = (chunk[:, :, 0] << 48) | (chunk[:, :, 1] << 32) | (chunk[:, :, 2] << 16) | chunk[:, :, 3]
        high = low + (np.int64(1) << (16 * (4 - size)))  # past the last key with this prefix
        span = 4
        while True:
            levels, rank = np.unique(key, return_inverse=True)
            # ranges of ranks that continue with each part of each piece
            low, high = np.searchsorted(levels, low), np.searchsorted(levels, high)
            low[size == 0], high[size == 0] = 0, len(levels)
            if low.shape[1] == 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - span)] = rank[span:]
            key = (rank << 32) | after
            a, b = slice(0, None, 2), slice(1, None, 2)
            more = size[:, b] > 0
            # the first part has to be one rank if a second follows
            fits = (high[:, a] - low[:, a] == 1) | ~more
            first, last = (low[:, a] << 32) + np.where(more, low[:, b], 0), np.where(more, (low[:, a] << 32) + high[:, b], high[:, a] << 32)
            low, high = np.where(fits, first, 0), np.where(fits, np.maximum(first, last), 0)
            size = size[:, a] + size[:, b]
            span *= 2
        order = np.argsort(rank, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(levels)))])
        a, b = bounds[low[:, 0]], bounds[np.maximum(high[:, 0], low[:, 0])]
        count = b - a
        piece = np.repeat(np.arange(len(count)), count)
        return order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)], piece


class _Sections(Sequence):
    """The sections of a word with their margins, cut when they are asked for."""

    def __init__(self, word: str, cores: list[tuple[int, int]]):
        self.word, self.cores = word, cores

    def __len__(self) -> int:
        return len(self.cores)

    def __getitem__(self, k):
        if isinstance(k, slice):
            return _Sections(self.word, self.cores[k])
        a, b = self.cores[k]
        return self.word[max(0, a - MARGIN) : b + MARGIN]


class Encoder:
    """Encodes texts by their words; words seen before are kept, up to a bound of their characters, beyond which those met once go."""

    _WORD = re.compile(r" +[^ ]*|[^ ]+")

    class _Index(dict):
        def __init__(self):
            self.fresh: list[str] = []

        def __missing__(self, word: str) -> int:
            self[word] = at = len(self)
            self.fresh.append(word)
            return at

    def __init__(self, model: PieceModel, most_chars: int = 2 << 20):
        self.model, self.most = model, most_chars
        self._clear()

    def _clear(self) -> None:
        self.index, self.chars = self._Index(), 0
        self.tokens, self.sizes, self.met = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _thin_out(self) -> None:
        keep = self.met > 1
        words = [w for w, k in zip(self.index, keep) if k]
        chars = sum(map(len, words))
        if chars > self.most / 2:
            self._clear()
            return
        self.index.clear()
        self.index.update((w, k) for k, w in enumerate(words))
        self.tokens, self.sizes, self.met = self.tokens[np.repeat(keep, self.sizes)], self.sizes[keep], np.zeros(len(words), np.int64)
        self.chars = chars

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if self.chars > self.most:
            self._thin_out()
        m, look = self.model, self.index.__getitem__
        words, counts = [], []
        for t in texts:
            t = t.replace(SPACE, " ")
            t = " " + t if t and m.dummy_prefix else t
            found = self._WORD.findall(t) if m.by_words else [t] if t else []
            words += map(look, found)
            counts.append(len(found))
        if self.index.fresh:
            fresh, at = self.index.fresh, np.array([len(w) for w in self.index.fresh])
            self.chars += int(at.sum())
            long = at > SECTION + MARGIN
            short = [w for w, over in zip(fresh, long) if not over]
            parts = [self._fall_back(*self._paths(part)) for _, part in in_chunks(short, WORD_CHARS)]
            tokens, sizes = (np.concatenate([*(p[k] for p in parts), np.zeros(0, t)]) for k, t in ((0, np.int32), (1, np.int64)))
            if long.any():
                parts, taken = np.split(tokens, np.cumsum(sizes)[:-1]) if len(sizes) else [], iter(range(len(sizes)))
                each = [self._fall_back(p := self._long_path(w), np.array([len(p)]))[0] if over else parts[next(taken)] for w, over in zip(fresh, long)]
                tokens, sizes = np.concatenate(each), np.array([len(e) for e in each])
            self.tokens, self.sizes = np.concatenate([self.tokens, tokens]), np.concatenate([self.sizes, sizes])
            fresh.clear()
        words = np.array(words, np.int64)
        self.met = np.concatenate([self.met, np.zeros(len(self.sizes) - len(self.met), np.int64)]) + np.bincount(words, minlength=len(self.sizes))
        starts, size = np.cumsum(self.sizes) - self.sizes, self.sizes[words] if len(words) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.tokens[np.repeat(starts[words] - total[:-1], size) + np.arange(total[-1])] if len(words) else self.tokens[:0]
        return np.split(ids, total[np.cumsum(counts)][:-1]) if counts else []

    def _long_path(self, word: str) -> np.ndarray:
        """Pieces of a word of any length: sections are encoded apart and joined where both paths have a bound.

        A row of pieces is the encoding if all neighbours can follow, so a seam is right if its two pieces can. Where
        no bound in the overlap passes, the right section is encoded again from a bound of the left one, which helps
        with runs of one pattern; where that does not, the two become one section.
        """
        m, n = self.model, len(word)
        sizes = np.array([len(s) for s in m.symbols])

        def placed(piece: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
            size = np.where(piece < len(sizes), sizes[np.minimum(piece, len(sizes) - 1)], 1)
            return piece, at + np.cumsum(size) - size

        def shared(left: tuple, right: tuple, end: int) -> np.ndarray:
            """(piece before, piece after, place) of the bounds that both paths have near end."""
            (p, s), (q, t) = left, right
            low = np.searchsorted(s, end - MARGIN)
            _, i, j = np.intersect1d(s[low:], t[: np.searchsorted(t, end + MARGIN)], assume_unique=True, return_indices=True)
            i += low
            i, j = i[i > 0], j[i > 0]
            return np.stack([p[i - 1], q[j], t[j]], 1)

        def first_good(pairs: np.ndarray) -> int | None:
            good = np.flatnonzero(m.can_follow(pairs[:, 0], pairs[:, 1]))
            return int(pairs[good[0], 2]) if len(good) else None

        cores = [(a, min(n, a + SECTION)) for a in range(0, n, SECTION)]
        while True:
            paths = []
            for at, part in in_chunks(_Sections(word, cores), WORD_CHARS):
                ids, count = self._paths(list(part))
                paths += [placed(piece, max(0, core[0] - MARGIN)) for core, piece in zip(part.cores, np.split(ids, np.cumsum(count)[:-1]))]
            met = [shared(a, b, core[1]) for a, b, core in zip(paths, paths[1:], cores)]
            pairs = np.concatenate([*met, np.zeros((0, 3), np.int64)])
            good = m.can_follow(pairs[:, 0], pairs[:, 1])
            which, first = np.unique(np.repeat(np.arange(len(met)), [len(x) for x in met])[good], return_index=True)
            bound: list[int | None] = [None] * len(met)
            for k, place in zip(which.tolist(), pairs[good][first, 2].tolist()):
                bound[k] = place
            changed = False  # is the left path another one than the bounds were looked up for?
            for k, core in enumerate(cores[:-1]):
                if changed:
                    bound[k] = first_good(shared(paths[k], paths[k + 1], core[1]))
                changed = bound[k] is None
                if changed:
                    start = paths[k][1]
                    at = int(start[min(np.searchsorted(start, core[1] - MARGIN), len(start) - 1)])
                    paths[k + 1] = placed(self._paths([word[at : cores[k + 1][1] + MARGIN]])[0], at)
                    bound[k] = first_good(shared(paths[k], paths[k + 1], core[1]))
            if None not in bound:
                cuts = [0, *bound, n]
                return np.concatenate([p[np.searchsorted(s, a) : np.searchsorted(s, b)] for (p, s), a, b in zip(paths, cuts, cuts[1:])])
            joined = [cores[0]]
            for core, place in zip(cores[1:], bound):
                if place is None:
                    joined[-1] = (joined[-1][0], core[1])
                else:
                    joined.append(core)
            cores = joined

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces end to end, number of pieces) of each word; characters without a piece have numbers past the pieces."""
        m = self.model
        points = np.frombuffer("\0".join([*words, ""]).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words])
        begin = np.cumsum(length + 1) - length - 1
        sep = begin + length
        at = np.minimum(np.searchsorted(m.alphabet, points), len(m.alphabet) - 1)
        known = m.alphabet[at] == points
        text = np.where(known, at + 2, 1)
        text[sep] = 0
        start, row = m.occurrences(text)
        start = start.astype(np.int32)
        piece, end = m.coded[row].astype(np.int32), start + m.lengths[row].astype(np.int32)
        del text, row
        # characters that are no piece are edges as well
        alone = ~known if not len(m.symbols) > len(m.pieces) else ~known | (m.symbol_of[at] >= len(m.pieces))
        alone[sep] = False
        odd = np.flatnonzero(alone).astype(np.int32)
        start, end = np.concatenate([start, odd]), np.concatenate([end, odd + 1])
        piece = np.concatenate([piece, np.where(known[odd], m.symbol_of[at[odd]], _UNKNOWN_CHAR + points[odd]).astype(np.int32)])
        word_at = begin[np.repeat(np.arange(len(words)), length + 1)].astype(np.int32)  # where the word of a place begins
        step = end - word_at[start]
        order = np.argsort(step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        del order
        first = start == word_at[start]
        last = np.full(len(points) + 1, -1)  # the piece that the path to a position ends with
        edge = np.concatenate([[0], np.flatnonzero(step[1:] != step[:-1]) + 1, [len(step)]]) if len(step) else [0]
        for a, b in zip(edge, edge[1:]):
            s, p, f = start[a:b], piece[a:b].astype(np.int64), first[a:b]
            before = last[s]
            good = f.copy()
            ask = np.flatnonzero(~f & (before >= 0))
            if len(ask):
                pair, back = np.unique((before[ask] << 25) | p[ask], return_inverse=True)
                good[ask] = m.can_follow(pair >> 25, pair & ((1 << 25) - 1))[back]
            last[end[a:b][good]] = p[good]
        sizes = np.array([len(s) for s in m.symbols])
        # back along the paths, all words at once
        n_of, parts, at_word = np.zeros(len(words), np.int64), [], np.flatnonzero(length > 0)
        here = sep[at_word]
        while len(at_word):
            p = last[here]
            parts.append((at_word, p))
            n_of[at_word] += 1
            here = here - np.where(p < len(sizes), sizes[np.minimum(p, len(sizes) - 1)], 1)
            on = here > begin[at_word]
            at_word, here = at_word[on], here[on]
        if not parts:
            return np.zeros(0, np.int64), n_of
        # the k-th from the end of a word
        owner, token = np.concatenate([w for w, _ in parts]), np.concatenate([p for _, p in parts])
        k = np.repeat(np.arange(len(parts)), [len(w) for w, _ in parts])
        slot = np.cumsum(n_of)[owner] - 1 - k
        ids = np.empty(len(token), np.int64)
        ids[slot] = token
        return ids, n_of

    def _fall_back(self, ids: np.ndarray, n_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes, or the unknown piece where the model has no bytes."""
        m = self.model
        odd = np.flatnonzero(ids >= len(m.pieces))
        if not len(odd):
            return ids.astype(np.int32), n_of
        grow, subs = np.ones(len(ids), np.int64), []
        for i in odd:
            c = m.symbols[ids[i]] if ids[i] < _UNKNOWN_CHAR else chr(ids[i] - _UNKNOWN_CHAR)
            sub = m.byte_ids[list(c.encode("utf-8", "replace"))] if m.byte_ids[0] >= 0 else np.array([m.unknown_id])
            subs.append(sub)
            grow[i] = len(sub)
        at = np.cumsum(grow) - grow
        out = np.repeat(ids, grow)
        for i, sub in zip(odd, subs):
            out[at[i] : at[i] + len(sub)] = sub
        owner = np.repeat(np.arange(len(n_of)), n_of)
        return out.astype(np.int32), np.bincount(owner, grow, len(n_of)).astype(np.int64)


def decode(model: PieceModel, ids: Sequence[np.ndarray]) -> list[str]:
    """Texts of token lists; bytes that form no character become U+FFFD."""
    counts = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int64)
    size = model.raw_size[flat]
    total = np.concatenate([[0], np.cumsum(size)])
    raw = model.raw[np.repeat(model.raw_at[flat] - total[:-1], size) + np.arange(total[-1])].tobytes()
    ends = total[np.concatenate([[0], np.cumsum(counts)])]
    out = []
    for a, b in zip(ends, ends[1:]):
        if model.dummy_prefix and raw[a : a + 1] == b" ":
            a += 1
        out.append(raw[a:b].decode("utf-8", "replace"))
    return out


def encode_documents(docs: DataFrame, model_path: str, keep: Sequence[str] = ("doc_id",), chunk_bytes: int = 1 << 20) -> DataFrame:
    """The columns in keep, then ids (the encoding), n_pieces, decoded_sha256 (of the UTF-8 of the decoded text) and round_trip for each row.

    round_trip: does decoding give the text again, U+2581 taken as the blank that the model takes it for? Null or empty
    text: no ids, round trip true. Very long texts, with blanks or without, are encoded whole in bounded work: new words
    by WORD_CHARS characters, long words by sections. Repeated rows: equal results. Empty table: no rows. The model file
    is read on the driver and sent to the tasks with the function; its size does not depend on the data. A kept column
    that bears a name of the result gets "input_" before it.
    """
    model = PieceModel(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    taken = ("ids", "n_pieces", "decoded_sha256", "round_trip")
    kept = [F.col(c).alias(f"input_{c}" if c in taken else c) for c in keep]
    # the text crosses once: a kept one serves, with null for empty
    given = docs.select(*kept) if "text" in keep else docs.select(*kept, F.col("text").alias("_tidemark_text"))
    width, column = len(kept), "text" if "text" in keep else "_tidemark_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        encoder = Encoder(m)
        for part, raw in text_slices(batches, column, chunk_bytes):  # small batches out, however large those that come in
            texts = [(t or b"").decode() for t in raw]
            ids = encoder.encode(texts)
            count = np.array([len(i) for i in ids], np.int64)
            same, digests = [], []
            for t, back in zip(texts, decode(m, ids)):
                same.append(back == t.replace(SPACE, " "))
                digests.append(hashlib.sha256(back.encode()).hexdigest())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
            columns = [*part.columns[: width], lists, pa.array(count), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[: width], *taken])

    schema = T.StructType(given.schema.fields[: width])
    for name, kind in zip(taken, (T.ArrayType(T.IntegerType()), T.LongType(), T.StringType(), T.BooleanType())):
        schema = schema.add(name, kind)
    return given.mapInArrow(run, schema)
