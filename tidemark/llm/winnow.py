"""Benchmark decontamination by winnowing: the smallest k-gram hash of each sliding window is a text's fingerprint.

Two texts that share `span` words share a fingerprint inside them, for a window is span - k + 1 k-grams long. So the
places of a document that can be in a shared span are those whose fingerprint is one of the benchmark's. Each is
extended to the spans around it, and (fingerprint's span) joins (benchmark's span) on 128 bits of hash. Spans with
equal lists of items share one set of items, and documents with equal sets one list: nothing is items times documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WindowHash, join_spread, mix64, sliding_min, text_or_empty, text_slices, write_shared
from .shingles import in_chunks

SPAN, GRAM = 10, 6
#: Bits of the filter that holds the benchmark's fingerprints and spans: 16 MB at most, whatever the benchmark's size.
FILTER_BITS = 1 << 27

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PART = np.zeros(256, bool)  # bytes of a word, after folding
_PART[48:58] = _PART[97:123] = _PART[128:] = True
_ODD = [[np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) + lane * 0xD1342543DE82EF95) & (1 << 64) - 1 | 1) for k in range(SPAN)] for lane in (0, 1)]
_SALT = [np.uint64((0xBF58476D1CE4E5B9 * (2 * k + 1)) & (1 << 64) - 1) for k in range(SPAN + 1)]


def words_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, their hashes in order in two lanes): runs of ASCII digits, letters and non-ASCII bytes, A-Z lower-cased."""
    counts, lanes = [], ([], [])
    for _, part in in_chunks(texts):
        data = _FOLD[np.frombuffer(b" ".join([*part, b""]), np.uint8)]
        inside = _PART[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        begin = np.cumsum([0] + [len(t) + 1 for t in part])
        counts.append(np.bincount(np.searchsorted(begin, start, "right") - 1, minlength=len(part)))
        for lane, out in enumerate(lanes):
            out.append(WindowHash(data, lane).value(start, end))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(counts, np.int64), join(lanes[0], np.uint64), join(lanes[1], np.uint64)


def gram_hashes(words: np.ndarray, n: int, lane: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Of the n words from each place on (from those in `at`, if given); n goes into the hash."""
    last = max(0, len(words) - n + 1)
    h = np.zeros(last if at is None else len(at), np.uint64)
    for k in range(n):
        h += (words[k : k + last] if at is None else words[at + k]) * _ODD[lane][k]
    return mix64(h + _SALT[n])


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest of each window of this many grams, each place once."""
    least = sliding_min(grams, window)
    if not len(least):
        return np.zeros(0, np.int64)
    chosen = np.zeros(len(grams), bool)
    open_ = np.ones(len(least), bool)
    for back in range(window - 1, -1, -1):
        hit = open_ & (grams[back : back + len(least)] == least)
        chosen[np.flatnonzero(hit) + back] = True
        open_ &= ~hit
    return np.flatnonzero(chosen)


def _owners(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, first word of each text)."""
    return np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts


def _spans_at(places: np.ndarray, owner: np.ndarray, first: np.ndarray, counts: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Starts of the spans that hold the gram at one of the places, within its text, each once, ascending."""
    starts = np.unique((places[:, None] - np.arange(span - gram + 1)[None, :]).ravel())
    starts = starts[starts >= 0]
    at = owner[starts]
    return starts[starts + span <= first[at] + counts[at]]


class HashFilter:
    """A set of hashes of fixed size, with two bits each: asks may err on the side of yes."""

    def __init__(self, words: np.ndarray, bits: np.ndarray, size: int):
        self.size = size
        self.table = np.zeros(size >> 6, np.uint64)
        self.table[words] = bits

    @staticmethod
    def places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
        yield h & np.uint64(size - 1)
        yield (h >> np.uint64(32)) & np.uint64(size - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, self.size):
            out &= (self.table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def _filter_of(hashes: DataFrame, size: int) -> HashFilter:
    """Of the column h (long). Spark ors the bits together: the driver gets the filter's own words, size / 64 at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.concatenate(list(HashFilter.places(h, size)))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["word", "bits"])

    table = hashes.select("h").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return HashFilter(table.column("word").to_numpy(), table.column("bits").to_numpy().view(np.uint64), size)


def item_spans(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """item_id, length, h1, h2 of each span of an item and, with length 0, h1 of each fingerprint. A shorter item, but not an empty one, is a span."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            counts, one, two = words_of([t or b"" for t in texts])
            owner, first = _owners(counts)
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
            for n in range(1, span + 1):
                at = np.arange(max(0, len(one) - n + 1))
                at = at[owner[at] == owner[at + n - 1]] if len(at) else at
                at = at[counts[owner[at]] == n] if n < span else at
                out.append((owner[at], np.full(len(at), n), gram_hashes(one, n, 0, at), gram_hashes(two, n, 1, at)))
            grams = gram_hashes(one, gram)
            for k in np.flatnonzero(counts >= span):
                own = grams[first[k] : first[k] + counts[k] - gram + 1]
                chosen = own[winnowed(own, span - gram + 1)]
                out.append((np.full(len(chosen), k), np.zeros(len(chosen), np.int64), chosen, np.zeros(len(chosen), np.uint64)))
            text, length, h1, h2 = (np.concatenate(x) for x in zip(*out))
            ids = batch.column(0).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([ids, pa.array(length, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["item_id", "length", "h1", "h2"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", text_or_empty().alias("text")).mapInArrow(find, f"item_id {kind}, length int, h1 long, h2 long").distinct()


_HITS = "text_hash string, n_words long, hits array<struct<at: long, length: int, h1: long, h2: long>>"


def _hits(docs: DataFrame, known: HashFilter, short: Sequence[int], span: int, gram: int) -> DataFrame:
    """doc_id, text_hash, n_words and the places, lengths and hashes of spans that may be an item's, of each document."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = held.value
        for batch, texts in text_slices(batches):
            counts, one, two = words_of([t or b"" for t in texts])
            owner, first = _owners(counts)
            inner = owner[: len(one) - gram + 1] == owner[gram - 1 :] if len(one) >= gram else np.zeros(0, bool)
            grams = gram_hashes(one, gram)
            # grams over the border of two texts count as the largest, so that they win no window of a text's own
            places = winnowed(np.where(inner, grams, np.uint64((1 << 64) - 1)), span - gram + 1)
            places = places[inner[places] & among.holds(grams[places])]
            starts = _spans_at(places, owner, first, counts, span, gram)
            found = [(starts, np.full(len(starts), span))]
            for n in short:
                at = np.arange(max(0, len(one) - n + 1))
                found.append((at[owner[at] == owner[at + n - 1]] if len(at) else at, np.full(0, n)))
                found[-1] = (found[-1][0], np.full(len(found[-1][0]), n))
            at, length, h1, h2 = [], [], [], []
            for places_, lengths in found:
                n = int(lengths[0]) if len(lengths) else span
                h = gram_hashes(one, n, 0, places_)
                yes = among.holds(h)
                at.append(places_[yes])
                length.append(lengths[yes])
                h1.append(h[yes])
                h2.append(gram_hashes(two, n, 1, places_[yes]))
            at, length, h1, h2 = (np.concatenate(x) for x in (at, length, h1, h2))
            order = np.argsort(owner[at], kind="stable") if len(at) else np.zeros(0, np.int64)
            at, length, h1, h2 = at[order], length[order], h1[order], h2[order]
            ends = np.searchsorted(owner[at], np.arange(len(texts) + 1))
            spans = pa.StructArray.from_arrays(
                [pa.array(at - first[owner[at]], pa.int64()), pa.array(length, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["at", "length", "h1", "h2"]
            )
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), hits], ["doc_id", "text_hash", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_hash")).mapInArrow(find, f"doc_id {kind}, {_HITS}")


def _ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(ids), ","), 256)


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document.

    items: item_id and text. A span is `span` consecutive words of an item; an item of fewer, but not none, is one span.
    n_hit: words of the document inside any occurrence of a span; n_items: items with spans that occur in it, whose ids
    items_sha256 hashes (sorted as strings, comma-joined). Null or empty texts have no words, a null item_id counts but
    adds nothing to the hash, repeated rows have equal results, very long texts are taken whole, extra columns do not
    matter. No items: no hits. Empty table: no rows.
    """
    spans = write_shared(item_spans(items, span, gram), "winnow-items")
    short = sorted(r["length"] for r in spans.where(F.col("length").between(1, span - 1)).select("length").distinct().collect())
    known = _filter_of(spans.select(F.col("h1").alias("h")).distinct(), filter_bits)
    found = write_shared(_hits(docs, known, short, span, gram), "winnow-hits")

    # spans and the set of items of each
    of_span = spans.where("length > 0").groupBy("length", "h1", "h2").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))
    of_span = write_shared(of_span.withColumn("items", F.sha2(F.array_join("ids", ","), 256)), "winnow-sets")
    sets = of_span.select("items", "ids").dropDuplicates(["items"])

    # each different text once
    texts = found.where(F.size("hits") > 0).groupBy("text_hash").agg(F.first("hits").alias("hits"))
    hits = write_shared(texts.select("text_hash", F.explode("hits").alias("hit")).select("text_hash", "hit.*"), "winnow-places")
    load = hits.groupBy("length", "h1", "h2").agg(F.count("*").alias("load"))
    right = of_span.select("length", "h1", "h2", "items").join(load, ["length", "h1", "h2"])
    hits = write_shared(join_spread(hits, right, ["length", "h1", "h2"], "load", hits.count()).select("text_hash", "at", "length", "items"), "winnow-met")

    before = Window.partitionBy("text_hash").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    new = hits.groupBy("text_hash", "at").agg(F.max("length").alias("length")).withColumn("upto", F.coalesce(F.max(end).over(before), F.lit(0)))
    n_hit = new.groupBy("text_hash").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("at", "upto"))).alias("n_hit"))

    # each different list of sets once
    lists = hits.select("text_hash", "items").distinct().groupBy("text_hash").agg(F.array_sort(F.collect_list("items")).alias("sets"))
    lists = lists.select("text_hash", "sets", F.sha2(F.array_join("sets", ""), 256).alias("list"))
    of_list = lists.select("list", "sets").dropDuplicates(["list"]).select("list", F.explode("sets").alias("items")).join(sets, "items")
    of_list = of_list.select("list", F.explode("ids").alias("id")).distinct().groupBy("list").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("id")).alias("ids"))
    of_list = of_list.select("list", "n_items", F.sha2(F.array_join(F.filter("ids", lambda x: x != ""), ","), 256).alias("items_sha256"))
    load = lists.groupBy("list").agg(F.count("*").alias("load"))
    result = write_shared(n_hit.join(join_spread(write_shared(lists.drop("sets"), "winnow-lists"), of_list.join(load, "list"), ["list"], "load", lists.count()), "text_hash"), "winnow-texts")

    docs_of = found.select("doc_id", "text_hash", "n_words")
    load = docs_of.groupBy("text_hash").agg(F.count("*").alias("load"))
    right = result.select("text_hash", "n_hit", "n_items", "items_sha256").join(load, "text_hash")
    hit = join_spread(docs_of, right, ["text_hash"], "load", docs_of.count()).drop("load")
    clean = docs_of.join(result.select("text_hash"), "text_hash", "left_anti")
    none = F.sha2(F.lit(""), 256)
    clean = clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"))
    return hit.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").unionByName(clean).withColumn("contaminated", F.col("n_hit") > 0)
