"""Suffix-array dedup: bytes covered by long strings that start more than once, by bucket-pointer refinement.

A suffix array sorted to depth LENGTH would put equal strings next to each other. Only equality matters here, so the
buckets of that order are kept, not the order. Suffixes start in buckets of their q-gram; a bucket with one member is
done. The others are refined by the bucket identifiers of later offsets: the identifier of a longer string is made of
those of the q-grams along it (WindowHash: one prefix sum has them all), and what one step settles, later steps reuse.

Not every suffix has to be dealt out. Each string of LENGTH bytes is led by its least q-gram (of equals the first),
which depends on the string alone; equal strings have equal leaders at equal offsets. So only leaders are bucketed,
with the run of starts that they lead, and the steps after that are

1. leaders by q-gram: a bucket with one member has no repeat;
2. runs by the identifier of the whole stretch that their strings cover: equal runs repeat as a whole;
3. of runs left over, blocks of BLOCK starts, first by the stretch common to their strings (no other member: no
   repeat), then by the stretch that they cover (equal: all repeat);
4. of blocks left over, single starts by the identifier of their LENGTH bytes.

A class that is settled sends one member on as evidence for the rest of its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WindowHash, join_spread, mix64, sliding_min, text_or_empty, text_slices, write_shared
from .shingles import words_of

LENGTH, GRAM, BLOCK = 400, 100, 32
#: Of passages shared by documents: words of a passage, and of the grams that lead them.
PASSAGE, LEAD = 50, 8
#: Keys are broadcast to pick texts only if they are counted to be this few; else the join shuffles.
BROADCAST_ROWS = 1_000_000
_ODD = np.uint64(0x8CB92BA72F3D8DD7)


def led_runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, leader, first, last, gram id, stretch id) of the runs of starts with one leader, positions within data."""
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    if len(data) < length:
        return none
    ids = WindowHash(data).every(gram)
    packed = (ids >> np.uint64(32) << np.uint64(32)) | np.arange(len(ids), dtype=np.uint64)
    leader = (sliding_min(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(leader)]
    at = np.flatnonzero(np.arange(len(leader)) + length <= starts[text + 1])
    if not len(at):
        return none
    led = leader[at]
    new = np.concatenate([[True], (led[1:] != led[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.concatenate([new[1:], [True]])]
    lead = led[new]
    stretch = WindowHash(data, 1).value(first, last + length)
    return text[first], lead, first, last, ids[lead], mix64(stretch + (lead - first).astype(np.uint64) * _ODD)


def find_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """node, bucket, stretch, lead, first, last (byte offsets) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in text_slices(batches):
            starts = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
            text, lead, first, last, bucket, stretch = led_runs(np.frombuffer(b"".join(raw), np.uint8), starts, length, gram)
            offsets = [pa.array((x - starts[text]).astype(np.int32)) for x in (lead, first, last)]
            columns = [part.column(0).take(pa.array(text)), pa.array(bucket.view(np.int64)), pa.array(stretch.view(np.int64)), *offsets]
            yield pa.RecordBatch.from_arrays(columns, ["node", "bucket", "stretch", "lead", "first", "last"])

    return texts.select("node", "text").mapInArrow(run, "node binary, bucket long, stretch long, lead int, first int, last int")


def _with_texts(texts: DataFrame, rows: DataFrame, columns: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """node, text and the list of rows (structs of columns) of each node that has rows."""
    lists = rows.groupBy("node").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    lists = write_shared(lists, "repeats-rows")
    keys = lists.select("node")
    few = lists.count() <= broadcast_rows
    picked = texts.join(F.broadcast(keys), "node", "left_semi") if few else texts
    return picked.join(lists, "node")


def _columns(rows: list) -> list[np.ndarray]:
    return [np.array(c) for c in zip(*(r.values() if isinstance(r, dict) else r for r in rows))]


def _blocks(length: int, block: int):
    schema = "node binary, bucket long, core long, stretch long, lead int, first int, last int, settled boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, text, rows in zip(batch["node"], batch["text"], batch["rows"]):
                bucket, lead, first, last, settled = _columns(rows)
                windows = WindowHash(np.frombuffer(text.encode(), np.uint8), 1)
                low, high = (lead - last) // block, (lead - first) // block
                n = high - low + 1
                own = np.repeat(np.arange(len(n)), n)
                c = low[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                near = lead[own] - c * block  # the last start of the block
                a, b = np.maximum(first[own], near - block + 1), np.minimum(last[own], near)
                core = windows.value(near, near - block + 1 + length)
                stretch = mix64(windows.value(a, b + length) + (lead[own] - a).astype(np.uint64) * _ODD)
                yield pd.DataFrame({
                    "node": [node] * len(own), "bucket": bucket[own], "core": mix64(core + c.astype(np.uint64) * _ODD).view(np.int64), "stretch": stretch.view(np.int64),
                    "lead": lead[own].astype(np.int32), "first": a.astype(np.int32), "last": b.astype(np.int32), "settled": settled[own].astype(bool),
                })

    return run, schema


def _starts(length: int):
    schema = "node binary, bucket long, id long, first int, settled boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, text, rows in zip(batch["node"], batch["text"], batch["rows"]):
                bucket, first, last, settled = _columns(rows)
                windows = WindowHash(np.frombuffer(text.encode(), np.uint8), 1)
                n = last - first + 1
                own = np.repeat(np.arange(len(n)), n)
                a = first[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({
                    "node": [node] * len(own), "bucket": bucket[own], "id": windows.value(a, a + length).view(np.int64),
                    "first": a.astype(np.int32), "settled": settled[own].astype(bool),
                })

    return run, schema


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """node, start, end of stretches whose every string of length bytes starts elsewhere too.

    texts: node and text, one row per different text. The spans of a node overlap and touch. Every join on a bucket
    spreads the rows of hot ones, so that one very common passage is worked on by many tasks.
    """
    runs = write_shared(find_runs(texts, length, gram), "repeats-runs")
    shared = runs.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    runs = write_shared(join_spread(runs, shared, ["bucket"], "_n", runs.count()).drop("_n"), "repeats-shared")
    total = runs.count()
    classes = runs.groupBy("bucket", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("node", "lead", "first", "last")).alias("one"))
    classes = write_shared(classes, "repeats-classes")
    whole = join_spread(runs, classes.where("n > 1").select("bucket", "stretch", "n"), ["bucket", "stretch"], "n", total, "left_semi")
    spans = [whole.select("node", F.col("first").alias("start"), (F.col("last") + length).alias("end"))]

    rest = classes.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("n").alias("least")).where("least = 1").select("bucket", "_n")
    work = join_spread(classes, rest, ["bucket"], "_n", total).select("bucket", "one.*", (F.col("n") > 1).alias("settled"))
    fn, schema = _blocks(length, block)
    blocks = _with_texts(texts, work, ["bucket", "lead", "first", "last", "settled"], broadcast_rows).mapInPandas(fn, schema)
    blocks = write_shared(blocks, "repeats-blocks")
    total = blocks.count()
    key = ["bucket", "core"]
    same = blocks.groupBy(*key, "stretch").agg(F.count("*").alias("n"), F.min("settled").alias("settled"), F.min(F.struct("node", "first", "last")).alias("one"))
    same = write_shared(same, "repeats-same")
    met = join_spread(blocks, same.where("n > 1").select(*key, "stretch", "n"), [*key, "stretch"], "n", total, "left_semi").where("not settled")
    spans.append(met.select("node", F.col("first").alias("start"), (F.col("last") + length).alias("end")))

    open_ = same.groupBy(*key).agg(F.count("*").alias("_n"), F.max((F.col("n") == 1) & ~F.col("settled")).alias("any")).where("_n > 1 and any").select(*key, "_n")
    work = join_spread(same, open_, key, "_n", total).select("bucket", "one.*", ((F.col("n") > 1) | F.col("settled")).alias("settled"))
    fn, schema = _starts(length)
    starts = _with_texts(texts, work, ["bucket", "first", "last", "settled"], broadcast_rows).mapInPandas(fn, schema)
    starts = write_shared(starts, "repeats-starts")
    twice = starts.groupBy("bucket", "id").agg(F.count("*").alias("n")).where("n > 1")
    met = join_spread(starts, twice, ["bucket", "id"], "n", starts.count(), "left_semi").where("not settled")
    spans.append(met.select("node", F.col("first").alias("start"), (F.col("first") + length).alias("end")))
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def _of_words(word: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words first..end-1 from one prefix sum."""
    power, inverse = WindowHash._power(len(word) + 1, 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[: len(word)])])
    return mix64((prefix[end] - prefix[first]) * inverse[first] + (end - first).astype(np.uint64))


def _led_passages(texts: Sequence[bytes], words: int, lead: int) -> tuple[np.ndarray, ...]:
    """(text, bucket, stretch, first word, last word) of the runs of passages with one leader, and the words' hashes."""
    owner, word = words_of(texts)
    if len(word) < words:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64)) + (word,)
    every = np.arange(len(word) - lead + 1)
    grams = _of_words(word, every, every + lead)
    packed = (grams >> np.uint64(32) << np.uint64(32)) | every.astype(np.uint64)
    leader = (sliding_min(packed, words - lead + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(owner[: len(leader)] == owner[words - 1 :])
    led = leader[at]
    new = np.ones(len(at), bool)
    new[1:] = (led[1:] != led[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first, last, led = at[new], at[np.concatenate([new[1:], np.ones(min(1, len(at)), bool)])], led[new]
    stretch = mix64(_of_words(word, first, last + words) + (led - first).astype(np.uint64) * _ODD)
    return owner[first], grams[led], stretch, first, last, word


def shared_passages(texts: DataFrame, words: int = PASSAGE, lead: int = LEAD, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the nodes with a passage of so many words that a text of another node holds too, the nodes that have a passage at all).

    Passages are led by their least gram of lead words, as strings by their q-grams: runs of passages with one leader
    meet in its bucket, first as whole stretches, and where a node has none in common, passage by passage.
    """

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in text_slices(batches):
            text, bucket, stretch, _, _, _ = _led_passages(raw, words, lead)
            columns = [part.column(0).take(pa.array(text)), pa.array(bucket.view(np.int64)), pa.array(stretch.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "bucket", "stretch"])

    def passages_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, text, rows in zip(batch["node"], batch["text"], batch["rows"]):
                (wanted,) = _columns(rows)
                _, bucket, _, first, last, word = _led_passages([text.encode()], words, lead)
                on = np.isin(bucket.view(np.int64), wanted)
                n = (last - first + 1)[on]
                at = np.repeat(first[on], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ids = np.unique(_of_words(word, at, at + words))
                yield pd.DataFrame({"node": np.repeat(node, len(ids)), "passage": ids.view(np.int64)})

    node = F.xxhash64("node").alias("node")
    ends = [F.count("*").alias("_n"), F.min("node").alias("lo"), F.max("node").alias("hi")]
    runs = write_shared(texts.select(node, "text").mapInArrow(runs_of, "node long, bucket long, stretch long"), "repeats-passages")
    shared = runs.groupBy("bucket").agg(*ends).where("lo <> hi").select("bucket", "_n")
    met = write_shared(join_spread(runs, shared, ["bucket"], "_n", runs.count()).drop("_n"), "repeats-met")
    total = met.count()
    same = met.groupBy("bucket", "stretch").agg(*ends).where("lo <> hi").select("bucket", "stretch", "_n")
    sharing = write_shared(join_spread(met, same, ["bucket", "stretch"], "_n", total, "left_semi").select("node").distinct(), "repeats-sharing")
    others = met.join(sharing, "node", "left_anti").select("bucket").distinct()
    asked = others.join(met.groupBy("bucket").agg(F.count("*").alias("_n")), "bucket")
    asked = join_spread(met, asked, ["bucket"], "_n", total, "left_semi").select("node", "bucket").distinct()
    passages = _with_texts(texts.select(node, "text"), asked, ["bucket"], broadcast_rows).mapInPandas(passages_of, "node long, passage long")
    passages = write_shared(passages, "repeats-each")
    twice = passages.groupBy("passage").agg(*ends).where("lo <> hi").select("passage", "_n")
    met = join_spread(passages, twice, ["passage"], "_n", passages.count(), "left_semi").select("node")
    return sharing.unionByName(met).distinct(), runs.select("node").distinct()


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for node, text, rows in zip(batch["node"], batch["text"], batch["rows"]):
            raw = text.encode()
            start, end = _columns(rows)
            change = np.zeros(len(raw) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change[:-1]) > 0
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            n = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((node, int(gone.sum()), n, hashlib.sha256(left).hexdigest(), left))
        yield pd.DataFrame(out, columns=["node", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, kept: bool = False, passage: int | None = PASSAGE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; kept=True adds the bytes left over.

    Removed is each byte of the UTF-8 text that lies in a string of length bytes which starts anywhere else, in this
    or another row, overlapping or not; strings are judged on the input. Null text: empty, nothing to remove. Texts
    shorter than length keep all. Rows with equal texts of length bytes or more (copies, repeated rows) lose all of
    it; one of them stands for the others in what follows. Empty table: no rows. Extra columns do not matter.

    passage adds shares_passage (0 or 1): does the row hold a passage of so many words that another row holds too?
    Such passages may be shorter than length, so nothing need be removed of them.

    Very long texts are read whole, one at a time. Texts with repeats are picked by broadcast only if they are
    counted to be few (broadcast_rows); else the join shuffles.
    """
    if not 0 < block <= length - gram + 1:
        raise ValueError("a block of starts must be no longer than length - gram + 1")
    text = text_or_empty()
    node = F.unhex(F.md5(text)).alias("node")
    rows = write_shared(docs.select("doc_id", node, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256")), "repeats-docs")
    copies = write_shared(rows.groupBy("node").agg(F.count("*").alias("copies")), "repeats-nodes")
    again = copies.where("copies > 1").select("node")
    texts = docs.select(node, text.alias("text")).where(F.octet_length("text") >= min(length, 2 * passage - 1 if passage else length))
    if again.count() <= broadcast_rows:  # copies, taken out of the scan; one of each comes back
        once = texts.join(F.broadcast(again), "node", "left_anti")
        one = texts.join(F.broadcast(again), "node", "left_semi").dropDuplicates(["node"])
        once = once.unionByName(write_shared(one, "repeats-copies"))
    else:
        once = write_shared(texts.dropDuplicates(["node"]), "repeats-copies")
    long = once.where(F.octet_length("text") >= length)
    few = again.count() <= broadcast_rows
    spans = repeated_spans(long, length, gram, block, broadcast_rows).join(F.broadcast(again) if few else again, "node", "left_anti")
    left = _with_texts(long, spans, ["start", "end"], broadcast_rows).mapInPandas(_cut, "node binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    left = left if kept else left.drop("kept")

    if passage:
        sharing, worded = shared_passages(once, passage, min(LEAD, passage), broadcast_rows)
        key = again.select(F.xxhash64("node").alias("node"))
        sharing = write_shared(sharing.unionByName(worded.join(F.broadcast(key) if few else key, "node", "left_semi")).distinct(), "repeats-sharing")
        sharing = sharing.select(F.col("node").alias("_key"), F.lit(1).alias("shares_passage"))
        copies = write_shared(copies.join(sharing, F.xxhash64("node") == F.col("_key"), "left").drop("_key"), "repeats-nodes")
    out = join_spread(rows, copies, ["node"], "copies", rows.count())
    # what is cut is known of texts without copies; the others are gone or too short
    alone = out.where("copies = 1").join(left, "node", "left")
    cut = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c != "node"]
    out = alone.unionByName(out.where("copies > 1").select("*", *cut))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    columns = [
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    ]
    if passage:
        columns.append(F.coalesce("shares_passage", F.lit(0)).alias("shares_passage"))
    if kept:
        return out.join(docs.select(node.alias("_node"), text.cast("binary").alias("_all")).dropDuplicates(["_node"]), F.col("node") == F.col("_node")).select(
            *columns, F.when(all_gone, F.lit(b"")).otherwise(F.coalesce("kept", "_all")).alias("kept")
        )
    return out.select(*columns)
