"""Near-duplicate classes by BagMinHash: weighted-Jaccard signatures, banding, verification of the multiset overlap.

A text is a multiset of word shingles. Over the weight axis of each shingle runs a Poisson process of rate 1, the
same in every text; a signature register keeps the earliest of the points dealt to it that lie below the shingle's
count. Two registers agree with the weighted Jaccard similarity as probability. The axis is cut at the powers of two,
and each piece is a hierarchy: a process splits into its halves at its first point, and only halves that reach below
the count and can still lower a register are entered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_spread, mix64, text_or_empty, text_slices, write_shared
from .shingles import multisets, word_shingles

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 5
#: Pairs are broadcast only if they are counted to be this few; else the join shuffles.
BROADCAST_ROWS = 200_000


def bag_signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers of point times; infinite for a text without shingles.

    A process gives its first point, then splits into its two halves, which go on from that time; one of unit width
    gives its next point itself. So the points do not depend on the weight of a text, halves above the weight are
    never entered, and none is followed beyond the time at which all registers of its text are surely lower.
    """
    signature = np.full(texts * registers, np.inf)
    weight = np.bincount(owner, count, texts)
    open_texts, slack = weight > 0, 4.0
    while open_texts.any():
        horizon = np.where(open_texts, registers * (np.log(registers) + slack) / np.maximum(weight, 1), -1.0)
        piece = 0
        while True:  # piece 0 is [0, 1), piece p is [2**(p-1), 2**p)
            least = 0 if piece == 0 else 1 << (piece - 1)
            at = np.flatnonzero((count > least) & open_texts[owner])
            if not len(at):
                break
            own, upto = owner[at], count[at]
            low, width = np.full(len(at), least, np.int64), np.full(len(at), max(1, least), np.int64)
            state = mix64(shingle[at] + np.uint64(0x632BE59BD9B4E019 * (piece + 1) & (1 << 64) - 1))
            time = np.zeros(len(at))
            while len(time):
                state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
                time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                on = time <= horizon[own]
                state, time, own, upto, low, width = (x[on] for x in (state, time, own, upto, low, width))
                draw = mix64(state ^ np.uint64(0xA0761D6478BD642F))
                register = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) * registers >> 32
                level = low + ((draw >> np.uint64(32)).astype(np.int64) * width >> 32)
                below = level < upto
                np.minimum.at(signature, own[below] * registers + register[below], time[below])
                wide = np.flatnonzero(width > 1)
                if len(wide):
                    half = width[wide] >> 1
                    width[wide] = half
                    up = low[wide] + half < upto[wide]  # the upper half reaches below the weight
                    wide, half = wide[up], half[up]
                    state = np.concatenate([state, mix64(state[wide] ^ np.uint64(0x8EBC6AF09C88C6E3))])
                    low = np.concatenate([low, low[wide] + half])
                    time, own, upto, width = (np.concatenate([x, x[wide]]) for x in (time, own, upto, width))
            piece += 1
        filled = np.isfinite(signature.reshape(texts, registers)).all(1)
        open_texts &= ~filled
        slack *= 4
    return signature.reshape(texts, registers)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (MD5 of the text), bands (hash of each band; empty for a text without words), a row per row."""
    odd = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(rows)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            owner, shingle, count = multisets(*word_shingles(texts, words))
            times = bag_signatures(owner, shingle, count, len(texts), bands * rows).view(np.uint64)
            keys = mix64((mix64(times).reshape(len(texts), bands, rows) * odd).sum(2) + np.arange(bands, dtype=np.uint64)).view(np.int64)
            worded = np.bincount(owner, minlength=len(texts)) > 0
            ends = np.concatenate([[0], np.cumsum(worded * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, keys[worded].ravel())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "node", "bands"])

    text = text_or_empty()
    shaped = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    return shaped.mapInArrow(run, "doc_id long, node binary, bands array<long>")


def overlap_share(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets of sorted hashes and counts."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = np.minimum(a[1][same], b[1][at[same]]).sum()
    return shared / (a[1].sum() + b[1].sum() - shared)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, group_bytes: int = 4 << 20, group_pairs: int = 40_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pairs (pivot, node) whose texts' shingles overlap enough. texts: node, text, n_bytes.

    Pivots and nodes are dealt into blocks, and a group is the pairs of two blocks with the texts they need, each
    once. There are so many blocks that groups hold about group_bytes of text and group_pairs pairs; a pivot with
    more than its share is dealt on. Few pairs (counted; broadcast_rows) go to the texts by broadcast; more shuffle.
    """
    sizes = texts.select("node", "n_bytes")
    load = F.col("n_bytes") + F.col("pivot_bytes")
    pairs = pairs.join(sizes, "node").join(sizes.select(F.col("node").alias("pivot"), F.col("n_bytes").alias("pivot_bytes")), "pivot")
    pairs = write_shared(pairs, "near-pairs")
    n, of_pairs = pairs.agg(F.count("*"), F.coalesce(F.sum(load), F.lit(0))).first()
    asked = pairs.select("pivot", "pivot_bytes").unionByName(pairs.select(F.col("node").alias("pivot"), F.col("n_bytes").alias("pivot_bytes"))).distinct()
    of_texts = asked.agg(F.coalesce(F.sum("pivot_bytes"), F.lit(0))).first()[0]
    # bytes of a group: at most those of its pairs, of its texts; the fewest blocks that keep both bounds
    blocks = math.ceil(max(math.sqrt(n / group_pairs), min(math.sqrt(of_pairs / group_bytes), 2 * of_texts / group_bytes), 1))
    heavy = pairs.groupBy("pivot").agg((F.ceil(F.sum(load) / (group_bytes * blocks)) + 1).alias("split")).where("split > 3")
    block = lambda c, of: F.pmod(F.xxhash64(F.lit(of), c), F.lit(blocks))
    split = F.pmod(F.xxhash64(F.lit(3), "node"), F.coalesce("split", F.lit(1)))  # pivots with many bytes are few: their bytes bound them
    group = F.xxhash64(block("pivot", 1), block("node", 2), F.when(F.col("split").isNotNull(), F.col("pivot")), split)
    dealt = write_shared(pairs.join(heavy, "pivot", "left").select("pivot", "node", group.alias("group")), "near-groups")
    keys = dealt.select("group", "node").unionByName(dealt.select("group", F.col("pivot").alias("node"))).distinct()
    keys = F.broadcast(keys) if n <= broadcast_rows else keys
    needed = texts.select("node", "text").join(keys, "node").select(F.col("group").alias("of_group"), "node", "text")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {node: k for k, node in enumerate(right["node"])}
        owner, shingle, count = multisets(*word_shingles([t.encode() for t in right["text"]], words))
        edge = np.searchsorted(owner, np.arange(len(at) + 1))
        near = [
            overlap_share((shingle[edge[i] : edge[i + 1]], count[edge[i] : edge[i + 1]]), (shingle[edge[j] : edge[j + 1]], count[edge[j] : edge[j + 1]])) >= similarity - 1e-12
            for i, j in zip(map(at.get, left["pivot"]), map(at.get, left["node"]))
        ]
        return left.loc[near, ["pivot", "node"]]

    return dealt.groupBy("group").cogroup(needed.groupBy("of_group")).applyInPandas(check, "pivot binary, node binary")


def shared_weights(texts: DataFrame, words: int, kinds: int = 32) -> DataFrame:
    """node, size (shingles), common (those of them that occur in another of these texts too) and by_kind: common, split by the shingles' hashes."""

    def list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            owner, shingle, count = multisets(*word_shingles(texts, words))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int64))], ["node", "shingle", "count"])

    def count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            owner, shingle = word_shingles(texts, words)
            counts = np.bincount(owner * kinds + (shingle % np.uint64(kinds)).astype(np.int64), minlength=len(texts) * kinds)
            lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * kinds, counts)
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "sizes"])

    texts = texts.select("node", "text")
    held = texts.mapInArrow(list_shingles, "node binary, shingle long, count long")
    alone = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.sum("count").alias("count")).where("n = 1")
    # 2**64 divides by kinds, a power of two, so a negative long has the same remainder
    alone = alone.groupBy("node").agg(F.array(*[F.sum(F.when(F.pmod("shingle", F.lit(kinds)) == k, F.col("count")).otherwise(0)) for k in range(kinds)]).alias("alone"))
    sized = texts.mapInArrow(count_kinds, "node binary, sizes array<long>").join(alone, "node", "left")
    by_kind = F.when(F.col("alone").isNull(), F.col("sizes")).otherwise(F.zip_with("sizes", "alone", lambda a, b: a - b))
    return sized.select("node", _sum("sizes").alias("size"), by_kind.alias("by_kind")).withColumn("common", _sum("by_kind"))


def _sum(array) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of the nodes of edges (a, b): least labels spread over edges and along themselves."""
    # of a node's edges one stays; its other neighbours are tied to that neighbour instead
    edges = write_shared(edges.select("a", "b"), "near-edges")
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()
    edges = least.select(F.col("m").alias("a"), "b").unionByName(tied)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = write_shared(both, "near-edges")
    degree = write_shared(both.groupBy("b").agg(F.count("*").alias("_n")), "near-degrees")
    total, most = _loads(degree, "_n")
    labels = write_shared(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("comp")), "near-labels")
    while True:
        held = degree.join(labels.withColumnRenamed("node", "b"), "b")
        around = join_spread(both, held, ["b"], "_n", total, most=most).groupBy("a").agg(F.min("comp").alias("near"))
        new = labels.join(around, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("low"))
        new = write_shared(new, "near-lower")
        up = new.groupBy("low").agg(F.count("*").alias("_n"))
        up = up.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("above")), "low")
        new = join_spread(new, up, ["low"], "_n", total).select("node", F.least("low", "above").alias("new"), "comp")
        new = write_shared(new, "near-labels")
        moved = new.where("new <> comp").limit(1).count()
        labels = new.select("node", F.col("new").alias("comp"))
        if not moved:
            return labels


def classes(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    stars: int = 2,
    growth: int = 64,
    few: int = 64,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, node, class_id (the class's smallest doc_id), class_size (rows) for each row of docs.

    Equal texts are one node from the start, so copies never meet as pairs. Stars come first: the members of a bucket
    of the bands are verified against one pivot, the next time (stars in all) against another one of those that share
    most with others; what is in the pivot's component by then is left out. In buckets of over few members a member
    is held against three of its pivots at most in one go. Then the rest: in buckets that still hold several
    components, all members outside of its most frequent one against more and more of all members (growth times as
    many each round, drawn by hash) until every pair has been verified, or is in one component, or cannot reach the
    similarity because too many of its shingles occur in no other text that is still in question (counted apart for
    shingles of 32 kinds, which tells apart copies of one text that were changed at different places). So no pair that
    shares a bucket is left open, and members of large groups of near copies are soon in one component or ruled out.

    Null or empty texts, or of white space only, have no shingles: each of them is a class with its equals in text.
    Texts of fewer than five words are near only if their words are equal. Very long texts are read whole; a group to
    verify holds a bounded number of bytes, or one text. Repeated rows: one class. A null doc_id is a row like others;
    a class of such rows alone has a null class_id. Extra columns do not matter. Empty table: no rows.
    """
    found = write_shared(signatures(docs, words, bands, rows), "near-signatures")
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = write_shared(nodes, "near-nodes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    shared = write_shared(shared, "near-buckets")
    total, largest = _loads(shared, "n")
    if not total:
        return _named(found, nodes, None)
    members = write_shared(join_spread(spread, shared, ["bucket"], "n", nodes.count() * bands, most=largest), "near-members")

    text = text_or_empty()
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    one = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("_node"), "least")
    # by node and id, so that the rows of a text with many copies do not meet
    texts = whole.join(one, (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("least")), "left_semi").dropDuplicates(["node"]).drop("_id")
    texts = write_shared(texts, "near-texts")
    check = lambda pairs: write_shared(verified(pairs, texts, words, similarity, broadcast_rows=broadcast_rows), "near-links")
    as_edges = lambda links: links.select(F.col("pivot").alias("a"), F.col("node").alias("b"))

    small = members.where((F.col("n") <= few) & (F.col("node") != F.col("pivot"))).select("pivot", "node")
    large = members.where((F.col("n") > few) & (F.col("node") != F.col("pivot"))).select("pivot", "node")
    checked = write_shared(small.unionByName(_some_pivots(large)).distinct(), "near-met")
    comps = components(as_edges(check(checked)))
    weights, width = None, 1
    step = 0
    while step < stars - 1 or width < largest:
        step += 1
        at = members.where("n > 2").join(comps, "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
        mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("n").alias("_n")).where("lo <> hi").select("bucket", "_n")
        rest = write_shared(join_spread(write_shared(at, "near-at"), mixed, ["bucket"], "_n", total, most=largest).drop("_n"), "near-rest")
        if weights is None:
            asked = texts.join(rest.select("node").distinct(), "node", "left_semi")
            weights = write_shared(shared_weights(asked, words), "near-weights")
        # what a text shares with no other cannot be in an overlap
        rest = write_shared(rest.join(weights, "node").where(F.col("common") >= similarity * F.col("size") - 1e-9), "near-rest")
        if not rest.limit(1).count():
            break
        # bounds of the overlap, the cheap one first
        enough = lambda most: most >= similarity * (F.col("size") + F.col("pivot_size") - most) - 1e-9
        by_kind = _sum(F.zip_with("by_kind", "pivot_by_kind", lambda a, b: F.least(a, b)))
        near = (F.col("pivot_comp") != F.col("comp")) & enough(F.least("common", "pivot_common")) & enough(by_kind)
        as_pivot = [F.col(c).alias(f"pivot{d}") for c, d in (("node", ""), ("comp", "_comp"), ("size", "_size"), ("common", "_common"), ("by_kind", "_by_kind"))]
        if step < stars:
            # of a half of a bucket's members, drawn anew each time, the one with the least share of its own
            rare = (F.col("size") - F.col("common")) / F.col("size") + F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2))
            heads = rest.groupBy("bucket").agg(F.min(F.struct(rare.alias("rare"), F.xxhash64("node").alias("draw"), *as_pivot)).alias("h"), F.count("*").alias("_n"))
            heads = heads.select("bucket", "_n", "h.pivot", "h.pivot_comp", "h.pivot_size", "h.pivot_common", "h.pivot_by_kind")
            met = _some_pivots(join_spread(rest, heads, ["bucket"], "_n", total, most=largest).where(near).select("pivot", "node"))
        else:
            width *= growth
            held = rest.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
            main = held.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("_n")).select("bucket", "_n", F.col("most.comp").alias("main"))
            parts = F.ceil(F.col("n") / 4096).cast("int")
            minor = join_spread(rest, main, ["bucket"], "_n", total, most=largest).where("comp <> main")
            minor = minor.select("bucket", "node", "comp", "size", "common", "by_kind", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
            place = F.pmod(F.xxhash64("node"), F.lit(1 << 31)) / float(1 << 31) * F.col("n")
            others = rest.where(place < width).select("bucket", F.pmod(F.xxhash64(F.lit(7), "node"), parts).cast("int").alias("part"), *as_pivot)
            met = minor.join(others, ["bucket", "part"]).where(near).select("pivot", "node")
        met = met.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct()
        met = write_shared(met.join(checked, ["pivot", "node"], "left_anti"), "near-met")
        if met.limit(1).count():
            fresh = check(met)
            checked = checked.unionByName(met)
            edges = comps.where("comp <> node").select(F.col("comp").alias("pivot"), "node").unionByName(fresh)
            comps = components(as_edges(edges))
    return _named(found, nodes, comps)


def _loads(keys: DataFrame, load: str) -> tuple[int, int]:
    """The sum of the loads of all keys and the largest."""
    return tuple(keys.agg(F.coalesce(F.sum(load), F.lit(0)), F.coalesce(F.max(load), F.lit(0))).first())


def _some_pivots(pairs: DataFrame, some: int = 3) -> DataFrame:
    """pivot, node: of each node's pivots some, drawn by hash and each once. The others' turn comes later."""
    drawn = pairs.groupBy("node").agg(F.collect_set("pivot").alias("pivots"))
    drawn = drawn.select("node", F.slice(F.array_sort(F.transform("pivots", lambda p: F.struct(F.xxhash64(p).alias("draw"), p.alias("pivot")))), 1, some).alias("pivots"))
    return drawn.select(F.explode("pivots.pivot").alias("pivot"), "node")


def _named(found: DataFrame, nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    slim = nodes.select("node", "least", "copies")
    slim = slim.withColumn("comp", F.col("node")) if comps is None else slim.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    slim = write_shared(slim, "near-slim")
    named = slim.groupBy("comp").agg(
        F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("kept"), F.count("*").alias("_n")
    )
    named = write_shared(named, "near-named")
    n_nodes, in_class = _loads(named, "_n")
    n_rows, copies = _loads(slim, "copies")
    of_node = join_spread(slim, named, ["comp"], "_n", n_nodes, most=in_class).select("node", "copies", "class_id", "class_size", F.col("kept.node").alias("kept_node"))
    rows = found.select("doc_id", "node")
    return join_spread(rows, write_shared(of_node, "near-classes"), ["node"], "copies", n_rows, most=copies).select("doc_id", "node", "class_id", "class_size", "kept_node")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of each class: the row of the smallest doc_id (of repeated rows any one)."""
    kept = classes(docs, **options).where(F.col("node") == F.col("kept_node") ).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = kept.select(F.col("node").alias("_tidemark_node"), F.col("doc_id").alias("_tidemark_id")).distinct()
    keyed = docs.withColumn("_tidemark_text", F.unhex(F.md5(text_or_empty())))
    rows = keyed.join(kept, (F.col("_tidemark_text") == F.col("_tidemark_node")) & F.col("doc_id").eqNullSafe(F.col("_tidemark_id")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_tidemark_text"]).drop("_tidemark_text")
