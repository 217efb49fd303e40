"""A Merkle manifest of a dataset: a digest of every row, a tree a source, a tree of the sources' roots, a proof a row.

Trees are reduced by superblocks: nodes are bucketed by index / fanout**levels, a grouped function collapses that many
levels of a bucket at once, and the buckets' roots are nodes of the next, much smaller round. Proofs come back down the
same way: a bucket's rows meet the proof of its root and put their own siblings before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .common import write_shared

FANOUT, LEVELS = 3, 6


def field_digest(*values: Column) -> Column:
    """Hex sha256 of the values one after the other: "-" for null, else the number of UTF-8 bytes, ":" and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def node_digest(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels over n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(digests: Sequence[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The layers of a bucket, from its nodes up to what is left after so many levels."""
    layers = [list(digests)]
    for _ in range(levels):
        below = layers[-1]
        layers.append([node_digest(below[j : j + fanout]) for j in range(0, len(below), fanout)])
    return layers


def siblings(layers: Sequence[Sequence[str]], i: int, fanout: int = FANOUT) -> list[str]:
    """Of node i, level by level: its siblings to the left joined, then those to the right."""
    out = []
    for layer in layers[:-1]:
        run = i - i % fanout
        out += ["".join(layer[run:i]), "".join(layer[i + 1 : run + fanout])]
        i //= fanout
    return out


def fold(digest: str, proof: Sequence[str]) -> str:
    """The root that a digest and its proof give."""
    for left, right in zip(proof[::2], proof[1::2], strict=True):
        digest = node_digest((left, digest, right))
    return digest


def indexed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """rows with i (place in its tree, from 0) and n (nodes of its tree), for any size of tree.

    Rows are dealt by range of tree and order and sorted in their partitions; a place is that in the partition plus the
    rows of the tree in partitions before. Equal rows are dealt by their number in the input, so that no key is one
    task's. rows must be the rows of a written table. A null tree is one of its own, nulls come first.
    """
    spread = rows.withColumn("_nth", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "_nth")]
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = write_shared(placed.withColumn("_part", F.shiftright("_at", 33)).drop("_nth"), "merkle-placed")
    parts = placed.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy("_tree")
    before = every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_tree", "_p", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(every).alias("n"))
    met = placed.join(parts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_tree", "_p", "_first", "_before")


def _levels_of(n: int, width: int, levels: int, fanout: int) -> int:
    """Levels that a bucket of a tree of n nodes collapses: all there are in a tree of one bucket."""
    return levels if n > width else height(n, fanout)


def proofs(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(tree, root) and (tree, bucket, proof) of nodes (tree, n, i, digest), a tree a value of tree, null included.

    bucket is i / fanout**levels; proof holds the siblings of the bucket's root up to the root of the tree. There are as
    many rounds as the largest tree has levels, divided by levels; each round's nodes are a written table, fanout**levels
    times smaller than the one before.
    """
    width, kind = fanout**levels, nodes.schema["tree"].dataType.simpleString()

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = int(pdf["n"].iloc[0])
        top = collapse(pdf["digest"].tolist(), _levels_of(n, width, levels, fanout), fanout)[-1]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "n": [-(-n // width)], "i": [int(pdf["i"].iloc[0]) // width], "digest": top})

    above = _in_buckets(nodes, width).applyInPandas(roots, f"tree {kind}, n long, i long, digest string")
    above = write_shared(above, "merkle-roots")
    if above.where("n > 1").isEmpty():
        return above.select("tree", F.col("digest").alias("root")), above.select("tree", F.lit(0).cast("long").alias("bucket"), F.array().cast("array<string>").alias("proof"))
    root, higher = proofs(above, fanout, levels)
    return root, write_shared(_met(above, higher, fanout, levels).select("tree", F.col("i").alias("bucket"), "proof"), "merkle-proofs")


def _in_buckets(nodes: DataFrame, width: int) -> GroupedData:
    return nodes.withColumn("bucket", F.floor(F.col("i") / width).cast("long")).groupBy("tree", "bucket")


def _met(nodes: DataFrame, higher: DataFrame, fanout: int, levels: int) -> DataFrame:
    """tree, i, proof of every node: its siblings in the bucket, then the proof of the bucket's root."""
    width, kind = fanout**levels, nodes.schema["tree"].dataType.simpleString()

    def meet(pdf: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        layers = collapse(pdf["digest"].tolist(), _levels_of(int(pdf["n"].iloc[0]), width, levels, fanout), fanout)
        high = list(upper["proof"].iloc[0])
        return pdf[["tree", "i"]].assign(proof=[siblings(layers, i, fanout) + high for i in range(len(pdf))])

    return _in_buckets(nodes, width).cogroup(higher.groupBy("tree", "bucket")).applyInPandas(meet, f"tree {kind}, i long, proof array<string>")


def manifest(rows: DataFrame, tree: str, order: Sequence[str], leaf: str, changed: str, keep: Sequence[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """keep, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    tree: the column of which each value has a tree (null first, then by UTF-8 bytes); order: the columns by which a
    tree's leaves ascend (nulls first; ties by the leaf); leaf: the digest of the row; changed: the digest to be folded
    up instead. Every run of fanout nodes becomes the digest of their hex digests one after the other, until one is
    left; the trees' roots are the leaves of one tree more. proof_sha256 is of all siblings from leaf to root, left to
    right. Only digests, keys and keep move, not the rows' contents. Repeated rows: a leaf each. No row: no rows.
    """
    width = fanout**levels
    places, kept = [f"_o{k}" for k in range(len(order))], [f"_k{k}" for k in range(len(keep))]
    held = rows.select(
        F.col(tree).alias("tree"), *[F.col(c).alias(o) for c, o in zip(order, places)], F.col(leaf).alias("digest"), F.col(changed).alias("changed"),
        *[F.col(c).alias(k) for c, k in zip(keep, kept)],
    )
    leaves = write_shared(indexed(write_shared(held, "merkle-leaves"), "tree", [*places, "digest"]).drop(*places), "merkle-indexed")
    sub, lower = proofs(leaves.select("tree", "n", "i", "digest"), fanout, levels)
    sources = write_shared(sub.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), "merkle-sources")
    sources = write_shared(indexed(sources, "tree", ["source"]), "merkle-sources")
    top, higher = proofs(sources.select("tree", "n", "i", "digest"), fanout, levels)
    over = _met(sources.select("tree", "n", "i", "digest"), higher, fanout, levels).join(top, "tree").select("i", F.col("proof").alias("over"), "root")
    over = sources.join(over, "i").select("source", F.col("digest").alias("subroot"), "over", "root")
    path = lower.join(over, F.col("tree").eqNullSafe(F.col("source"))).select("tree", "bucket", "subroot", "root", F.concat("proof", "over").alias("proof"))

    def prove(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        nodes, upper = nodes.sort_by("i"), upper.to_pylist()[0]
        digests, root = nodes.column("digest").to_pylist(), upper["root"]
        layers = collapse(digests, _levels_of(nodes.column("n")[0].as_py(), width, levels, fanout), fanout)
        proof_digests, folded = [], []
        for i, digest in enumerate(nodes.column("changed").to_pylist()):
            proof = siblings(layers, i, fanout) + upper["proof"]
            proof_digests.append(node_digest(proof))
            folded.append(fold(digest, proof))
        n = len(digests)
        found = [digests, [upper["subroot"]] * n, [root] * n, proof_digests, folded]
        columns = [*(nodes.column(k) for k in kept), *(pa.array(x, pa.string()) for x in found), pa.array([f == root for f in folded], pa.bool_())]
        return pa.table(columns, names=[*kept, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "".join(f"{k} {leaves.schema[k].dataType.simpleString()}, " for k in kept) + "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = _in_buckets(leaves, width).cogroup(path.groupBy("tree", "bucket")).applyInArrow(prove, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id and the manifest's columns of each document, over doc_id, source, lang, n_chars and text.

    What is folded up is the leaf of a tampered text (without line feeds) where the crc32 of the doc_id in decimals is
    even; where that is odd or doc_id is null, the leaf itself. Null fields have a digest of their own; an empty text
    differs from null. Very long texts are hashed whole. Repeated rows and null doc_ids: a leaf each, in the order of
    leaves. Extra columns do not matter. Empty table: no rows.
    """
    digest = lambda text: field_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaf = digest(F.col("text"))
    changed = F.when(tampered & F.contains("text", F.lit("\n")), digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf)
    rows = docs.select("doc_id", "source", leaf.alias("_leaf"), changed.alias("_changed"))
    return manifest(rows, "source", ["doc_id"], "_leaf", "_changed", ["doc_id"])
