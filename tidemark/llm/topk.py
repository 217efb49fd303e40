"""Exact top-k inner products by KD-trees, one per shard of the vectors.

Each shard splits its vectors at medians into leaves with tight bounding boxes. A query walks the tree best first by
the largest inner product that a box allows and stops when no box left can reach its kth score. The kth score that a
query gets from its own shard is propagated to its walks through all the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared

_HITS = "query_id long, vec_id long, score long, copies long"


class KDTree:
    """Median splits of integer vectors along the widest side; boxes are tight around the vectors they hold."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, leaf: int):
        self.order, self.lo, self.hi, self.kids, self.span = np.argsort(ids), [], [], [], []
        self._vectors = vectors
        self._build(0, len(ids), leaf)
        self.ids, self.vectors, self.copies = ids[self.order], vectors[self.order], copies[self.order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _build(self, start: int, end: int, leaf: int) -> int:
        node, v = len(self.span), self._vectors[self.order[start:end]]
        lo, hi = v.min(0), v.max(0)
        self.lo.append(lo), self.hi.append(hi), self.span.append((start, end)), self.kids.append(())
        axis = int(np.argmax(hi - lo))
        if end - start > leaf and hi[axis] > lo[axis]:
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(v[:, axis], middle)]
            self.kids[node] = (self._build(start, start + middle, leaf), self._build(start + middle, end, leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int, int]]:
        """(score, -vec_id, copies) of the k best vectors but the query's own; those under floor may be left out."""
        best: list[tuple[int, int, int]] = []
        kth = -np.inf if floor is None else floor
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:  # an equal score may win by a smaller vec_id
            node = heapq.heappop(heap)[1]
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= kth:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            a, b = self.span[node]
            scores = self.vectors[a:b] @ query
            for i in np.flatnonzero(scores >= kth):
                if (vec := int(self.ids[a + i])) != query_id:
                    hit = (int(scores[i]), -vec, int(self.copies[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


def _exact(a: np.ndarray) -> np.ndarray:
    """As float64, whose products are faster, where every inner product stays exact; else as they are."""
    return a.astype(np.float64) if not a.size or float(np.abs(a).max()) ** 2 * a.shape[1] < 2**52 else a


def _search_group(k: int, leaf: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query_id", "vec_id", "score", "copies"])
        vectors, queries = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
        both = _exact(np.concatenate([vectors, queries]))
        tree, queries = KDTree(left["vec_id"].to_numpy(), both[: len(vectors)], left["copies"].to_numpy(), leaf), both[len(vectors) :]
        rows, bounds = [], tree.bounds(queries)
        floors = right["kth"].astype(object).where(right["kth"].notna(), None)
        for query_id, q, bound, floor, times in zip(right["vec_id"], queries, bounds, floors, right["copies"]):
            rows += [(query_id, -vec, score, times * copies) for score, vec, copies in tree.search(query_id, q, bound, k, None if floor is None else int(floor))]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "copies"])

    return run


def quantise(vectors: DataFrame, scale: int = 256, column: str = "embedding") -> DataFrame:
    """vec_id, vector (floor(scale * x) of each component), copies, dim. Rows with a null vec_id, a null vector, or one that holds null, NaN or infinity are left out; equal rows become one that counts them in copies."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & c.isNotNull() & ~bad)
    whole = F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).groupBy("vec_id", "vector").agg(F.count("*").alias("copies")).withColumn("dim", F.size("vector")).where("dim > 0")


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int = 4096, query_rows: int = 2048, leaf: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all other rows (all, if fewer).

    vectors: vec_id and embedding; is_query: a condition on vec_id. Ties go to the smaller vec_id. Vectors of another
    length than the query's are no candidates. Rows of one vec_id, equal or not, are candidates each, and as queries
    share one ranking, in which each pair of rows counts; none is a candidate of its own id. Equal rows are searched
    once and counted at the end. Empty table: no rows. A search task holds one shard of about shard_rows
    vectors and one block of about query_rows queries, however many rows there are; extra columns do not matter.
    """
    rows = write_shared(quantise(vectors, scale), "topk-vectors")
    n, n_queries = rows.count(), rows.where(is_query).count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(1), F.col("vec_id")), F.lit(blocks)).cast("int"))
    held = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key, fn = ("dim", "shard", "block"), _search_group(k, leaf)

    def walk(asked: DataFrame) -> DataFrame:
        columns = [*key, "vec_id", "vector", "copies", "kth"]
        asked = asked.select(*[F.col(c).alias(c) for c in columns])  # columns of its own: both sides come from rows
        return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(fn, _HITS)

    own = write_shared(walk(queries.withColumn("kth", F.lit(None).cast("long"))), "topk-own")
    kth = own.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").alias("kth"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))
    rest = queries.join(kth, "vec_id", "left").select("dim", "block", "vec_id", "vector", "copies", "kth", F.explode(others).alias("shard"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    each = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy")
    return own.unionByName(walk(rest)).select("query_id", "vec_id", "score", each).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
