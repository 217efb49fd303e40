"""What the corpus operators share: the shared folder, hashing of byte windows, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
_own: dict[str, str] = {}  # by application, where no folder is set


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set (tests)."""
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # not set
        root = None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="tidemark-")
    return root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    # texts are long: few rows in an Arrow batch bound the memory that JVM and Python need for one
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has more than this share of the rows; so there are at most as many hot keys as its inverse.
HOT_SHARE, HOT_ROWS = 1 / 10_000, 1_000


def hot_edge(total: int) -> int:
    """Rows beyond which a key is hot in a table of total rows: never more than 1 / HOT_SHARE keys are."""
    return max(HOT_ROWS, int(total * HOT_SHARE))


def join_spread(left: DataFrame, right: DataFrame, on: Sequence[str], load: str, total: int, how: str = "inner", most: int | None = None) -> DataFrame:
    """left joined (inner or left_semi) with right, which has one row a key and the number of left's rows with it in load.

    total: the rows of left. Rows of hot keys stay where they are and meet their keys by broadcast, whose number is
    bounded (hot_edge); the rest shuffles. No task reads a whole hot key. left is read twice, so let it be a written table.
    most: no load is larger, where that is known. Where it says that no key is hot, the join is a plain one: the joins
    with no hot keys would be empty, but each costs the driver two broadcasts and their threads.
    """
    on, edge = list(on), hot_edge(total)
    if (total if most is None else most) <= edge:
        return left.join(right, on, how)
    hot, cold = right.where(F.col(load) > edge), right.where(F.col(load) <= edge)
    met = left.join(F.broadcast(hot), on, how)
    return met.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about size bytes of text of Arrow batches, with their texts in UTF-8: whatever a batch holds, little of it is in Python at a time."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
        end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, upto - at), texts.slice(at, upto - at).to_pylist()
            at = upto


# --- byte windows -----------------------------------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = {0: 0x9E3779B97F4A7C15 | 1, 1: 0xD1342543DE82EF95}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class WindowHash:
    """Hashes of any substring of a byte array from one prefix sum, modulo 2**64.

    value(i, j) depends on the bytes i..j-1 alone, not on where they stand.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, lane: int = 0):
        n = len(data)
        power, inverse = self._power(n + 1, lane)
        table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE[1 - lane]))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * power[:n], out=self.prefix[1:])
        self.inverse = inverse

    @classmethod
    def _power(cls, n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(lane)
        if have is None or len(have[0]) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            out = []
            for base in (_BASE[lane], pow(_BASE[lane], -1, 1 << 64)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            have = cls._powers[lane] = tuple(out)
        return have

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def every(self, width: int) -> np.ndarray:
        """Of each window of this width, by start."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n])

    def value(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes start..end-1; the length goes into the hash."""
        return mix64(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(_BASE[0]))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of this width, by start, in log2(width) passes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, y = 1, x
    while span * 2 <= width:
        y = np.minimum(y[: len(y) - span], y[span:])
        span *= 2
    return np.minimum(y[:n], y[width - span : width - span + n])
