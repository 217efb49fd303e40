"""The corpus pipeline: five stages over documents, each a DataFrame written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dedup, pieces, quality, secrets
from tidemark.llm.common import table, write_shared
from tidemark.llm.registry import PIECE_MODEL


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; what labels marks as good quality is the trusted text.

    Null or empty texts stay, as all rows do where nothing is trusted. A null language is one of its own. Very long
    texts are judged whole. Repeated rows go or stay together. Empty table: no rows. Extra columns stay.
    """
    return quality.without_rejected(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id.

    Texts without words (null, empty, white space) are copies of their equals alone; null is as empty. Of repeated rows
    one stays. A row without doc_id stays only if no row of its class has one. Very long texts are compared whole.
    Empty table: no rows. Extra columns stay.
    """
    return near_dedup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows.

    Texts without secrets, null and empty ones among them, pass as they are. Very long texts are scanned whole. Repeated
    rows are treated alike. Empty table: no rows. Extra columns stay.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes (none, one or two of a document), in training order.

    Texts without words (null, empty) have size 0 and are never taken. A null source is one of its own. Repeated rows
    count each for itself. Empty table: no rows. Extra columns stay, whatever their names.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_document"))
    return mixing.in_training_order(mixing.mix(whole, keep=["_document"])).select("_document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, whether they decode to it, and its place in the training order.

    The order is that of the rows of the table read: train_part (file) and train_row (row in the file), null where docs
    are not read from files. Null or empty text: no ids. Very long texts are encoded whole. Repeated rows: equal ids.
    Empty table: no rows. Columns that bear a name of the result get "input_" before it.
    """
    place = [F.col("_metadata.file_name").alias("train_part"), F.col("_metadata.row_index").alias("train_row")]
    try:
        placed = docs.select("*", *place)
    except AnalysisException:  # no files
        placed = docs.select("*", F.lit(None).cast("string").alias("train_part"), F.lit(None).cast("long").alias("train_row"))
    return pieces.encode_documents(placed, PIECE_MODEL, keep=placed.columns)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the first two stages or the last; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
