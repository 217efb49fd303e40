"""Streams: fill new rows with a fitted forest, and day statistics with a watermark."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fill import GapFiller


def fill_stream(rows: DataFrame, filler: GapFiller, path: str, checkpoint: str) -> StreamingQuery:
    """Fill each micro-batch with the fit's model and origin and append it as Parquet, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each row is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        filler.fill(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_stream(rows: DataFrame, value: str, late: str = "1 day", keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Count, mean and standard deviation per key and day, final once the watermark has passed; later rows are left out."""
    stamped = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    day = F.window("ts", "1 day")
    return stamped.groupBy(*keys, day).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).select(*keys, F.to_date("window.start").alias("day"), "n", "mean", "std")


def run_available(df: DataFrame, path: str, checkpoint: str, then: Callable[[], None] | None = None) -> None:
    """Write what a stream has now as Parquet and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if then:
        then()
