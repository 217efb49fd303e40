"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight is a schedule over training time 0..1. Its integral, scaled to the source's target, is the
source's cumulative demand for words; inverting it gives the time at which a word of the source's stream is due,
and documents are range-sorted by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, write_shared

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Knots (time, relative weight) of the sources in turn: one falls, one rises, one peaks midway.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> plus source_no, weight and target (words).

    Targets follow the weights and add up to share times all sizes; none is over most times its source's size, and
    what is cut off goes to the others by weight, again and again until none is above. A null source comes last.
    The table has a row a source; only sums of it reach the driver. All sizes zero: all targets are zero.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    t = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % n + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = write_shared(t, "mix-sources")
    total = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # the level only rises, and each turn caps one source more at least
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        fixed, free = t.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        new = (total - fixed) / free
        if new <= level:
            break
        level = new
    return t.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def due_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Training time at which the cumulative demand of a schedule reaches this share (0..1) of its total.

    knots: (time, weight), times rising from 0 to 1; the weight is linear between them, so the demand is quadratic
    and its inverse the root of a quadratic equation.
    """
    parts = [(t0, w0, t1, w1, (w0 + w1) * (t1 - t0) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    area = sum(p[4] for p in parts)
    out, before = F.lit(1.0), area
    for t0, w0, t1, w1, a in reversed(parts):
        before -= a
        rest = share * area - F.lit(before)
        slope = (w1 - w0) / (t1 - t0)
        root = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0))) - w0) / slope
        out = F.when(share * area < before + a, F.least(F.greatest(F.lit(t0) + root, F.lit(t0)), F.lit(t1))).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    keep: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = 1.5,
    most: float = 2.0,
    buckets: int = 1024,
) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, copies, positions, and the columns in keep.

    Size is the number of words. A source whose target is r times its size takes floor(r) copies of each document,
    and one more of the first documents, in md5 order of doc_id, until the target is met: a document belongs to them
    if its middle word does. positions has the training time of each copy.

    Running sums within a source are cut into buckets of the md5, so that a source with a third of all rows is
    summed by many tasks. Null text: no words, size 0. Null source: a source of its own, the last. Repeated rows
    count each for itself; ties of the md5 are rows with the same doc_id, in order of size; null ids go by the md5 of the text. Empty table: no rows.
    Columns of the input that are not in keep do not matter; kept ones must not bear a name of the result.
    """
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5(F.concat(F.lit("text "), text_or_empty())))
    shown = [k for k in keep if k != "doc_id"]
    keep = [k for k in shown if k != "source"]
    rows = docs.select(
        "doc_id", "source", *keep,
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        key.alias("_key"),
    ).withColumn("_bucket", F.coalesce(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"), F.lit(0)) * buckets / 65536)
    rows = rows.withColumn("_bucket", F.floor("_bucket").cast("int"))

    sums = write_shared(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    s, b = before.alias("s"), targets.alias("b")
    offsets = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.source", "_bucket", "_before", "source_size", "source_no", "target")

    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = rows.withColumn("_upto", F.sum("size").over(within))
    o = offsets.withColumnRenamed("source", "_source").withColumnRenamed("_bucket", "_at")
    r = r.join(o, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at")))
    middle = F.col("_before") + F.col("_upto") - F.col("size") / 2.0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    r = r.withColumn("_middle", middle).withColumn("_whole", whole.cast("int"))
    r = r.withColumn("copies", F.col("_whole") + ((F.col("size") > 0) & (F.col("_middle") <= F.col("target") - F.col("_whole") * F.col("source_size"))).cast("int"))
    r = r.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))

    def position(j: Column) -> Column:
        at = (F.col("_middle") + j * F.col("source_size")) / F.col("target")
        out = due_time(at, schedules[-1])
        for k in range(len(schedules) - 1):
            out = F.when(F.col("source_no") % len(schedules) == k, due_time(at, schedules[k])).otherwise(out)
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return r.select(
        "doc_id", *shown, "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"), positions.alias("positions"),
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by position; copies 0 go."""
    return mixed.select("*", F.explode("positions").alias("position")).orderBy("position", "doc_id")  # a range sort
