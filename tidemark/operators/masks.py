"""Row masks: observed, withheld, available, day and night, gap classes. All are non-null booleans on the row itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col, day_of, finite, yes

DAYTIME_THRESHOLD = 20.0
SUBSETS = ("all", "daytime", "nighttime")


def observed(target: str, qc: str | None = None, accepted: Sequence[int] = (0,)) -> Column:
    """The target is there and its flag, if there is a flag column, is an accepted one; a missing flag is not."""
    return finite(target) & (yes(F.col(qc).isin(list(accepted))) if qc else F.lit(True))


def _by_day(gaps: DataFrame) -> DataFrame:
    last = F.to_date(F.timestamp_add("MICROSECOND", F.lit(-1), F.col("end")))
    return gaps.withColumn("_day", F.explode(F.sequence(F.to_date("start"), last)))


def gap_rows(df: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rows of df within the half-open intervals of gaps (site_id, start, end, ...), once per interval, with the interval's columns.

    An equi-join on site and day with the bounds as a residual, so neither side is broadcast or compared as a whole.
    """
    g = _by_day(gaps)
    extra = [c for c in gaps.columns if c != "site_id"]
    d = df.withColumn("_day", day_of())
    inside = (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))
    return d.join(g, ["site_id", "_day"]).where(inside).select(*df.columns, *extra)


def with_holdout(df: DataFrame, gaps: DataFrame) -> DataFrame:
    """df with holdout: is the row within any of the intervals?"""
    hit = gap_rows(df.select("site_id", "ts"), gaps).select("site_id", "ts", F.lit(True).alias("_hit")).distinct()
    return df.join(hit, ["site_id", "ts"], "left").withColumn("holdout", yes(F.col("_hit"))).drop("_hit")


def available(is_observed: Column, holdout: str | Column = "holdout") -> Column:
    return is_observed & ~col(holdout)


def hide(target: str, holdout: str | Column = "holdout") -> Column:
    """The target with withheld values as null."""
    return F.when(~col(holdout), F.col(target))


def daytime(shortwave: str | Column, threshold: float = DAYTIME_THRESHOLD) -> Column:
    return yes(col(shortwave) > threshold)


def subsets(shortwave: str | Column, threshold: float = DAYTIME_THRESHOLD) -> Column:
    """The subsets that a row belongs to, as an array to explode; without radiation it is in neither day nor night."""
    sw = col(shortwave)
    return F.filter(F.array(F.lit("all"), F.when(sw > threshold, "daytime").when(sw <= threshold, "nighttime")), lambda x: x.isNotNull())


def with_gap_class(df: DataFrame, gaps: DataFrame, order: str = "gap_no") -> DataFrame:
    """df with gap_class, null outside; of overlapping gaps the later in manifest order (the column order) counts."""
    hits = gap_rows(df.select("site_id", "ts"), gaps).groupBy("site_id", "ts").agg(F.max_by("gap_class", order).alias("gap_class"))
    return df.join(hits, ["site_id", "ts"], "left")
