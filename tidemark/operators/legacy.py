"""The historical feature set, which looks ahead: kept for comparison with old runs, never the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clean, col, midnight

# The codes of radiation and season in the historical features.
RADIATION_CODES = {"unclassified": 0, "weak": 1, "medium": 2, "strong": 3}
SEASON_CODES = {"winter": 1, "spring": 2, "summer": 3, "autumn": 4}
LEGACY_STATISTICS = ("max", "min", "mean", "std", "p25", "p50", "p75")


def legacy_statistic_names(target: str) -> list[str]:
    return [f"{target}_{s}" for s in LEGACY_STATISTICS]


def legacy_feature_names(target: str) -> list[str]:
    return [*legacy_statistic_names(target), "season", "radiation", "doy", "year"]


def interpolate_by_position(df: DataFrame, columns: list[str], position: str) -> DataFrame:
    """Linear interpolation over row positions within a site: a leading gap stays null, a trailing one repeats the last value."""
    order = Window.partitionBy("site_id").orderBy(position)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    out = df
    for c in columns:
        held = F.when(F.col(c).isNotNull(), F.struct(F.col(position).cast("double").alias("x"), F.col(c).alias("y")))
        out = out.withColumns({f"_b_{c}": F.last(held, True).over(before), f"_a_{c}": F.first(held, True).over(after)})
    done = {}
    for c in columns:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        slope = (a["y"] - b["y"]) / F.nullif(a["x"] - b["x"], F.lit(0.0))
        line = b["y"] + slope * (F.col(position).cast("double") - b["x"])
        done[c] = F.coalesce(F.col(c), F.when(b.isNotNull() & a.isNotNull(), line).when(b.isNotNull(), b["y"]))
    return out.withColumns(done).drop(*[f"_{k}_{c}" for c in columns for k in "ba"])


def legacy_daily_statistics(df: DataFrame, target: str, visible: str) -> DataFrame:
    """site_id, ts and seven statistics of the interpolated target's day, joined a day ahead.

    A row at midnight has its own day's statistics, every other row those of the day after: the historical join.
    """
    rows = df.select("site_id", "ts", clean(visible).alias("v"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("site_id").orderBy("ts")))
    full = interpolate_by_position(rows, ["v"], "pos")
    names = legacy_statistic_names(target)
    aggregates = [F.max("v"), F.min("v"), F.avg("v"), F.stddev_samp("v"), *[F.percentile("v", q) for q in (0.25, 0.5, 0.75)]]
    days = full.groupBy("site_id", F.to_date("ts").alias("day")).agg(*[a.alias(n) for a, n in zip(aggregates, names)])
    key = F.when(F.col("ts") == midnight(F.to_date("ts")), F.to_date("ts")).otherwise(F.date_add(F.to_date("ts"), 1))
    joined = full.withColumn("day", key).join(days, ["site_id", "day"], "left")
    return interpolate_by_position(joined, names, "pos").select("site_id", "ts", *names)


def legacy_season_code(ts: str | Column = "ts", hemisphere: str = "north") -> Column:
    month = F.month(col(ts)) + (6 if hemisphere == "south" else 0)
    return F.floor((month % 12 + 3) / 3).cast("int")


def legacy_radiation_rank(shortwave: str | Column, low: float = 10.0, high: float = 100.0) -> Column:
    """1, 2, 3 strictly between the thresholds; 0 on one, or where radiation is missing."""
    x = col(shortwave)
    return F.when(x < low, 1).when((x > low) & (x < high), 2).when(x > high, 3).otherwise(0)


def legacy_calendar(ts: str | Column = "ts") -> dict[str, Column]:
    return {"doy": F.dayofyear(col(ts)).cast("double"), "year": F.year(col(ts)).cast("double")}


def legacy_features(df: DataFrame, target: str, visible: str, shortwave: str, hemisphere: str = "north") -> DataFrame:
    stats = legacy_daily_statistics(df, target, visible)
    out = df.select("site_id", "ts", F.col(shortwave).alias("_sw")).join(stats, ["site_id", "ts"])
    out = out.withColumns({"season": legacy_season_code("ts", hemisphere).cast("double"), "radiation": legacy_radiation_rank("_sw").cast("double"), **legacy_calendar()})
    return out.select("site_id", "ts", *legacy_feature_names(target))
