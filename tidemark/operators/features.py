"""Features of a site frame: radiation and season categories, elapsed time, per-day statistics of the visible target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FeatureError
from ..functions.expressions import clean, col, day_of
from .timeaxis import elapsed_hours

STRATEGIES = ("missing", "within_day_available", "neighbor_day_fallback", "rolling_available")
RADIATION = ("weak", "medium", "strong")
SEASONS = ("winter", "spring", "summer", "autumn")
STATISTICS = ("q1", "q2", "q3", "std")


def radiation_tag(shortwave: str | Column, low: float = 10.0, high: float = 100.0, convention: str = "medium_inclusive") -> Column:
    """weak, medium or strong; at a threshold medium (inclusive) or the outer class (exclusive); missing stays missing."""
    x = col(shortwave)
    if low >= high:
        raise FeatureError(f"radiation thresholds must rise, got {low} and {high}")
    if convention == "medium_inclusive":
        weak, strong = x < low, x > high
    elif convention == "medium_exclusive":
        weak, strong = x <= low, x >= high
    else:
        raise FeatureError(f"unknown boundary convention {convention!r}")
    return F.when(weak, "weak").when(strong, "strong").when(x.isNotNull(), "medium")


def hemisphere_of(latitude: str | Column) -> Column:
    return F.when(col(latitude) >= 0, "north").when(col(latitude) < 0, "south")


def season_tag(ts: str | Column = "ts", hemisphere: str | Column = "north") -> Column:
    """Season of the month; the southern hemisphere is half a year off."""
    hemi = F.lit(hemisphere) if isinstance(hemisphere, str) else hemisphere
    month = F.month(col(ts))
    shifted = F.when(hemi == "south", (month + 5) % 12 + 1).when(hemi == "north", month)
    return F.when(shifted.isin(12, 1, 2), "winter").when(shifted.isin(3, 4, 5), "spring").when(shifted.isin(6, 7, 8), "summer").when(shifted.isNotNull(), "autumn")


def encode(c: Column, order: Sequence[str]) -> Column:
    """Ordinal code as a double; missing stays missing."""
    out = F.when(c == order[0], 0.0)
    for k, name in enumerate(order[1:], 1):
        out = out.when(c == name, float(k))
    return out


def statistic_names(target: str) -> list[str]:
    return [f"{target}_daily_{s}" for s in STATISTICS]


def _std(c: str | Column, ddof: int) -> Column:
    """Standard deviation with ddof; null for so few values."""
    if ddof == 1:
        return F.stddev_samp(col(c))
    if ddof == 0:
        return F.stddev_pop(col(c))
    n = F.count(col(c))
    return F.when(n > ddof, F.sqrt(F.var_pop(col(c)) * n / F.greatest(n - ddof, F.lit(1))))


def _stats(visible: str, ddof: int) -> list[Column]:
    return [
        F.count(visible).alias("n_visible"), F.percentile(visible, 0.25).alias("q1"), F.percentile(visible, 0.5).alias("q2"),
        F.percentile(visible, 0.75).alias("q3"), _std(visible, ddof).alias("std"),
    ]


def day_statistics(df: DataFrame, visible: str, strategy: str = "missing", minimum: int = 1, window_days: int = 7, ddof: int = 1) -> DataFrame:
    """site_id, day, n_visible, q1, q2, q3, std of the visible values of each day with rows.

    What a day of fewer than minimum values gets depends on the strategy: missing (nothing), within_day_available
    (whatever the day has), neighbor_day_fallback (the four statistics of the nearest good day within window_days, of
    two as near the earlier), rolling_available (those of all values of the days around it, if they are enough).
    """
    if strategy not in STRATEGIES:
        raise FeatureError(f"unknown daily statistic strategy {strategy!r}")
    rows = df.select("site_id", day_of().alias("day"), clean(visible).alias("v"))
    days = rows.groupBy("site_id", "day").agg(*_stats("v", ddof))
    if strategy == "within_day_available":
        return days
    good = F.col("n_visible") >= minimum
    own = [F.when(good, F.col(s)).alias(s) for s in STATISTICS]
    if strategy == "missing":
        return days.select("site_id", "day", "n_visible", *own)
    if strategy == "neighbor_day_fallback":
        held = F.when(good, F.struct("day", *STATISTICS))
        order = Window.partitionBy("site_id").orderBy("day")
        near = days.withColumn("before", F.last(held, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        near = near.withColumn("after", F.first(held, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        back, ahead = F.datediff("day", "before.day"), F.datediff("after.day", "day")
        far = F.lit(window_days + 1)
        use_back = F.coalesce(back, far) <= F.coalesce(ahead, far)
        reach = F.least(F.coalesce(back, far), F.coalesce(ahead, far)) <= window_days
        pick = lambda s: F.when(good, F.col(s)).when(reach & use_back, F.col(f"before.{s}")).when(reach, F.col(f"after.{s}"))
        return near.select("site_id", "day", "n_visible", *[pick(s).alias(s) for s in STATISTICS])
    # rolling: only days in need are spread over their neighbours, then joined to the rows by day
    need = days.where(~good).select("site_id", F.col("day").alias("short_day"))
    around = need.withColumn("day", F.explode(F.sequence(F.date_sub("short_day", window_days), F.date_add("short_day", window_days))))
    pooled = around.join(rows.where("v is not null"), ["site_id", "day"]).groupBy("site_id", F.col("short_day").alias("day")).agg(*_stats("v", ddof))
    enough = pooled.where(F.col("n_visible") >= minimum).select("site_id", "day", *[F.col(s).alias(f"pool_{s}") for s in STATISTICS])
    return days.join(enough, ["site_id", "day"], "left").select(
        "site_id", "day", "n_visible", *[F.when(good, F.col(s)).otherwise(F.col(f"pool_{s}")).alias(s) for s in STATISTICS]
    )


def feature_names(drivers: Sequence[str], target: str | None = None, limiter: bool = True) -> list[str]:
    """Column order of the feature matrix."""
    if not limiter:
        return list(drivers)
    return [*drivers, "radiation", "season", "time_distance_hours", *(statistic_names(target) if target else [])]


def limiter_features(target: str) -> list[str]:
    """What a matrix with the receptive limiter has and one without it lacks."""
    return feature_names([], target)


def feature_matrix(
    df: DataFrame,
    drivers: Sequence[str],
    shortwave: str,
    target: str | None = None,
    visible: str | None = None,
    hemisphere: str | Column = "north",
    origin: Column | None = None,
    encoded: bool = True,
    limiter: bool = True,
    keep: Sequence[str] = (),
    **daily,
) -> DataFrame:
    """site_id, ts, the columns in keep, and the features in fixed order; every row stays and nothing is imputed.

    visible is the target with withheld values hidden; the statistics of its days are joined back by site and day.
    """
    wanted = feature_names(drivers, target, limiter)
    base = df.select("site_id", "ts", *keep, *[clean(d).alias(d) for d in drivers], *([F.col(visible).alias("_visible")] if limiter and target else []), F.col(shortwave).alias("_sw"))
    if limiter:
        tag, season = radiation_tag("_sw", **{k: daily.pop(k) for k in ("low", "high", "convention") if k in daily}), season_tag("ts", hemisphere)
        base = base.withColumns({
            "radiation": encode(tag, RADIATION) if encoded else tag, "season": encode(season, SEASONS) if encoded else season,
            "time_distance_hours": elapsed_hours("ts", origin),
        })
        if target:
            stats = day_statistics(base, "_visible", **daily)
            named = stats.select("site_id", F.col("day").alias("_day"), *[F.col(s).alias(n) for s, n in zip(STATISTICS, statistic_names(target))])
            base = base.withColumn("_day", day_of()).join(named, ["site_id", "_day"], "left")
    return base.select("site_id", "ts", *keep, *wanted)
