"""Time axes of many sites: stamps, duplicates, cadence, regular grids, intervals.

Every frame has site_id and ts (timestamp_ntz or timestamp); a single site is a frame with one site_id.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TimeAxisError
from ..functions.expressions import MICROS, col, micros_between, ratio

#: A grid of more points a site than this is refused before it is laid out.
MOST_POINTS = 50_000_000

_UNITS = {"us": 1, "ms": 1000, "s": MICROS, "min": 60 * MICROS, "h": 3600 * MICROS, "d": 86400 * MICROS}


def to_duration(value: str | timedelta, name: str = "duration") -> timedelta:
    """A positive duration from text such as 30min or 7d, or a timedelta; bare numbers are refused."""
    if isinstance(value, str) and (m := re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(us|ms|s|min|h|d)\s*", value.lower())):
        value = timedelta(microseconds=float(m[1]) * _UNITS[m[2]])
    if not isinstance(value, timedelta):
        raise TimeAxisError(f"{name} must be a duration such as '30min', got {value!r}")
    if value <= timedelta(0):
        raise TimeAxisError(f"{name} must be positive, got {value}")
    return value


def micros(value: str | timedelta) -> int:
    return round(to_duration(value) / timedelta(microseconds=1))


def iso_duration(value: timedelta) -> str:
    """ISO 8601 text, e.g. P7DT0H30M0S."""
    rest, seconds = divmod(value.total_seconds(), 60)
    rest, minutes = divmod(int(rest), 60)
    days, hours = divmod(rest, 24)
    return f"P{days}DT{hours}H{minutes}M{seconds:g}S"


def to_periods(duration: str | timedelta, step: str | timedelta, name: str = "duration") -> int:
    """Whole number of steps in a duration; any other is refused."""
    n, rest = divmod(micros(duration), micros(step))
    if rest:
        raise TimeAxisError(f"{name} {duration} is no whole number of steps of {step}")
    return n


def from_periods(periods: int, step: str | timedelta) -> timedelta:
    return periods * to_duration(step)


def check_stamps(df: DataFrame, column: str = "ts") -> DataFrame:
    """df, if its stamps are timestamps, none is null and there is one at least."""
    kind = dict(df.dtypes).get(column)
    if kind not in ("timestamp", "timestamp_ntz"):
        raise TimeAxisError(f"column {column!r} has type {kind}, not a timestamp")
    seen = df.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("null")).first()
    if not seen["n"]:
        raise TimeAxisError("the frame is empty, so it has no time axis")
    if seen["null"]:
        raise TimeAxisError(f"column {column!r} lacks {seen['null']} of {seen['n']} stamps")
    return df


def set_time(df: DataFrame, column: str, drop: bool = True) -> DataFrame:
    """The frame with ts taken from a column."""
    if column not in df.columns:
        raise TimeAxisError(f"there is no column {column!r}")
    out = df.withColumn("ts", F.col(column))
    return out.drop(column) if drop and column != "ts" else out


def sort_by_time(df: DataFrame, sequence: str | None = None) -> DataFrame:
    return df.orderBy("site_id", "ts", *([sequence] if sequence else []))


def duplicate_stamps(df: DataFrame) -> DataFrame:
    """site_id, ts, n of the stamps that occur more than once."""
    return df.groupBy("site_id", "ts").agg(F.count("*").alias("n")).where("n > 1")


def resolve_duplicates(df: DataFrame, policy: str = "error", sequence: str = "ingest_seq") -> DataFrame:
    """One whole row per site and stamp, the first or last by sequence; 'error' refuses duplicates. Never averages."""
    if policy == "error":
        if (row := duplicate_stamps(df).first()) is not None:
            raise TimeAxisError(f"site {row['site_id']} has {row['n']} rows at {row['ts']}")
        return df
    if policy not in ("keep_first", "keep_last"):
        raise TimeAxisError(f"unknown duplicate policy {policy!r}")
    order = F.col(sequence).asc() if policy == "keep_first" else F.col(sequence).desc()
    rank = F.row_number().over(Window.partitionBy("site_id", "ts").orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def offset_minutes(stamp: str | Column) -> Column:
    """Minutes east of UTC that the text of a stamp ends in (Z, +05:30, -0800, +01); null without an offset."""
    c = F.trim(col(stamp).cast("string"))
    part = lambda k: F.regexp_extract(c, r"(?<=\d)([+-])(\d{2}):?(\d{2})?$", k)
    clock = c.rlike(r"\d[T ]\d{2}:\d{2}")  # else -05-01 would be taken for an offset
    signed = F.when(part(1) == "-", -1).otherwise(1) * (F.try_to_number(part(2), F.lit("99")).cast("int") * 60 + F.coalesce(F.try_to_number(F.nullif(part(3), F.lit("")), F.lit("99")).cast("int"), F.lit(0)))
    return F.when(c.rlike(r"(?i)\dZ$"), 0).when(clock & c.rlike(r"[+-]\d{2}(:?\d{2})?$"), signed)


def parse_offset(stamp: str | Column) -> Column:
    """A stamp of text in UTC (timestamp_ntz): an offset is taken off, without one it stays as it is; null if it is no stamp."""
    c = F.trim(col(stamp).cast("string"))
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)(?<=\d)Z$", ""), r"(?<=\d{2}:\d{2}(:\d{2})?(\.\d{1,6})?)[+-]\d{2}(:?\d{2})?$", "")
    read = F.try_to_timestamp(bare).cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", -F.coalesce(offset_minutes(c), F.lit(0)), read)


def stamp_report(df: DataFrame, column: str) -> DataFrame:
    """site_id, n, n_bad, n_naive, n_offsets, first, last of stamps of text: all that cannot be read is counted."""
    read = df.select("site_id", parse_offset(column).alias("t"), offset_minutes(column).alias("o"))
    good = F.col("t").isNotNull()
    return read.groupBy("site_id").agg(
        F.count("*").alias("n"), F.count_if(~good).alias("n_bad"), F.count_if(good & F.col("o").isNull()).alias("n_naive"), F.count_distinct(F.when(good, F.col("o"))).alias("n_offsets"),
        F.min("t").alias("first"), F.max("t").alias("last"),
    )


def set_text_time(df: DataFrame, column: str, mixed: str = "error") -> DataFrame:
    """df with ts read from a column of text. Any stamp that cannot be read is refused, with the number of all of them.

    Several offsets, or stamps with and without one, are refused as well unless mixed is utc; then all are taken to UTC,
    those without as if they were.
    """
    if mixed not in ("error", "utc"):
        raise TimeAxisError(f"unknown handling of mixed offsets {mixed!r}; known are error, utc")
    seen = df.agg(F.count_if(parse_offset(column).isNull()).alias("bad"), F.count("*").alias("n"), F.collect_set(F.coalesce(offset_minutes(column).cast("string"), F.lit("none"))).alias("offsets")).first()
    if seen["bad"]:
        shown = df.where(parse_offset(column).isNull()).select(column).limit(3).collect()
        raise TimeAxisError(f"{seen['bad']} of {seen['n']} stamps in {column} cannot be read, such as {', '.join(repr(r[0]) for r in shown)}")
    if len(seen["offsets"]) > 1 and mixed == "error":
        raise TimeAxisError(f"{column} mixes offsets from UTC (minutes: {', '.join(sorted(seen['offsets']))}); convert them to one, or take all to UTC")
    return df.withColumn("ts", parse_offset(column))


def interval_bounds(start: datetime, end: datetime | None = None, duration: str | timedelta | None = None) -> tuple[datetime, datetime]:
    """(start, end) of a half-open interval given by its end or its duration, but not both."""
    if (end is None) == (duration is None):
        raise TimeAxisError("an interval needs an end or a duration, and not both")
    end = end if end is not None else start + to_duration(duration)
    if end <= start:
        raise TimeAxisError(f"an interval must end after {start}, not at {end}")
    return start, end


def differences(df: DataFrame) -> DataFrame:
    """site_id, ts, gap_us: microseconds since the stamp before (null at a site's first)."""
    before = F.lag("ts").over(Window.partitionBy("site_id").orderBy("ts"))
    return df.select("site_id", "ts", micros_between(before, F.col("ts")).alias("gap_us"))


def cadence(df: DataFrame) -> DataFrame:
    """site_id, step_us, n_steps, n_odd: the commonest positive difference (of ties the smallest), and the differences that are no multiple of it."""
    gaps = differences(df).where("gap_us > 0")
    step = gaps.groupBy("site_id").agg(F.mode("gap_us", True).alias("step_us"))
    joined = gaps.join(step, "site_id")
    return joined.groupBy("site_id", "step_us").agg(F.count("*").alias("n_steps"), F.count_if(F.pmod("gap_us", "step_us") != 0).alias("n_odd"))


def infer_step(df: DataFrame) -> DataFrame:
    """site_id, step_us; refuses sites whose stamps fit no step."""
    found = cadence(df)
    if (row := found.where("n_odd > 0").first()) is not None:
        raise TimeAxisError(f"site {row['site_id']}: {row['n_odd']} differences are no multiple of {row['step_us']} microseconds")
    return found.select("site_id", "step_us")


def step_of(df: DataFrame, frequency: str | timedelta | None = None) -> DataFrame:
    """site_id, step_us: declared for every site, or inferred."""
    if frequency is None:
        return infer_step(df)
    return df.select("site_id").distinct().withColumn("step_us", F.lit(micros(frequency)))


def elapsed_hours(ts: str | Column = "ts", origin: Column | None = None) -> Column:
    """Hours since the origin; by default since the site's first stamp."""
    first = F.min(col(ts)).over(Window.partitionBy("site_id")) if origin is None else origin
    return micros_between(first, col(ts)) / F.lit(3600.0 * MICROS)


def interval_mask(ts: str | Column, start: Column, end: Column, closed: str = "left") -> Column:
    """Is the stamp within the interval? closed: left (half-open, the default), right, both or neither."""
    if closed not in ("left", "right", "both", "neither"):
        raise TimeAxisError(f"closed must be left, right, both or neither, got {closed!r}")
    t = col(ts)
    return ((t >= start) if closed in ("left", "both") else (t > start)) & ((t <= end) if closed in ("right", "both") else (t < end))


def grid(df: DataFrame, steps: DataFrame) -> DataFrame:
    """site_id, ts of the regular grid from each site's first stamp to its last; too many points are refused first."""
    ends = df.groupBy("site_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).join(steps, "site_id")
    points = F.floor(micros_between(F.col("first"), F.col("last")) / F.col("step_us")) + 1
    guard = F.when(points > MOST_POINTS, F.raise_error(F.concat(F.lit("a grid of "), points.cast("string"), F.lit(" points is too large")))).otherwise(F.lit(0).cast("long"))
    # day by day, so that no array grows with the length of the series
    day = 86400 * MICROS
    per = F.greatest(F.floor(F.lit(day) / F.col("step_us")), F.lit(1))
    parts = ends.withColumn("points", points + guard.cast("long")).withColumn("per", per)
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("points") - 1) / F.col("per")))))
    last = F.least(F.col("points"), (F.col("part") + 1) * F.col("per")) - 1
    laid = parts.withColumn("k", F.explode(F.sequence(F.col("part") * F.col("per"), last)))
    return laid.select("site_id", F.timestamp_add("MICROSECOND", F.col("k") * F.col("step_us"), F.col("first")).alias("ts"))


def missing_rows(df: DataFrame, steps: DataFrame) -> DataFrame:
    """Grid points without a row."""
    return grid(df, steps).join(df.select("site_id", "ts"), ["site_id", "ts"], "left_anti")


def off_grid(df: DataFrame, steps: DataFrame) -> DataFrame:
    """Stamps that are no grid point."""
    first = df.groupBy("site_id").agg(F.min("ts").alias("first")).join(steps, "site_id")
    return df.select("site_id", "ts").join(first, "site_id").where(F.pmod(micros_between(F.col("first"), F.col("ts")), F.col("step_us")) != 0).select("site_id", "ts")


def axis_summary(df: DataFrame, steps: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """One row per site: start, end, n, step_us, n_expected, n_missing, n_off_grid, n_duplicates_removed, is_regular, coverage.

    Counts instead of anti joins: a stamp is off the grid if it lies no whole number of steps after the first.
    """
    steps = infer_step(df) if steps is None else steps
    first = df.groupBy("site_id").agg(F.min("ts").alias("first"))
    at = df.select("site_id", "ts").join(first.join(steps, "site_id"), "site_id")
    off = F.pmod(micros_between(F.col("first"), F.col("ts")), F.col("step_us")) != 0
    out = at.groupBy("site_id", "step_us").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.count_if(off).alias("n_off_grid")
    )
    out = out.withColumn("n_expected", (F.floor(micros_between(F.col("start"), F.col("end")) / F.col("step_us")) + 1).cast("long"))
    out = out.withColumn("n_missing", F.col("n_expected") - (F.col("n") - F.col("n_off_grid")))
    if removed is None:
        out = out.withColumn("n_duplicates_removed", F.lit(0).cast("long"))
    else:
        out = out.join(removed.groupBy("site_id").agg(F.count("*").alias("_n")), "site_id", "left").withColumn("n_duplicates_removed", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")
    return out.withColumns({"is_regular": (F.col("n_missing") == 0) & (F.col("n_off_grid") == 0), "coverage": ratio(F.col("n") - F.col("n_off_grid"), F.col("n_expected"))})


def require_regular(summary: DataFrame) -> DataFrame:
    if (row := summary.where("not is_regular").first()) is not None:
        raise TimeAxisError(f"site {row['site_id']}: {row['n_missing']} grid points lack a row and {row['n_off_grid']} rows are off the grid")
    return summary


def prepare(df: DataFrame, column: str = "ts", frequency: str | None = None, on_duplicates: str = "error", regular: bool = False, sequence: str = "ingest_seq") -> tuple[DataFrame, DataFrame]:
    """The frame with one row per site and stamp, and its axis summary."""
    df = check_stamps(set_time(df, column, drop=False))
    kept = resolve_duplicates(df, on_duplicates, sequence)
    extra = df.groupBy("site_id", "ts").agg((F.count("*") - 1).alias("n")).where("n > 0").select("site_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    summary = axis_summary(kept, step_of(kept, frequency), extra)
    return kept, require_regular(summary) if regular else summary
