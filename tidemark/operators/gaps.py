"""Artificial gaps: how many of each class, where, and what they withhold."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, GapError, GapWarning
from ..functions import spellings
from ..functions.expressions import half_up, ratio
from ..functions.lineage import cut
from . import masks
from .timeaxis import iso_duration, micros

MANIFEST_FORMAT = 1
CLASSES = ("short", "long", "very_long")
SCHEMA = "site_id string, gap_id string, gap_class string, start timestamp_ntz, end timestamp_ntz, n_expected long, n_rows long, n_observed_before_masking long, observed_fraction double"


@dataclass(frozen=True)
class GapScenario:
    """What to withhold: the fraction, the shares and durations of the classes, and how strictly."""

    missing_fraction: float = 0.25
    mix: Mapping[str, float] = field(default_factory=lambda: {"short": 0.2, "long": 0.3, "very_long": 0.5})
    durations: Mapping[str, timedelta] = field(default_factory=lambda: {"short": timedelta(days=1), "long": timedelta(days=7), "very_long": timedelta(days=30)})
    basis: str = "missing_records"
    min_observed_fraction: float = 0.5
    allow_overlap: bool = False
    max_attempts: int = 100
    fraction_tolerance: float = 0.05
    mix_tolerance: float = 0.05

    def __post_init__(self):
        for name in ("mix", "durations"):  # classes may be spelled by their durations
            object.__setattr__(self, name, {spellings.coerce(k, CLASSES, "gap class", spellings.GAP_CLASS_SPELLINGS): v for k, v in getattr(self, name).items()})
        if not 0 < self.missing_fraction < 1:
            raise ConfigError(f"missing_fraction must be between 0 and 1, got {self.missing_fraction}")
        if self.basis not in ("missing_records", "gap_events"):
            raise ConfigError(f"unknown allocation basis {self.basis!r}")
        if abs(sum(self.mix.values()) - 1) > 1e-9:
            raise ConfigError("the shares of the gap classes must add up to 1")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, k, float(self.mix.get(c, 0)), micros(self.durations[c])) for k, c in enumerate(CLASSES)]
        return spark.createDataFrame(rows, "gap_class string, class_rank int, share double, duration_us long")


def allocate(sites: DataFrame, classes: DataFrame, missing_fraction: float = 0.25, basis: str = "missing_records") -> DataFrame:
    """site_id, gap_class, class_rank, events, per_event, planned, target_records for each site and class.

    sites: site_id, n_available, step_us, span_us (first to last stamp). Records are shared out class by class, or
    events by largest remainders with ties in class order. A class longer than the series gets none.
    """
    t = sites.crossJoin(classes)  # three literal rows a site
    t = t.withColumns({"target_records": half_up(F.lit(missing_fraction) * F.col("n_available")), "per_event": F.floor(F.col("duration_us") / F.col("step_us")).cast("long")})
    if basis == "missing_records":
        events = half_up(ratio(F.col("share") * F.col("target_records"), F.col("per_event")))
        t = t.withColumn("events", F.coalesce(events, F.lit(0).cast("long")))
    else:
        site = Window.partitionBy("site_id")
        t = t.withColumn("total", half_up(ratio(F.col("target_records").cast("double"), F.sum(F.col("share") * F.col("per_event")).over(site))))
        t = t.withColumn("quota", F.col("total") * F.col("share"))
        t = t.withColumn("whole", F.floor("quota").cast("long")).withColumn("left", F.col("total") - F.sum("whole").over(site))
        rank = F.row_number().over(site.orderBy((F.col("quota") - F.col("whole")).desc(), "class_rank"))
        t = t.withColumn("events", F.col("whole") + (rank <= F.col("left")).cast("long"))
    fits = F.col("duration_us") <= F.col("span_us") + F.col("step_us")
    t = t.withColumn("events", F.when(fits & (F.col("share") > 0), F.col("events")).otherwise(F.lit(0).cast("long")))
    return t.withColumn("planned", F.col("events") * F.col("per_event")).select("site_id", "gap_class", "class_rank", "events", "per_event", "planned", "target_records")


def site_spans(df: DataFrame, steps: DataFrame, is_available: Column) -> DataFrame:
    """site_id, n_available, step_us, span_us of each site."""
    ends = df.groupBy("site_id").agg(F.count_if(is_available).alias("n_available"), F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("span_us"))
    return ends.join(steps, "site_id").select("site_id", "n_available", "step_us", "span_us")


def _daily(rows: DataFrame) -> DataFrame:
    """site_id, day, n, before, free_before, first_us of rows (site_id, us, available): totals of a day and of those before it."""
    days = rows.groupBy("site_id", "day").agg(F.count("*").alias("n"), F.count_if("available").alias("free"))
    before = Window.partitionBy("site_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    return days.select("site_id", "day", "n", "free", past("n").alias("before"), past("free").alias("free_before"))


_DAY_US = 86_400 * 10**6


def _rows_before(points: DataFrame, rows: DataFrame, days: DataFrame) -> DataFrame:
    """points (site_id, point, us) with at and free: rows of the site before us, and those of them that are available.

    The totals of the days before come by a window over days and points; only the rows of a point's own day meet it.
    """
    points = points.withColumn("day", F.floor(F.col("us") / _DAY_US).cast("long"))
    passed = days.select("site_id", "day", F.lit(1).alias("kind"), (F.col("before") + F.col("n")).alias("_n"), (F.col("free_before") + F.col("free")).alias("_free"), F.lit(None).cast("long").alias("point"), F.lit(None).cast("long").alias("us"))
    asked = points.select("site_id", "day", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("_n"), F.lit(None).cast("long").alias("_free"), "point", "us")
    so_far = Window.partitionBy("site_id").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = passed.unionByName(asked).withColumns({c: F.coalesce(F.last(c, True).over(so_far), F.lit(0).cast("long")) for c in ("_n", "_free")}).where("kind = 0")
    own = both.select("site_id", "day", "point", "us").join(rows.select("site_id", "day", F.col("us").alias("_us"), "available"), ["site_id", "day"]).where("_us < us")
    own = own.groupBy("site_id", "point").agg(F.count("*").alias("_k"), F.count_if("available").alias("_kf"))
    out = both.select("site_id", "point", "us", "_n", "_free").join(own, ["site_id", "point"], "left")
    zero = F.lit(0).cast("long")
    return out.select("site_id", "point", "us", (F.col("_n") + F.coalesce("_k", zero)).alias("at"), (F.col("_free") + F.coalesce("_kf", zero)).alias("free"))


def _stamps_at(points: DataFrame, rows: DataFrame, days: DataFrame) -> DataFrame:
    """points (site_id, point, at) with us: the stamp of the row at that place of its site, from 0."""
    holds = days.select("site_id", F.col("before").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point"), "day")
    asked = points.select("site_id", "at", F.lit(1).alias("kind"), "point", F.lit(None).cast("long").alias("day"))
    so_far = Window.partitionBy("site_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    day_of = holds.unionByName(asked).withColumns({"day": F.last("day", True).over(so_far), "_first": F.last(F.when(F.col("kind") == 0, F.col("at")), True).over(so_far)}).where("kind = 1")
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("site_id", "day").orderBy("us")) - 1).select("site_id", "day", "_k", "us")
    return day_of.withColumn("_k", F.col("at") - F.col("_first")).join(numbered, ["site_id", "day", "_k"]).select("site_id", "point", "at", "us")


def place(df: DataFrame, steps: DataFrame, is_available: Column, scenario: GapScenario, seed: int = 42, on_shortfall: str = "warn") -> DataFrame:
    """Gaps of each site, placed at random: longest class first, each start drawn until its gap fits and holds enough.

    Each choice depends on those before it, so a site's choices are made by one task - of its draws alone. A round a
    class: every start that could be drawn is listed, Spark finds its stamp, its end and the available rows within by
    totals of days and the rows of two days, and the task walks through the answers. No task holds a site's rows; what
    a site has there grows with its planned gaps times max_attempts.
    on_shortfall: warn, raise or ignore where fewer gaps could be placed than planned.
    """
    if on_shortfall not in ("warn", "raise", "ignore"):
        raise GapError(f"unknown on_shortfall {on_shortfall!r}; known are warn, raise, ignore")
    spark = df.sparkSession
    plan = allocate(site_spans(df, steps, is_available), scenario.table(spark), scenario.missing_fraction, scenario.basis)
    plan = cut(plan)
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    rows = df.select("site_id", us.alias("us"), is_available.alias("available")).withColumn("day", F.floor(F.col("us") / _DAY_US).cast("long"))
    rows = cut(rows)  # every round reads it; the other tables that are cut are small
    days = cut(_daily(rows))
    last = rows.groupBy("site_id").agg(F.max("us").alias("last_us"))
    steps = cut(steps.select("site_id", "step_us"))
    durations = {c: micros(d) for c, d in scenario.durations.items()}
    attempts, overlap, least = scenario.max_attempts, scenario.allow_overlap, scenario.min_observed_fraction

    # history: what each class before drew, so that a site's generator goes on where it was
    kept, kept_schema = None, "site_id string, start long, rank int, gap_class string, n_expected long, lo long, hi long, n long"
    history = spark.createDataFrame([], "site_id string, starts long, draws long, rank int")
    order = sorted(CLASSES, key=lambda c: (-durations[c], CLASSES.index(c)))
    for turn, name in enumerate(order):
        length = durations[name]
        asked = plan.where((F.col("gap_class") == name) & (F.col("events") > 0)).join(last, "site_id").join(steps, "site_id")
        ends = asked.select("site_id", F.lit(0).cast("long").alias("point"), (F.col("last_us") + F.col("step_us") - length + 1).alias("us"))
        first = asked.join(_rows_before(ends, rows, days).select("site_id", F.col("at").alias("starts")), "site_id").where("starts > 0")
        first = cut(first.select("site_id", "events", "per_event", "starts"))

        def drawn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                return pd.DataFrame({"site_id": [], "point": [], "at": []})
            rng = np.random.default_rng(seed)
            for starts, draws in right.sort_values("rank")[["starts", "draws"]].itertuples(index=False):
                for _ in range(draws):
                    rng.integers(starts)
            starts, most = int(left["starts"].iloc[0]), int(left["events"].iloc[0]) * attempts
            return pd.DataFrame({"site_id": left["site_id"].iloc[0], "point": np.arange(most), "at": [int(rng.integers(starts)) for _ in range(most)]})

        draws = first.groupBy("site_id").cogroup(history.groupBy("site_id")).applyInPandas(drawn, "site_id string, point long, at long")
        draws = cut(draws)
        begun = _stamps_at(draws.select("site_id", "at").distinct().withColumn("point", F.col("at")), rows, days).select("site_id", F.col("at").alias("lo"), "us")
        begun = cut(begun)
        where = lambda shift: _rows_before(begun.select("site_id", F.col("lo").alias("point"), (F.col("us") + shift).alias("us")), rows, days)
        found = where(0).select("site_id", F.col("point").alias("lo"), F.col("us").alias("start"), F.col("free").alias("free_lo"))
        found = found.join(where(length).select("site_id", F.col("point").alias("lo"), F.col("at").alias("hi"), F.col("free").alias("free_hi")), ["site_id", "lo"])
        tries = draws.join(first, "site_id").join(found.withColumnRenamed("lo", "at"), ["site_id", "at"])
        tries = tries.select("site_id", F.lit(name).alias("gap_class"), "events", "per_event", "starts", "point", F.col("at").alias("lo"), "hi", "start", (F.col("free_hi") - F.col("free_lo")).alias("n"))

        def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            columns = [c.split()[0] for c in kept_schema.split(", ")] + ["starts", "draws"]
            if left.empty:
                return pd.DataFrame(columns=columns)
            taken = list(zip(right["lo"], right["hi"])) if len(right) else []
            events, expected, out, used, failed = int(left["events"].iloc[0]), int(left["per_event"].iloc[0]), [], 0, 0
            for t in left.sort_values("point").itertuples(index=False):
                used += 1
                if (overlap or not any(a < t.hi and t.lo < b for a, b in taken)) and t.n + 1e-9 >= least * expected:
                    taken.append((t.lo, t.hi))
                    out.append((t.site_id, t.start, CLASSES.index(t.gap_class), t.gap_class, expected, t.lo, t.hi, t.n))
                    failed = 0
                else:
                    failed += 1
                if len(out) == events or failed == attempts:
                    break
            site, starts = left["site_id"].iloc[0], int(left["starts"].iloc[0])
            out.append((site, 0, -1, None, 0, 0, 0, 0))  # how many draws the class took
            return pd.DataFrame([(*o, starts, used) for o in out], columns=columns)

        so_far = kept if kept is not None else spark.createDataFrame([], kept_schema)
        made = cut(tries.groupBy("site_id").cogroup(so_far.groupBy("site_id")).applyInPandas(choose, kept_schema + ", starts long, draws long"))
        history = history.unionByName(made.where("gap_class is null").select("site_id", "starts", "draws", F.lit(turn).alias("rank")))
        kept = so_far.unionByName(made.where("gap_class is not null").drop("starts", "draws"))
    number = F.row_number().over(Window.partitionBy("site_id", "gap_class").orderBy("start", "lo"))
    stamp = lambda c: F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01").cast("timestamp_ntz"))
    length = F.element_at(F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.lit(durations[c]))]), F.col("gap_class"))
    gaps = kept.select(
        "site_id", F.concat("gap_class", F.lit("-"), F.lpad(number.cast("string"), 2, "0")).alias("gap_id"), "gap_class", stamp(F.col("start")).alias("start"), stamp(F.col("start") + length).alias("end"),
        "n_expected", (F.col("hi") - F.col("lo")).alias("n_rows"), F.col("n").alias("n_observed_before_masking"), (F.col("n") / F.col("n_expected")).alias("observed_fraction"),
    )
    if on_shortfall != "ignore":
        for text in shortfalls(plan, gaps):
            if on_shortfall == "raise":
                raise GapError(text)
            warnings.warn(text, GapWarning, stacklevel=2)
    return gaps


def shortfalls(plan: DataFrame, gaps: DataFrame) -> list[str]:
    """A text for each site and class of the plan (site_id, gap_class, events) that got fewer gaps than planned."""
    placed = gaps.groupBy("site_id", "gap_class").agg(F.count("*").alias("n"))
    short = plan.join(placed, ["site_id", "gap_class"], "left").where("coalesce(n, 0) < events").orderBy("site_id", "gap_class")
    return [f"site {r['site_id']}: {r['n'] or 0} of {r['events']} gaps of class {r['gap_class']} could be placed" for r in short.collect()]


def count_rows(df: DataFrame, intervals: DataFrame, steps: DataFrame, is_available: Column) -> DataFrame:
    """The manifest of given intervals (site_id, gap_id, gap_class, start, end): rows and available rows in each.

    observed_fraction is over the grid rows that the interval covers, not over the rows there are.
    """
    inside = masks.gap_rows(df.select("site_id", "ts", is_available.alias("_ok")), intervals)
    counts = inside.groupBy("site_id", "gap_id").agg(F.count("*").alias("n_rows"), F.count_if("_ok").alias("n_observed_before_masking"))
    out = intervals.join(steps, "site_id").join(counts, ["site_id", "gap_id"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({
        "n_expected": F.floor(F.timestamp_diff("MICROSECOND", "start", "end") / F.col("step_us")).cast("long"),
        "n_rows": F.coalesce("n_rows", zero), "n_observed_before_masking": F.coalesce("n_observed_before_masking", zero),
    })
    out = out.withColumn("observed_fraction", ratio(F.col("n_observed_before_masking"), F.col("n_expected")))
    return out.select("site_id", "gap_id", "gap_class", "start", "end", "n_expected", "n_rows", "n_observed_before_masking", "observed_fraction")


def replay(df: DataFrame, stored: DataFrame, steps: DataFrame, is_available: Column) -> DataFrame:
    """Each gap of a stored manifest with the rows it withheld then and withholds now, and whether these are the same."""
    now = count_rows(df, stored.select("site_id", "gap_id", "gap_class", "start", "end"), steps, is_available)
    now = now.select("site_id", "gap_id", F.col("n_rows").alias("now_rows"), F.col("n_observed_before_masking").alias("now_observed"))
    out = stored.join(now, ["site_id", "gap_id"], "left")
    zero = F.lit(0).cast("long")
    out = out.select("site_id", "gap_id", "gap_class", "n_rows", F.coalesce("now_rows", zero).alias("now_rows"), F.col("n_observed_before_masking").alias("n_observed"), F.coalesce("now_observed", zero).alias("now_observed"))
    return out.withColumn("same", (F.col("n_rows") == F.col("now_rows")) & (F.col("n_observed") == F.col("now_observed")))


def save(gaps: DataFrame, path: str, scenario: GapScenario, seed: int, targets: Sequence[str], notes: Sequence[str] = ()) -> None:
    """A manifest that can be replayed: the gaps as Parquet, and how they came about beside them."""
    meta = {"format": MANIFEST_FORMAT, "scenario": describe(scenario), "seed": seed, "targets": list(targets), "warnings": list(notes)}
    gaps.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("errorifexists").parquet(f"{path}/gaps")
    gaps.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(gaps, how they came about) of a saved manifest."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    except (ValueError, TypeError, AnalysisException) as e:
        raise GapError(f"{path} holds no gap manifest: {e}") from e
    if meta.get("format") != MANIFEST_FORMAT:
        raise GapError(f"{path} has gap manifest format {meta.get('format')}, not {MANIFEST_FORMAT}")
    return spark.read.schema(SCHEMA).parquet(f"{path}/gaps"), meta


def require_replay(df: DataFrame, stored: DataFrame, steps: DataFrame, is_available: Column) -> DataFrame:
    """The stored gaps, if they withhold the same rows of df as they did."""
    if (row := replay(df, stored, steps, is_available).where("not same").orderBy("site_id", "gap_id").first()) is not None:
        raise GapError(f"site {row['site_id']}, gap {row['gap_id']}: {row['now_observed']} of {row['now_rows']} rows observed, {row['n_observed']} of {row['n_rows']} when it was made")
    return stored


def known_gaps(df: DataFrame, plan: Sequence[tuple[str, int]], durations: Mapping[str, timedelta]) -> DataFrame:
    """Intervals of a fixed plan of (class, start day) after each site's first stamp; overlap and ends past the series are refused."""
    spark = df.sparkSession
    rows = sorted(((day, name, micros(durations[name])) for name, day in plan), key=lambda r: r[0])
    for a, b in zip(rows, rows[1:]):
        if a[0] * 86400 * 10**6 + a[2] > b[0] * 86400 * 10**6:
            raise GapError(f"the planned gaps at days {a[0]} and {b[0]} overlap")
    numbers: dict[str, int] = {}
    named = []
    for day, name, us in rows:
        numbers[name] = numbers.get(name, 0) + 1
        named.append((f"{name}-{numbers[name]:02d}", name, day * 86400 * 10**6, us))
    t = spark.createDataFrame(named, "gap_id string, gap_class string, offset_us long, duration_us long")
    ends = df.groupBy("site_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    out = ends.crossJoin(F.broadcast(t)).withColumn("start", F.timestamp_add("MICROSECOND", F.col("offset_us"), F.col("first")))
    out = out.withColumn("end", F.timestamp_add("MICROSECOND", F.col("duration_us"), F.col("start")))
    if out.where("start > last").limit(1).count():
        raise GapError("a planned gap starts after the series ends")
    return out.select("site_id", "gap_id", "gap_class", "start", "end")


def shares(gaps: DataFrame, classes: DataFrame, withheld: DataFrame, scenario: GapScenario) -> DataFrame:
    """One row per site and class: gaps, records, shares on both bases, errors against the mix, and the achieved fraction.

    withheld: site_id, n_available, n_withheld_observed. Every class appears, with zeros if it has no gap.
    """
    per = gaps.groupBy("site_id", "gap_class").agg(F.count("*").alias("events"), F.sum("n_observed_before_masking").alias("records"))
    frame = withheld.crossJoin(F.broadcast(classes.select("gap_class", "class_rank", "share"))).join(per, ["site_id", "gap_class"], "left")
    zero, site = F.lit(0).cast("long"), Window.partitionBy("site_id")
    frame = frame.withColumns({"events": F.coalesce("events", zero), "records": F.coalesce("records", zero)})
    frame = frame.withColumns({
        "event_share": F.coalesce(ratio(F.col("events"), F.sum("events").over(site)), F.lit(0.0)),
        "record_share": F.coalesce(ratio(F.col("records"), F.sum("records").over(site)), F.lit(0.0)),
        "achieved_fraction": ratio(F.col("n_withheld_observed"), F.col("n_available")),
    })
    base = F.col("record_share" if scenario.basis == "missing_records" else "event_share")
    frame = frame.withColumns({"mix_error": base - F.col("share"), "fraction_error": F.col("achieved_fraction") - F.lit(scenario.missing_fraction)})
    return frame.withColumns({
        "within_mix_tolerance": F.abs("mix_error") <= scenario.mix_tolerance,
        "within_fraction_tolerance": F.coalesce(F.abs("fraction_error") <= scenario.fraction_tolerance, F.lit(False)),
    }).select(
        "site_id", "gap_class", "events", "records", "event_share", "record_share", "mix_error", "within_mix_tolerance",
        "achieved_fraction", "fraction_error", "within_fraction_tolerance",
    )


def achieved(df: DataFrame, gaps: DataFrame, is_available: Column, scenario: GapScenario) -> DataFrame:
    """shares() of placed gaps (with their row counts) against the rows they were placed in."""
    held = masks.with_holdout(df.select("site_id", "ts", is_available.alias("_ok")), gaps.select("site_id", "start", "end"))
    held = held.groupBy("site_id").agg(F.count_if("_ok").alias("n_available"), F.count_if(F.col("_ok") & F.col("holdout")).alias("n_withheld_observed"))
    return shares(gaps, scenario.table(df.sparkSession), held, scenario)


def warn_on_tolerance(table: DataFrame) -> list[str]:
    """Texts of what missed its tolerance; each is warned of as well."""
    notes = []
    for r in table.where("not within_mix_tolerance or not within_fraction_tolerance").collect():
        notes.append(f"site {r['site_id']}, class {r['gap_class']}: share off by {r['mix_error']:+.3f}, fraction by {r['fraction_error'] or 0:+.3f}")
        warnings.warn(notes[-1], GapWarning, stacklevel=2)
    return notes


def describe(scenario: GapScenario) -> dict:
    return {"missing_fraction": scenario.missing_fraction, "basis": scenario.basis, "mix": dict(scenario.mix), "durations": {c: iso_duration(d) for c, d in scenario.durations.items()}}
