"""Queries over time axes, masks, features and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, leakage, legacy, masks, timeaxis
from ..sources import tables
from .frames import GAP, INTERVALS, SITE, intervals, intervals_sql, show, site_frame, sql, table, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


HOURLY = "h AS (SELECT event_type AS site_id, date_trunc('hour', ts) AS ts, event_id, value FROM events)"


def hourly(spark, sf_dir):
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id"), hour.alias("ts"), "event_id", "value")


@query("q_time_duplicates", sql([HOURLY], f"SELECT site_id, {text('ts')} AS ts, count(*) AS n FROM h GROUP BY site_id, h.ts HAVING count(*) > 1"))
def time_duplicates(spark, sf_dir):
    return show(timeaxis.duplicate_stamps(hourly(spark, sf_dir)))


def _dedupe(policy):
    return lambda spark, sf_dir: show(timeaxis.resolve_duplicates(hourly(spark, sf_dir), policy, "event_id"))


for _policy, _order in (("first", "ASC"), ("last", "DESC")):
    query(f"q_time_dedupe_{_policy}", sql([HOURLY], f"SELECT site_id, {text('ts')} AS ts, event_id, round(value, 6) AS value FROM h QUALIFY row_number() OVER (PARTITION BY site_id, h.ts ORDER BY event_id {_order}) = 1"))(_dedupe(f"keep_{_policy}"))

STEPS = """gaps AS (SELECT site_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id ORDER BY ts)) AS d FROM site),
steps AS (SELECT site_id, d AS step_us FROM (SELECT site_id, d, count(*) AS c FROM gaps WHERE d > 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY c DESC, d) = 1)"""


@query("q_time_cadence", sql([SITE, STEPS], "SELECT site_id, step_us, count(*) AS n_steps, count(*) FILTER (d % step_us <> 0) AS n_odd FROM gaps JOIN steps USING (site_id) WHERE d > 0 GROUP BY 1, 2"))
def time_cadence(spark, sf_dir):
    return timeaxis.cadence(site_frame(spark, sf_dir))


HALF_HOUR = 1_800_000_000


def half_hours(df):
    return timeaxis.step_of(df, "30min")


@query("q_time_axis_summary", sql([SITE, f"""ends AS (SELECT site_id, min(ts) AS a, max(ts) AS b FROM site GROUP BY 1),
t AS (SELECT s.site_id, a, b, count(*) AS n, count(*) FILTER ((epoch_us(ts) - epoch_us(a)) % {HALF_HOUR} <> 0) AS n_off_grid FROM site s JOIN ends USING (site_id) GROUP BY ALL)"""], f"""
SELECT site_id, {HALF_HOUR}::BIGINT AS step_us, {text('a')} AS start, {text('b')} AS "end", n, n_off_grid, e AS n_expected, e - (n - n_off_grid) AS n_missing,
    0::BIGINT AS n_duplicates_removed, e - (n - n_off_grid) = 0 AND n_off_grid = 0 AS is_regular, round((n - n_off_grid) / e, 6) AS coverage
FROM (SELECT *, (epoch_us(b) - epoch_us(a)) // {HALF_HOUR} + 1 AS e FROM t)"""))
def time_axis_summary(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    return show(timeaxis.axis_summary(df, half_hours(df)))


@query("q_time_missing_grid", sql([SITE, "ends AS (SELECT site_id, min(ts) AS a, max(ts) AS b FROM site GROUP BY 1)"], f"""
SELECT site_id, {text('g.ts')} AS ts FROM (SELECT site_id, unnest(generate_series(a, b, INTERVAL 30 minutes)) AS ts FROM ends) g ANTI JOIN site USING (site_id, ts)"""))
def time_missing_grid(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    return show(timeaxis.missing_rows(df, half_hours(df)))


@query("q_time_off_grid", sql([SITE, "ends AS (SELECT site_id, min(ts) AS a FROM site GROUP BY 1)"], f"SELECT site_id, {text('ts')} AS ts FROM site JOIN ends USING (site_id) WHERE (epoch_us(ts) - epoch_us(a)) % {3 * HALF_HOUR} <> 0"))
def time_off_grid(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    return show(timeaxis.off_grid(df, timeaxis.step_of(df, "90min")))


@query("q_time_elapsed_hours", sql([SITE], f"SELECT site_id, {text('ts')} AS ts, round((epoch_us(site.ts) - min(epoch_us(site.ts)) OVER (PARTITION BY site_id)) / 3.6e9, 6) AS hours FROM site"))
def time_elapsed_hours(spark, sf_dir):
    return show(site_frame(spark, sf_dir).select("site_id", "ts", timeaxis.elapsed_hours().alias("hours")))


def _closed(closed):
    def run(spark, sf_dir):
        a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-06 12:00:00"))
        rows = site_frame(spark, sf_dir).where(timeaxis.interval_mask("ts", a, b, closed))
        return show(rows.groupBy("site_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")))

    return run


for _closed_side, _lo, _hi in (("left", ">=", "<"), ("right", ">", "<="), ("both", ">=", "<="), ("neither", ">", "<")):
    query(f"q_time_interval_closed_{_closed_side}", sql([SITE], f"SELECT site_id, count(*) AS n, {text('min(ts)')} AS first, {text('max(ts)')} AS last FROM site WHERE ts {_lo} TIMESTAMP '2024-01-05 00:00:00' AND ts {_hi} TIMESTAMP '2024-01-06 12:00:00' GROUP BY 1"))(_closed(_closed_side))

HELD = f"""{SITE}, {GAP},
held AS (SELECT site_id, ts, v, sw, qc, coalesce(qc IN (0, 1), false) AND v IS NOT NULL AS observed, EXISTS (SELECT 1 FROM gap WHERE site.ts >= gstart AND site.ts < gend) AS holdout FROM site)"""
OK_FLAGS = (0, 1)


def held_frame(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    out = masks.with_holdout(df, intervals(df)).withColumn("observed", masks.observed("v", "qc", OK_FLAGS))
    return out.withColumn("available", masks.available(F.col("observed")))


@query("q_mask_observed", sql([HELD], f"SELECT site_id, {text('ts')} AS ts, observed FROM held"))
def mask_observed(spark, sf_dir):
    return show(site_frame(spark, sf_dir).select("site_id", "ts", masks.observed("v", "qc", OK_FLAGS).alias("observed")))


@query("q_mask_holdout", sql([HELD], f"SELECT site_id, {text('ts')} AS ts, holdout FROM held"))
def mask_holdout(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    return show(masks.with_holdout(df, intervals(df)).select("site_id", "ts", "holdout"))


@query("q_mask_available", sql([HELD], f"SELECT site_id, {text('ts')} AS ts, observed AND NOT holdout AS available, CASE WHEN NOT holdout THEN round(v, 6) END AS visible FROM held"))
def mask_available(spark, sf_dir):
    return show(held_frame(spark, sf_dir).select("site_id", "ts", "available", masks.hide("v").alias("visible")))


@query("q_mask_subsets", sql([SITE], "SELECT site_id, subset, count(*) AS n, round(avg(v), 6) AS mean FROM site, unnest(['all', CASE WHEN sw > 20 THEN 'daytime' ELSE 'nighttime' END]) AS s(subset) GROUP BY 1, 2"))
def mask_subsets(spark, sf_dir):
    rows = site_frame(spark, sf_dir).select("site_id", "v", F.explode(masks.subsets("sw")).alias("subset"))
    return show(rows.groupBy("site_id", "subset").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))


@query("q_mask_gap_class", sql([SITE, GAP], f"""
SELECT site_id, {text('site.ts')} AS ts, max_by(gap_class, gap_no) AS gap_class FROM site LEFT JOIN gap ON site.ts >= gstart AND site.ts < gend GROUP BY site_id, site.ts"""))
def mask_gap_class(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    return show(masks.with_gap_class(df, intervals(df)).select("site_id", "ts", "gap_class"))


def _radiation(convention):
    return lambda spark, sf_dir: show(site_frame(spark, sf_dir).select("site_id", "ts", features.radiation_tag("sw", convention=convention).alias("radiation"), features.encode(features.radiation_tag("sw", convention=convention), features.RADIATION).alias("code")))


for _convention, _lo, _hi in (("inclusive", "<", ">"), ("exclusive", "<=", ">=")):
    _tag = f"CASE WHEN sw {_lo} 10 THEN %s WHEN sw {_hi} 100 THEN %s ELSE %s END"
    query(f"q_feat_radiation_{_convention}", sql([SITE], f"SELECT site_id, {text('ts')} AS ts, {_tag % (repr('weak'), repr('strong'), repr('medium'))} AS radiation, {_tag % ('0.0::DOUBLE', '2.0::DOUBLE', '1.0::DOUBLE')} AS code FROM site"))(_radiation(f"medium_{_convention}"))


def _season(side):
    return lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", features.season_tag("o_orderdate", side).alias("season"))


for _side, _shift in (("north", 0), ("south", 6)):
    query(f"q_feat_season_{_side}", f"""SELECT o_orderkey, ['winter', 'spring', 'summer', 'autumn'][(((month(o_orderdate) + {_shift} - 1) % 12 + 1) % 12) // 3 + 1] AS season FROM orders""")(_season(_side))

VISIBLE = f"""{HELD},
vis AS (SELECT site_id, ts::DATE AS day, ts, sw, CASE WHEN observed AND NOT holdout THEN v END AS v FROM held),
days AS (SELECT site_id, day, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, stddev_samp(v) AS std FROM vis GROUP BY 1, 2)"""
MINIMUM, REACH = 14, 3


def _daily(strategy):
    def run(spark, sf_dir):
        df = held_frame(spark, sf_dir).withColumn("shown", F.when(F.col("available"), F.col("v")))
        return show(features.day_statistics(df, "shown", strategy, MINIMUM, REACH))

    return run


_OUT = f"site_id, {text('day', 'day')} AS day, n AS n_visible"
_cut = ", ".join(f"CASE WHEN n >= {MINIMUM} THEN round({c}, 6) END AS {c}" for c in ("q1", "q2", "q3", "std"))
query("q_daily_stats_missing", sql([VISIBLE], f"SELECT {_OUT}, {_cut} FROM days"))(_daily("missing"))
query("q_daily_stats_within_day", sql([VISIBLE], f"SELECT {_OUT}, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("q1", "q2", "q3", "std")) + " FROM days"))(_daily("within_day_available"))
query("q_daily_stats_neighbor", sql([VISIBLE, f"""near AS (
    SELECT a.site_id, a.day, a.n, b.q1, b.q2, b.q3, b.std
    FROM days a LEFT JOIN days b ON a.site_id = b.site_id AND b.n >= {MINIMUM} AND abs(a.day - b.day) <= CASE WHEN a.n >= {MINIMUM} THEN 0 ELSE {REACH} END
    QUALIFY row_number() OVER (PARTITION BY a.site_id, a.day ORDER BY abs(a.day - b.day), b.day) = 1)"""], f"SELECT {_OUT}, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("q1", "q2", "q3", "std")) + " FROM near"))(_daily("neighbor_day_fallback"))
ROLLING = f"""pool AS (
    SELECT d.site_id, d.day, count(v.v) AS m, quantile_cont(v.v, 0.25) AS q1, quantile_cont(v.v, 0.5) AS q2, quantile_cont(v.v, 0.75) AS q3, stddev_samp(v.v) AS std
    FROM days d JOIN vis v ON v.site_id = d.site_id AND v.day BETWEEN d.day - {REACH} AND d.day + {REACH} AND v.v IS NOT NULL WHERE d.n < {MINIMUM} GROUP BY 1, 2),
rolled AS (SELECT d.site_id, d.day, d.n, """ + ", ".join(f"CASE WHEN d.n >= {MINIMUM} THEN d.{c} WHEN m >= {MINIMUM} THEN p.{c} END AS {c}" for c in ("q1", "q2", "q3", "std")) + " FROM days d LEFT JOIN pool p USING (site_id, day))"
query("q_daily_stats_rolling", sql([VISIBLE, ROLLING], f"SELECT {_OUT}, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("q1", "q2", "q3", "std")) + " FROM rolled"))(_daily("rolling_available"))


@query("q_feature_matrix", sql([VISIBLE, ROLLING], f"""
SELECT vis.site_id, {text('vis.ts')} AS ts, round(sw, 6) AS sw, CASE WHEN sw < 10 THEN 0.0::DOUBLE WHEN sw > 100 THEN 2.0 ELSE 1.0 END AS radiation, 0.0::DOUBLE AS season,
    round((epoch_us(vis.ts) - min(epoch_us(vis.ts)) OVER (PARTITION BY vis.site_id)) / 3.6e9, 6) AS time_distance_hours,
    round(q1, 6) AS v_daily_q1, round(q2, 6) AS v_daily_q2, round(q3, 6) AS v_daily_q3, round(std, 6) AS v_daily_std
FROM vis JOIN rolled ON vis.site_id = rolled.site_id AND vis.day = rolled.day"""))
def feature_matrix(spark, sf_dir):
    df = held_frame(spark, sf_dir).withColumn("shown", F.when(F.col("available"), F.col("v")))
    return show(features.feature_matrix(df, ["sw"], "sw", "v", "shown", strategy="rolling_available", minimum=MINIMUM, window_days=REACH))


LEGACY = f"""{HELD},
rows AS (SELECT site_id, ts, CASE WHEN observed THEN v END AS v, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS pos FROM held),
""" + """marks AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p0, last_value(v IGNORE NULLS) OVER w AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER x AS p1, first_value(v IGNORE NULLS) OVER x AS v1 FROM rows
    WINDOW w AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT site_id, ts, pos, CASE WHEN v IS NOT NULL THEN v WHEN p0 IS NULL THEN NULL WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (p1 - p0) * (pos - p0) END AS v FROM marks),
lday AS (SELECT site_id, ts::DATE AS day, max(v) AS s0, min(v) AS s1, avg(v) AS s2, stddev_samp(v) AS s3, quantile_cont(v, 0.25) AS s4, quantile_cont(v, 0.5) AS s5, quantile_cont(v, 0.75) AS s6 FROM filled GROUP BY 1, 2),
joined AS (SELECT f.site_id, f.ts, f.pos, s0, s1, s2, s3, s4, s5, s6 FROM filled f LEFT JOIN lday d ON f.site_id = d.site_id AND d.day = CASE WHEN f.ts = date_trunc('day', f.ts) THEN f.ts::DATE ELSE f.ts::DATE + 1 END)"""
_names = ("max", "min", "mean", "std", "p25", "p50", "p75")
LEGACY_OUT = ",\n".join(
    f"""round(CASE WHEN s{k} IS NOT NULL THEN s{k} WHEN last_value(CASE WHEN s{k} IS NOT NULL THEN pos END IGNORE NULLS) OVER w IS NULL THEN NULL
    WHEN first_value(CASE WHEN s{k} IS NOT NULL THEN pos END IGNORE NULLS) OVER x IS NULL THEN last_value(s{k} IGNORE NULLS) OVER w
    ELSE last_value(s{k} IGNORE NULLS) OVER w + (first_value(s{k} IGNORE NULLS) OVER x - last_value(s{k} IGNORE NULLS) OVER w)
        / (first_value(CASE WHEN s{k} IS NOT NULL THEN pos END IGNORE NULLS) OVER x - last_value(CASE WHEN s{k} IS NOT NULL THEN pos END IGNORE NULLS) OVER w)
        * (pos - last_value(CASE WHEN s{k} IS NOT NULL THEN pos END IGNORE NULLS) OVER w) END, 6) AS v_{n}"""
    for k, n in enumerate(_names)
)


@query("q_legacy_daily_stats", sql([LEGACY], f"""SELECT site_id, {text('joined.ts')} AS ts, {LEGACY_OUT} FROM joined
WINDOW w AS (PARTITION BY site_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY site_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""))
def legacy_daily_stats(spark, sf_dir):
    df = held_frame(spark, sf_dir).withColumn("shown", F.when(F.col("observed"), F.col("v")))
    return show(legacy.legacy_daily_statistics(df, "v", "shown"))


@query("q_legacy_season", "SELECT o_orderkey, ((month(o_orderdate) % 12 + 3) // 3)::BIGINT AS north, (((month(o_orderdate) + 6) % 12 + 3) // 3)::BIGINT AS south FROM orders")
def legacy_season(spark, sf_dir):
    return show(table(spark, sf_dir, "orders").select("o_orderkey", legacy.legacy_season_code("o_orderdate").alias("north"), legacy.legacy_season_code("o_orderdate", "south").alias("south")))


@query("q_legacy_radiation_rank", sql([SITE], f"SELECT site_id, {text('ts')} AS ts, CASE WHEN sw < 10 THEN 1 WHEN sw > 10 AND sw < 100 THEN 2 WHEN sw > 100 THEN 3 ELSE 0 END::BIGINT AS rank FROM site"))
def legacy_radiation_rank(spark, sf_dir):
    return show(site_frame(spark, sf_dir).select("site_id", "ts", legacy.legacy_radiation_rank("sw").alias("rank")))


@query("q_legacy_calendar", "SELECT o_orderkey, dayofyear(o_orderdate)::DOUBLE AS doy, year(o_orderdate)::DOUBLE AS year FROM orders")
def legacy_calendar(spark, sf_dir):
    made = legacy.legacy_calendar("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in made.items()])


_SAFE = ("sw", "radiation", "season", "time_distance_hours", "v_daily_q1", "v_daily_q2", "v_daily_q3", "v_daily_std")


@query("q_leak_probe_paper_safe", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 0::BIGINT)" for n in _SAFE) + ") AS t(feature, n_moved)")
def leak_probe_paper_safe(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    return leakage.moved_features(df, intervals(df), "v", ["sw"], "sw", qc="qc", accepted=OK_FLAGS, strategy="rolling_available", minimum=MINIMUM, window_days=REACH)


@query("q_leak_probe_legacy", "SELECT * FROM (VALUES " + ", ".join(f"('v_{n}', true)" for n in _names) + ", ('season', false), ('radiation', false), ('doy', false), ('year', false)) AS t(feature, moved)")
def leak_probe_legacy(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    moved = leakage.moved_features(df, intervals(df), "v", ["sw"], "sw", qc="qc", accepted=OK_FLAGS, legacy_mode=True)
    return moved.select("feature", (F.col("n_moved") > 0).alias("moved"))


@query("q_qc_summary", sql([SITE], """SELECT site_id, count(*) AS n_rows, count(*) FILTER (qc IS NULL) AS n_unflagged, count(*) FILTER (qc = 0 AND v IS NOT NULL) AS n_measured,
    count(*) FILTER (coalesce(qc <> 0, true) AND v IS NOT NULL) AS n_prefilled, count(*) FILTER (v IS NULL) AS n_missing_value FROM site GROUP BY 1"""))
def qc_summary(spark, sf_dir):
    return tables.qc_summary(site_frame(spark, sf_dir), "qc", "v")


@query("q_qc_flags", sql([SITE], "SELECT site_id, qc::BIGINT AS flag, count(*) AS n FROM site GROUP BY 1, 2"))
def qc_flags(spark, sf_dir):
    return show(tables.flag_counts(site_frame(spark, sf_dir), "qc"))


@query("q_sentinel", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, nullif(l_quantity, 7) AS l_quantity, nullif(l_discount, 7) AS l_discount FROM lineitem")
def sentinel(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), "l_quantity", "l_discount")
    return tables.replace_sentinel(li, 7.0, ["l_quantity", "l_discount"])


@query("q_parse_stamp", f"SELECT event_id, {text('date_trunc($$minute$$, ts)')} AS ts FROM events".replace("$$", "'"))
def parse_stamp(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.date_format("ts", "yyyyMMddHHmm"), F.lit(".0")).alias("stamp"))
    return show(raw.select("event_id", tables.parse_stamp("stamp").alias("ts")))


SINGLE = intervals_sql(INTERVALS[:2])
