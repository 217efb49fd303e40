"""Queries over gaps, scores, reports, models and fills."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import published
from ..operators import fill, gaps, masks, metrics, model, reports, timeaxis
from .config import FeatureConfig, RunConfig
from .frames import CORE, GAP, LONG_GAP, LONG_INTERVALS, PAIRS, SITE, SITES, TIDY, intervals, pairs, show, site_frame, sites, sql, text, tidy
from .queries_axis import HELD, MINIMUM, OK_FLAGS, held_frame
from .validation import validate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- gaps ---------------------------------------------------------------------------------------------------------

SMALL = gaps.GapScenario(durations={"short": timedelta(hours=12), "long": timedelta(days=1), "very_long": timedelta(days=3)}, missing_fraction=0.3)
CLASS = "class AS (SELECT * FROM (VALUES ('short', 0, 0.2::DOUBLE, 24), ('long', 1, 0.3::DOUBLE, 48), ('very_long', 2, 0.5::DOUBLE, 144)) AS c(gap_class, class_rank, share, per_event))"
COUNTS = f"{HELD}, {CLASS}, n AS (SELECT site_id, count(*) FILTER (observed) AS n_available FROM held GROUP BY 1), t AS (SELECT *, floor(0.3::DOUBLE * n_available + 0.5)::BIGINT AS target_records FROM n, class)"


def _available(spark, sf_dir):
    df = site_frame(spark, sf_dir)
    return df, timeaxis.step_of(df, "30min"), masks.observed("v", "qc", OK_FLAGS)


def _allocate(basis):
    def run(spark, sf_dir):
        df, steps, ok = _available(spark, sf_dir)
        return show(gaps.allocate(gaps.site_spans(df, steps, ok), SMALL.table(spark), SMALL.missing_fraction, basis))

    return run


_ALLOCATED = "SELECT site_id, gap_class, class_rank::BIGINT AS class_rank, events, per_event::BIGINT AS per_event, events * per_event AS planned, target_records FROM"
query("q_gap_allocate_records", sql([COUNTS], f"{_ALLOCATED} (SELECT *, floor(share * target_records / per_event + 0.5)::BIGINT AS events FROM t)"))(_allocate("missing_records"))
query("q_gap_allocate_events", sql([COUNTS, """u AS (SELECT *, floor(target_records / sum(share * per_event) OVER (PARTITION BY site_id) + 0.5)::BIGINT AS total FROM t),
w AS (SELECT *, total * share AS quota, floor(total * share)::BIGINT AS whole FROM u)"""], f"""{_ALLOCATED} (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY site_id ORDER BY quota - whole DESC, class_rank)
    <= total - sum(whole) OVER (PARTITION BY site_id) THEN 1 ELSE 0 END AS events FROM w)"""))(_allocate("gap_events"))

MANIFEST = f"""{HELD}, manifest AS (
    SELECT s.site_id, gap_id, gap_class, gstart, gend, (epoch_us(gend) - epoch_us(gstart)) // 1800000000 AS n_expected, count(h.ts) AS n_rows, count(*) FILTER (h.observed) AS n_observed_before_masking
    FROM (SELECT DISTINCT site_id FROM site) s CROSS JOIN gap LEFT JOIN held h ON h.site_id = s.site_id AND h.ts >= gstart AND h.ts < gend GROUP BY ALL)"""


@query("q_gap_manifest_counts", sql([MANIFEST], f"""SELECT site_id, gap_id, gap_class, {text('gstart')} AS start, {text('gend')} AS "end", n_expected, n_rows, n_observed_before_masking,
    round(n_observed_before_masking / n_expected, 6) AS observed_fraction FROM manifest"""))
def gap_manifest_counts(spark, sf_dir):
    df, steps, ok = _available(spark, sf_dir)
    return show(gaps.count_rows(df, intervals(df), steps, ok))


@query("q_gap_shares", sql([MANIFEST, CLASS, """held2 AS (SELECT site_id, count(*) FILTER (observed) AS n_available, count(*) FILTER (observed AND holdout) AS w FROM held GROUP BY 1),
per AS (SELECT site_id, gap_class, count(*) AS events, sum(n_observed_before_masking) AS records FROM manifest GROUP BY 1, 2),
f AS (SELECT site_id, gap_class, share, coalesce(events, 0) AS events, coalesce(records, 0)::BIGINT AS records, w / n_available AS achieved FROM held2 CROSS JOIN class LEFT JOIN per USING (site_id, gap_class)),
g AS (SELECT *, coalesce(events / nullif(sum(events) OVER (PARTITION BY site_id), 0), 0) AS es, coalesce(records / nullif(sum(records) OVER (PARTITION BY site_id), 0), 0) AS rs FROM f)"""], """
SELECT site_id, gap_class, events, records, round(es, 6) AS event_share, round(rs, 6) AS record_share, round(rs - share, 6) AS mix_error, abs(rs - share) <= 0.05 AS within_mix_tolerance,
    round(achieved, 6) AS achieved_fraction, round(achieved - 0.3, 6) AS fraction_error, abs(achieved - 0.3) <= 0.05 AS within_fraction_tolerance FROM g"""))
def gap_shares(spark, sf_dir):
    df, steps, ok = _available(spark, sf_dir)
    held = held_frame(spark, sf_dir).groupBy("site_id").agg(F.count_if("observed").alias("n_available"), F.count_if(F.col("observed") & F.col("holdout")).alias("n_withheld_observed"))
    return show(gaps.shares(gaps.count_rows(df, intervals(df), steps, ok), SMALL.table(spark), held, SMALL))


@query("q_gap_place")
def gap_place(spark, sf_dir):
    df, steps, ok = _available(spark, sf_dir)
    return show(gaps.place(df, steps, ok, SMALL))


PLAN = (("short", 2), ("short", 9), ("long", 5), ("very_long", 15))


@query("q_gap_known", sql([SITE, "ends AS (SELECT site_id, min(ts) AS a FROM site GROUP BY 1)"], f"""
SELECT site_id, gap_id, gap_class, {text('a + to_days(d)')} AS start, {text('a + to_days(d) + to_hours(h)')} AS "end" FROM ends,
    (VALUES ('short-01', 'short', 2, 12), ('long-01', 'long', 5, 24), ('short-02', 'short', 9, 12), ('very_long-01', 'very_long', 15, 72)) AS p(gap_id, gap_class, d, h)"""))
def gap_known(spark, sf_dir):
    return show(gaps.known_gaps(site_frame(spark, sf_dir), PLAN, SMALL.durations))


# --- scores -------------------------------------------------------------------------------------------------------

SCORED = f"{PAIRS}, mp AS (SELECT *, CASE WHEN predicted IS NOT NULL THEN measured END AS m, predicted AS p FROM pairs)"
_round = "round(r2, 6) AS r2, round(slope, 6) AS slope, round(rmse, 6) AS rmse, round(bias, 6) AS bias"


@query("q_metrics_core", sql([SCORED], f"SELECT site_id, n, n_offered, {_round} FROM (SELECT site_id, {CORE} FROM mp GROUP BY 1)"))
def metrics_core(spark, sf_dir):
    return show(pairs(spark, sf_dir).groupBy("site_id").agg(*metrics.core_metrics("measured", "predicted")))


@query("q_metrics_r2_squared_corr", sql([SCORED], "SELECT site_id, round(regr_sxy(p, m) * regr_sxy(p, m) / (regr_sxx(p, m) * regr_syy(p, m)), 6) AS r2 FROM mp GROUP BY 1"))
def metrics_r2_squared_corr(spark, sf_dir):
    return show(pairs(spark, sf_dir).groupBy("site_id").agg(*metrics.core_metrics("measured", "predicted", "squared_correlation")).select("site_id", "r2"))


@query("q_metrics_slope_origin", sql([SCORED], "SELECT site_id, round(sum(m * p) / sum(m * m), 6) AS slope FROM mp GROUP BY 1"))
def metrics_slope_origin(spark, sf_dir):
    return show(pairs(spark, sf_dir).groupBy("site_id").agg(*metrics.core_metrics("measured", "predicted", intercept=False)).select("site_id", "slope"))


LABELLED = f"{SCORED}, {LONG_GAP}, lab AS (SELECT mp.*, gap_class AS gc, gap_id FROM mp LEFT JOIN gap ON ts >= gstart AND ts < gend)"


@query("q_metrics_grid", sql([LABELLED, f"""cells AS (SELECT site_id, gap_class, subset, {CORE} FROM lab, unnest(['all', gc]) AS a(gap_class), unnest(['all', CASE WHEN sw > 20 THEN 'daytime' ELSE 'nighttime' END]) AS b(subset)
    WHERE gap_class IS NOT NULL GROUP BY ALL),
frame AS (SELECT * FROM (SELECT DISTINCT site_id FROM pairs), unnest(['all', 'short', 'long', 'very_long', 'other']) AS a(gap_class), unnest(['all', 'daytime', 'nighttime']) AS b(subset))"""], f"""
SELECT site_id, gap_class, subset, coalesce(n, 0) AS n, coalesce(n_offered, 0) AS n_offered, {_round} FROM frame LEFT JOIN cells USING (site_id, gap_class, subset)"""))
def metrics_grid(spark, sf_dir):
    p = pairs(spark, sf_dir)
    rows = masks.with_gap_class(p, intervals(p, LONG_INTERVALS))
    return show(metrics.metrics_grid(rows, "measured", "predicted", "gap_class", masks.subsets("sw"), ["site_id"], ["short", "long", "very_long", "other"], list(masks.SUBSETS)))


@query("q_metrics_bias_spread", sql([LABELLED, "per AS (SELECT site_id, gc, gap_id, avg(p - m) AS b FROM lab WHERE gc IS NOT NULL GROUP BY 1, 2, 3)"], """
SELECT site_id, gc AS gap_class, count(b) AS n_gaps, count(*) AS n_gaps_offered, round(quantile_cont(b, 0.25), 6) AS bias_q1, round(quantile_cont(b, 0.5), 6) AS bias_median,
    round(quantile_cont(b, 0.75), 6) AS bias_q3, CASE WHEN count(b) > 1 THEN round(quantile_cont(b, 0.75) - quantile_cont(b, 0.25), 6) END AS bias_iqr FROM per GROUP BY 1, 2"""))
def metrics_bias_spread(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return show(metrics.bias_spread(masks.gap_rows(p, intervals(p, LONG_INTERVALS)), "measured", "predicted", ["site_id"]))


def _energy(spark, sf_dir):
    return pairs(spark, sf_dir).select(
        "site_id", (F.col("l_extendedprice") * F.col("l_discount")).alias("h"), F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice") * F.col("l_tax")).alias("le"),
        (F.col("l_extendedprice") * F.col("l_discount") * 1.1).alias("h2"), F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice") * F.col("l_tax") * 0.9).alias("le2"),
        F.col("l_extendedprice").alias("nr"), F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("g"),
    )


ENERGY = f"""{PAIRS}, e AS (SELECT site_id, l_extendedprice * l_discount AS h, CASE WHEN l_linenumber <> 6 THEN l_extendedprice * l_tax END AS le, l_extendedprice * l_discount * 1.1 AS h2,
    CASE WHEN l_linenumber <> 5 THEN l_extendedprice * l_tax * 0.9 END AS le2, l_extendedprice AS nr, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS g FROM pairs)"""


@query("q_metrics_ebr", sql([ENERGY], "SELECT site_id, round(sum(h + le) FILTER (g IS NOT NULL) / sum(nr - g) FILTER (le IS NOT NULL), 8) AS ebr FROM e GROUP BY 1"))
def metrics_ebr(spark, sf_dir):
    return show(_energy(spark, sf_dir).groupBy("site_id").agg(metrics.energy_balance_ratio("h", "le", "nr", "g").alias("ebr")), 8)


@query("q_metrics_ebr_compare", sql([ENERGY, "f AS (SELECT *, le IS NOT NULL AND le2 IS NOT NULL AND g IS NOT NULL AS ok FROM e)"], """
SELECT site_id, count(*) FILTER (ok) AS n, count(*) AS n_offered, count(*) FILTER (le IS NULL) AS n_missing_measured, count(*) FILTER (le2 IS NULL) AS n_missing_filled, count(*) FILTER (g IS NULL) AS n_missing_available_energy,
    round(sum(nr - g) FILTER (ok), 2) AS available_energy, round(sum(h + le) FILTER (ok) / sum(nr - g) FILTER (ok), 8) AS measured_ebr, round(sum(h2 + le2) FILTER (ok) / sum(nr - g) FILTER (ok), 8) AS filled_ebr,
    round(sum(h2 + le2) FILTER (ok) / sum(nr - g) FILTER (ok) - sum(h + le) FILTER (ok) / sum(nr - g) FILTER (ok), 8) AS difference FROM f GROUP BY 1"""))
def metrics_ebr_compare(spark, sf_dir):
    return show(_energy(spark, sf_dir).groupBy("site_id").agg(*metrics.energy_balance_comparison(("h", "le"), ("h2", "le2"), "nr", "g")), 8, available_energy=2)


# --- reports ------------------------------------------------------------------------------------------------------

_tidy = f"site, target, method, mode, gap_class, subset, units, n, n_offered, {_round}"


@query("q_report_gap_length_table_all_sites", sql([TIDY], f"SELECT {_tidy} FROM tidy"))
def report_gap_length_table_all_sites(spark, sf_dir):
    t = tidy(spark, sf_dir).drop("units")
    return show(reports.gap_length_table(t))


@query("q_report_median_sites", sql([TIDY], """SELECT target, method, mode, gap_class, subset, units, count(DISTINCT site) AS n_sites, sum(n)::BIGINT AS n, sum(n_offered)::BIGINT AS n_offered,
    round(median(r2), 6) AS r2, round(median(slope), 6) AS slope, round(median(rmse), 6) AS rmse, round(median(bias), 6) AS bias FROM tidy GROUP BY ALL"""))
def report_median_sites(spark, sf_dir):
    return show(reports.median_across_sites(tidy(spark, sf_dir)))


@query("q_report_pivot", sql([TIDY, "med AS (SELECT target, method, gap_class, median(rmse) AS rmse FROM tidy WHERE subset = 'all' AND gap_class <> 'all' GROUP BY 1, 2, 3)"], """
SELECT target, gap_class, round(max(rmse) FILTER (method = 'MDS'), 6) AS "MDS", round(max(rmse) FILTER (method = 'RFR3'), 6) AS "RFR3", round(max(rmse) FILTER (method = 'RFR10'), 6) AS "RFR10" FROM med GROUP BY 1, 2"""))
def report_pivot(spark, sf_dir):
    return show(reports.gap_length_pivot(reports.median_across_sites(tidy(spark, sf_dir), check=False), "rmse"))


STRATA = f"{TIDY}, {SITES}, strat AS (SELECT tidy.*, s AS stratum FROM tidy LEFT JOIN sites ON site = site_id, unnest(CASE WHEN igbp IS NULL THEN ['all'] ELSE ['all', igbp] END) AS x(s))"


def _report(spark, sf_dir):
    return reports.site_report(tidy(spark, sf_dir), sites(spark, sf_dir), warn=False)


@query("q_report_bias_iqr", sql([STRATA], """SELECT target, method, mode, gap_class, subset, units, stratum AS igbp, count(bias) AS n_sites, count(DISTINCT site) AS n_sites_offered, round(quantile_cont(bias, 0.25), 6) AS bias_q1,
    round(quantile_cont(bias, 0.5), 6) AS bias_median, round(quantile_cont(bias, 0.75), 6) AS bias_q3, CASE WHEN count(bias) > 1 THEN round(quantile_cont(bias, 0.75) - quantile_cont(bias, 0.25), 6) END AS bias_iqr FROM strat GROUP BY ALL"""))
def report_bias_iqr(spark, sf_dir):
    return show(reports.bias_iqr(_report(spark, sf_dir), "igbp"))


@query("q_report_site_report_all_subsets", sql([TIDY, SITES], f"SELECT {_tidy}, igbp, latitude FROM tidy LEFT JOIN sites ON site = site_id"))
def report_site_report_all_subsets(spark, sf_dir):
    return show(_report(spark, sf_dir))


@query("q_report_stratified", sql([STRATA, "long AS (UNPIVOT (SELECT site, target, method, mode, gap_class, subset, units, stratum, coalesce(r2, 'nan') AS r2, coalesce(slope, 'nan') AS slope, coalesce(rmse, 'nan') AS rmse, coalesce(bias, 'nan') AS bias FROM strat) ON r2, slope, rmse, bias INTO NAME metric VALUE v),\nl AS (SELECT * EXCLUDE v, CASE WHEN NOT isnan(v) THEN v END AS v FROM long)"], """
SELECT target, method, mode, gap_class, subset, units, stratum, metric, count(v) AS n_sites, count(DISTINCT site) AS n_sites_offered, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
    round(quantile_cont(v, 0.75), 6) AS q3, CASE WHEN count(v) > 1 THEN round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) END AS iqr FROM l GROUP BY ALL"""))
def report_stratified(spark, sf_dir):
    return show(reports.stratified_summary(_report(spark, sf_dir), "igbp"))


@query("q_report_population", sql([SITES], "SELECT igbp AS stratum, count(*) AS n_sites, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM sites GROUP BY 1"))
def report_population(spark, sf_dir):
    return show(reports.population_summary(sites(spark, sf_dir), "igbp"))


def _arm(name, alias):
    return " UNION ALL ".join(f"SELECT site, target, gap_class, subset, units, '{m}' AS metric, {m} AS {alias} FROM tidy WHERE method = '{name}' AND NOT (site = 'NATION_3' AND method = 'MDS')" for m in published.METRICS)


DIFF = f"""{TIDY}, a AS ({_arm('RFR3', 'x')}), b AS ({_arm('MDS', 'y')}),
far AS (SELECT *, CASE metric WHEN 'r2' THEN -x WHEN 'slope' THEN abs(x - 1) WHEN 'rmse' THEN x ELSE abs(x) END AS fx, CASE metric WHEN 'r2' THEN -y WHEN 'slope' THEN abs(y - 1) WHEN 'rmse' THEN y ELSE abs(y) END AS fy
    FROM a FULL JOIN b USING (site, target, gap_class, subset, units, metric)),
diff AS (SELECT site, target, gap_class, subset, units, metric, x, y, CASE WHEN fx < fy THEN 'improved' WHEN fx > fy THEN 'worsened' WHEN fx = fy THEN 'unchanged' END AS change FROM far)"""


def _two_arms(spark, sf_dir):
    return tidy(spark, sf_dir).where(~((F.col("site") == "NATION_3") & (F.col("method") == "MDS")))


@query("q_report_method_diff", sql([DIFF], """SELECT site, target, gap_class, subset, units, metric, round(x, 6) AS method_value, round(y, 6) AS baseline_value, 'RFR3' AS method, 'MDS' AS baseline, round(x - y, 6) AS difference, change FROM diff"""))
def report_method_diff(spark, sf_dir):
    return show(reports.method_differences(_two_arms(spark, sf_dir), "RFR3", "MDS"))


WELCHED = f"""{DIFF}, w AS (SELECT target, gap_class, subset, 'all' AS stratum, units, metric, count(x) AS n_method, count(y) AS n_baseline, avg(x) AS mean_method, avg(y) AS mean_baseline,
    var_samp(x) / count(x) AS sx, var_samp(y) / count(y) AS sy, max(x) - min(x) AS rx, max(y) - min(y) AS ry, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_paired,
    count(*) FILTER (change = 'improved') AS n_improved, count(*) FILTER (change = 'worsened') AS n_worsened, count(*) FILTER (change = 'unchanged') AS n_unchanged FROM diff GROUP BY ALL),
t AS (SELECT *, n_method >= 2 AND n_baseline >= 2 AND (rx > 0 OR ry > 0) AS test FROM w)"""


@query("q_report_welch_stats", sql([WELCHED], """SELECT target, gap_class, subset, stratum, units, metric, n_method, n_baseline, round(mean_method, 6) AS mean_method, round(mean_baseline, 6) AS mean_baseline, n_paired, n_improved, n_worsened, n_unchanged,
    round(mean_method - mean_baseline, 6) AS mean_difference, CASE WHEN test THEN round((sx + sy) * (sx + sy) / (sx * sx / (n_method - 1) + sy * sy / (n_baseline - 1)), 6) END AS df,
    CASE WHEN test THEN round(sqrt(sx + sy), 6) END AS standard_error, CASE WHEN test THEN round((mean_method - mean_baseline) / sqrt(sx + sy), 6) END AS t_statistic FROM t"""))
def report_welch_stats(spark, sf_dir):
    return show(reports.welch_statistics(reports.method_differences(_two_arms(spark, sf_dir), "RFR3", "MDS")))


@query("q_report_welch_full")
def report_welch_full(spark, sf_dir):
    return show(reports.welch_comparison(_report(spark, sf_dir), "RFR3", "MDS", by="igbp"))


_pub = "pub AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in (*r, published.published_units(r[0]))) + ")" for r in published.MEDIANS) + ") AS p(target, method, gap_class, subset, r2, slope, rmse, bias, units))"
MEDIAN = f"{TIDY}, med AS (SELECT target, method, gap_class, subset, units, median(r2) AS r2, median(slope) AS slope, median(rmse) AS rmse, median(bias) AS bias FROM tidy GROUP BY ALL)"
_cells = " UNION ALL ".join(
    f"SELECT m.target, m.method, m.gap_class, m.subset, '{x}' AS metric, m.{x} AS run, p.{x} AS published, " + ("m.units AS run_units, p.units AS published_units" if x in reports.DIMENSIONAL else "'1' AS run_units, '1' AS published_units") + " FROM med m JOIN pub p USING (target, method, gap_class, subset)"
    for x in published.METRICS
)


@query("q_report_benchmark_compare", sql([MEDIAN, _pub, f"c AS ({_cells})"], """SELECT target, method, gap_class, subset, metric, round(run, 6) AS run, round(published, 6) AS published, CASE WHEN run_units = published_units THEN round(run - published, 6) END AS difference,
    run_units, published_units, run_units = published_units AS comparable, CASE WHEN run_units <> published_units THEN 'units differ' WHEN published IS NULL THEN 'not published' WHEN run IS NULL THEN 'undefined in the run' END AS note FROM c"""))
def report_benchmark_compare(spark, sf_dir):
    return show(reports.compare_with_published(reports.median_across_sites(tidy(spark, sf_dir))))


@query("q_report_nee_units", sql([TIDY], f"""SELECT site, target, method, mode, gap_class, subset, CASE WHEN target = 'NEE' THEN '{published.CARBON_UNITS}' ELSE units END AS units, n, n_offered, round(r2, 6) AS r2, round(slope, 6) AS slope,
    round(rmse * CASE WHEN target = 'NEE' THEN {published.CARBON_FACTOR!r}::DOUBLE ELSE 1 END, 6) AS rmse, round(bias * CASE WHEN target = 'NEE' THEN {published.CARBON_FACTOR!r}::DOUBLE ELSE 1 END, 6) AS bias FROM tidy"""))
def report_nee_units(spark, sf_dir):
    once = reports.to_carbon_units(tidy(spark, sf_dir))
    return show(reports.to_carbon_units(once))


_s10 = "s10 AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) if isinstance(x, bool) else f"{x}::DOUBLE" for x in r) + ")" for r in published.WELCH) + ") AS p(target, metric, method, baseline, d, lo, hi, s))"


@query("q_report_s10_compare", sql([WELCHED, _s10], f"""SELECT t.target, t.metric, method, baseline, round(mean_method - mean_baseline, 6) AS run_difference, round(d, 6) AS published_difference,
    CASE WHEN ok THEN round(mean_method - mean_baseline - d, 6) END AS difference, ok AS comparable
FROM (SELECT *, metric NOT IN ('rmse', 'bias') OR units = CASE WHEN target = 'NEE' THEN '{published.CARBON_UNITS}' ELSE '{published.HEAT_UNITS}' END AS ok FROM t WHERE gap_class = 'all' AND subset = 'all') t
JOIN s10 ON t.target = s10.target AND t.metric = s10.metric AND method = 'RFR3' AND baseline = 'MDS'"""))
def report_s10_compare(spark, sf_dir):
    stats = reports.welch_statistics(reports.method_differences(_two_arms(spark, sf_dir), "RFR3", "MDS"))
    return show(reports.compare_with_published_welch(stats.withColumns({"method": F.lit("RFR3"), "baseline": F.lit("MDS")})))


# --- models and fills ---------------------------------------------------------------------------------------------

DAYMEAN = f"{HELD}, daymean AS (SELECT site_id, ts::DATE AS day, avg(v) FILTER (observed) AS p FROM held GROUP BY 1, 2 HAVING count(*) FILTER (observed) >= {MINIMUM})"
GAPPED = f"{DAYMEAN}, g AS (SELECT h.site_id, h.ts, CASE WHEN NOT holdout THEN v END AS v, qc, p FROM held h LEFT JOIN daymean d ON h.site_id = d.site_id AND h.ts::DATE = d.day)"


def _gapped(spark, sf_dir):
    df = held_frame(spark, sf_dir)
    means = df.groupBy("site_id", F.to_date("ts").alias("day")).agg(F.avg(F.when(F.col("observed"), F.col("v"))).alias("p"), F.count_if("observed").alias("_n")).where(F.col("_n") >= MINIMUM).drop("_n")
    rows = df.withColumn("day", F.to_date("ts")).join(means, ["site_id", "day"], "left")
    return rows.select("site_id", "ts", masks.hide("v").alias("v"), "qc", "p")


@query("q_fill_provenance", sql([GAPPED], f"""SELECT site_id, {text('g.ts')} AS ts, round(v, 6) AS v, qc::BIGINT AS qc, round(v, 6) AS v_original, round(coalesce(v, p), 6) AS v_filled, v IS NOT NULL AND qc IN (0, 1) AS v_is_observed,
    v IS NULL AND p IS NOT NULL AS v_is_filled, CASE WHEN v IS NULL AND p IS NOT NULL THEN 'DAYMEAN' WHEN v IS NULL THEN 'unfilled_incomplete_features' WHEN qc IN (0, 1) THEN 'observed' ELSE 'pre_filled' END AS v_fill_method,
    CASE WHEN v IS NULL AND p IS NOT NULL THEN 'v1' END AS v_model_version FROM g"""))
def fill_provenance(spark, sf_dir):
    return show(fill.with_provenance(_gapped(spark, sf_dir), "v", "p", "DAYMEAN", "v1", "qc", OK_FLAGS).drop("p"))


@query("q_fill_report", sql([GAPPED], """SELECT site_id, count(*) AS rows, count(*) FILTER (v IS NOT NULL AND qc IN (0, 1)) AS observed_rows, count(*) FILTER (v IS NOT NULL AND qc NOT IN (0, 1)) AS pre_filled_rows, count(*) FILTER (v IS NULL) AS missing_rows,
    count(*) FILTER (v IS NULL) AS candidate_rows, count(*) FILTER (v IS NULL AND p IS NOT NULL) AS filled_rows, count(*) FILTER (v IS NULL AND p IS NULL) AS unfilled_rows,
    count(*) FILTER (ts < TIMESTAMP '2024-01-06') AS rows_before_fit_origin, count(*) FILTER (v IS NULL AND p IS NULL) AS missing_p FROM g GROUP BY 1"""))
def fill_report(spark, sf_dir):
    done = fill.with_provenance(_gapped(spark, sf_dir), "v", "p", "DAYMEAN", "v1", "qc", OK_FLAGS)
    return fill.fill_report(done, "v", "qc", OK_FLAGS, names=["p"], origin=F.lit("2024-01-06 00:00:00").cast("timestamp_ntz"), keys=["site_id"])


@query("q_model_fit_report", sql([GAPPED], """SELECT count(*) AS rows, count(*) FILTER (v IS NOT NULL AND p IS NOT NULL AND qc IS NOT NULL) AS fitted_rows, count(*) FILTER (v IS NULL) AS dropped_missing_target,
    count(*) FILTER (v IS NOT NULL AND p IS NULL) AS dropped_missing_features, CASE WHEN count(*) FILTER (v IS NOT NULL AND p IS NULL) > 0 THEN 'p' END AS worst_feature, count(*) FILTER (v IS NOT NULL AND p IS NULL) AS worst_missing FROM g"""))
def model_fit_report(spark, sf_dir):
    return model.fit_report(_gapped(spark, sf_dir), ["p", "qc"], "v")


@query("q_model_folds", sql([SITE, "r AS (SELECT site_id, ts, row_number() OVER (PARTITION BY site_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY site_id) AS n FROM site)"], f"""
SELECT site_id, (CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END)::BIGINT AS fold, count(*) AS n_rows, {text('min(ts)')} AS first, {text('max(ts)')} AS last FROM r GROUP BY 1, 2"""))
def model_folds(spark, sf_dir):
    folded = model.with_folds(site_frame(spark, sf_dir), 5, groups=["site_id"])
    return show(folded.groupBy("site_id", "fold").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first"), F.max("ts").alias("last")))


SMALL_GRID = {"max_features": (1.0,), "min_samples_leaf": (2,), "n_estimators": (10,), "max_depth": (8,), "max_bins": (32,)}


def _run_config(limiter=True):
    columns = {"shortwave": "sw", "vapour_pressure_deficit": "x1", "air_temperature": "x2"}
    return RunConfig(columns=columns, hemisphere="north", grid=SMALL_GRID, observed_qc=OK_FLAGS, partitions=4, features=FeatureConfig(use_limiter=limiter, daily_strategy="rolling_available", min_daily_observations=MINIMUM, fallback_window_days=3))


def _learnable(spark, sf_dir):
    """Sites whose target follows its drivers, with the gaps of the intervals."""
    df = held_frame(spark, sf_dir)
    hour = F.hour("ts") + F.minute("ts") / 60.0
    out = df.select("site_id", "ts", "qc", "holdout", (F.greatest(F.sin((hour - 6) / 12 * 3.14159265), F.lit(0.0)) * 400 + F.col("v") / 10).alias("sw"), F.dayofyear("ts").cast("double").alias("x1"), (hour / 2 + F.col("v") / 100).alias("x2"))
    truth = 0.03 * F.col("sw") * F.col("x2") + 5 * F.sqrt("x1")
    return out.withColumn("le", truth)


@query("q_model_rf_predict")
def model_rf_predict(spark, sf_dir):
    df = _learnable(spark, sf_dir)
    forest = model.fit(df.where("not holdout"), ["sw", "x1", "x2"], "le", SMALL_GRID, partitions=4)
    return show(forest.predict(df.where("holdout").select("site_id", "ts", "sw", "x1", "x2", "le")), 4)


@query("q_fill_rf")
def fill_rf(spark, sf_dir):
    df = _learnable(spark, sf_dir).withColumn("le", masks.hide("le")).drop("holdout")
    return show(fill.GapFiller(_run_config()).fit(df, "le", "qc").fill(df), 4)


@query("q_validate_rf")
def validate_rf(spark, sf_dir):
    df = _learnable(spark, sf_dir).drop("holdout")
    found = validate(df, _run_config(), ["le"], {"le": "qc"}, intervals(df), check_leakage=True)
    return show(found["le"].scores, 4)


__all__ = ["GAP", "ORACLES", "QUERIES"]
