"""Queries over whole runs: closure, unscored rows, row accounting, metadata rules, digests, offsets, replayed gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fill, gaps, heldout, masks, model, reports, timeaxis
from . import accounting
from .frames import intervals, show, sql, table, text
from .queries_axis import OK_FLAGS, held_frame
from .queries_scores import DAYMEAN, GAPPED, MANIFEST, _available, _gapped

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


# --- withheld rows of two targets, predicted by day means ------------------------------------------------------------

#: H is the value, LE made of it; their predictions are means of the day's observed values that are not withheld.
CLASSED = f"""{DAYMEAN}, lab AS (
    SELECT h.site_id, h.ts, max_by(gap_class, gap_no) AS gap_class FROM held h JOIN gap ON h.ts >= gstart AND h.ts < gend GROUP BY 1, 2),
shown AS (SELECT site_id, ts::DATE AS day, avg(v) FILTER (observed AND NOT holdout) AS p FROM held GROUP BY 1, 2),
w AS (
    SELECT h.site_id, h.ts, gap_class, v AS h_truth, observed AS h_ok, p AS h_p, v / 4 + 10 AS le_truth, observed AND qc = 0 AS le_ok, CASE WHEN hour(h.ts) <> 3 THEN p / 4 + 12 END AS le_p,
        sw, CASE WHEN minute(h.ts) = 0 OR hour(h.ts) > 2 THEN sw / 10 END AS g
    FROM held h JOIN lab USING (site_id, ts) LEFT JOIN shown s ON s.site_id = h.site_id AND s.day = h.ts::DATE WHERE holdout)"""


def _withheld(spark, sf_dir):
    df = held_frame(spark, sf_dir)
    free = F.col("observed") & ~F.col("holdout")
    means = df.groupBy("site_id", F.to_date("ts").alias("day")).agg(F.avg(F.when(free, F.col("v"))).alias("p"))
    rows = masks.with_gap_class(df.where("holdout"), intervals(df)).withColumn("day", F.to_date("ts")).join(means, ["site_id", "day"], "left")
    return rows.select(
        "site_id", "ts", "gap_class", F.col("v").alias("h_truth"), F.col("observed").alias("h_ok"), F.col("p").alias("h_p"), (F.col("v") / 4 + 10).alias("le_truth"),
        (F.col("observed") & (F.col("qc") == 0)).alias("le_ok"), F.when(F.hour("ts") != 3, F.col("p") / 4 + 12).alias("le_p"), "sw",
        F.when((F.minute("ts") == 0) | (F.hour("ts") > 2), F.col("sw") / 10).alias("g"),
    )


def _target(rows, t):
    return rows.select("site_id", "ts", "gap_class", F.when(F.col(f"{t}_ok"), F.col(f"{t}_truth")).alias("measured"), F.col(f"{t}_p").alias("predicted"))


def _wide(rows):
    return heldout.wide_predictions({"H": _target(rows, "h"), "LE": _target(rows, "le")})


PAIRED = f"{CLASSED}, x AS (SELECT *, CASE WHEN h_ok THEN h_truth END AS hm, CASE WHEN le_ok THEN le_truth END AS lm FROM w)"


@query("q_validate_wide", sql([PAIRED], f'SELECT site_id, {text("ts")} AS ts, gap_class, round(hm, 6) AS "H_measured", round(h_p, 6) AS "H_predicted", round(lm, 6) AS "LE_measured", round(le_p, 6) AS "LE_predicted" FROM x'))
def validate_wide(spark, sf_dir):
    return show(_wide(_withheld(spark, sf_dir)))


@query("q_validate_energy_balance", sql([PAIRED, """b AS (SELECT *, hm IS NOT NULL AND lm IS NOT NULL AS has_m, h_p IS NOT NULL AND le_p IS NOT NULL AS has_f, sw IS NOT NULL AND g IS NOT NULL AS has_e FROM x),
o AS (SELECT *, has_m AND has_f AND has_e AS ok FROM b),
f AS (SELECT * FROM (SELECT DISTINCT site_id FROM o), unnest(['all', 'short', 'long', 'very_long']) AS c(gap_class)),
s AS (SELECT f.site_id, f.gap_class, count(*) FILTER (ok) AS n, count(o.ts) AS n_offered, count(*) FILTER (NOT has_m) AS n_missing_measured, count(*) FILTER (NOT has_f) AS n_missing_filled,
    count(*) FILTER (NOT has_e) AS n_missing_available_energy, sum(sw - g) FILTER (ok) AS e, sum(hm + lm) FILTER (ok) AS m, sum(h_p + le_p) FILTER (ok) AS p
    FROM f LEFT JOIN o ON o.site_id = f.site_id AND (f.gap_class = 'all' OR o.gap_class = f.gap_class) GROUP BY 1, 2)"""], """
SELECT site_id, 'H' AS sensible_heat, 'LE' AS latent_heat, gap_class, n, n_offered, n_missing_measured, n_missing_filled, n_missing_available_energy, round(e, 4) AS available_energy,
    CASE WHEN e > 0 THEN round(m / e, 6) END AS measured_ebr, CASE WHEN e > 0 THEN round(p / e, 6) END AS filled_ebr, CASE WHEN e > 0 THEN round(p / e - m / e, 6) END AS difference FROM s"""))
def validate_energy_balance(spark, sf_dir):
    rows = _withheld(spark, sf_dir)
    wide = _wide(rows).join(rows.select("site_id", "ts", "sw", "g"), ["site_id", "ts"])
    return show(heldout.energy_balance(wide, ("H", "LE"), "sw", "g", gaps.CLASSES), available_energy=4)


@query("q_validate_unscored", sql([CLASSED], """SELECT site_id, gap_class, count(*) AS n_offered, count(*) FILTER (le_truth IS NOT NULL AND le_ok AND le_p IS NOT NULL) AS n_scored, count(*) FILTER (le_truth IS NULL) AS missing_target,
    count(*) FILTER (le_truth IS NOT NULL AND NOT le_ok) AS not_observed, count(*) FILTER (le_truth IS NOT NULL AND le_ok AND h_p IS NULL) AS incomplete_features,
    count(*) FILTER (le_truth IS NOT NULL AND le_ok AND h_p IS NOT NULL AND le_p IS NULL) AS no_prediction FROM w GROUP BY 1, 2"""))
def validate_unscored(spark, sf_dir):
    rows = _withheld(spark, sf_dir)
    scored = _target(rows, "le").where("measured is not null and predicted is not null")
    return heldout.unscored(rows, scored, heldout.reason("le_truth", "le_ok", F.col("h_p").isNotNull(), "le_p"))


@query("q_manifest_rows", sql([GAPPED], """SELECT count(*) FILTER (v IS NOT NULL AND p IS NOT NULL) AS training_rows, count(*) AS training_rows_offered, count(*) FILTER (v IS NOT NULL AND p IS NULL) + count(*) FILTER (v IS NULL) AS training_rows_dropped,
    count(*) FILTER (v IS NULL AND p IS NOT NULL) AS prediction_rows, count(*) FILTER (v IS NULL) AS prediction_rows_offered, count(*) FILTER (v IS NULL AND p IS NULL) AS prediction_rows_dropped FROM g"""))
def manifest_rows(spark, sf_dir):
    """Counts observed in the one pass that consumes the filled rows."""
    rows = fill.with_provenance(_gapped(spark, sf_dir), "v", "p", "DAYMEAN", "v1", "qc", OK_FLAGS)
    counted = accounting.Counted(rows, **accounting.training_metrics("v", model.complete(["p"])), **accounting.prediction_metrics(F.col("v_original").isNull(), F.when(F.col("v_is_filled"), F.col("v_filled"))))
    counted.df.write.format("noop").mode("overwrite").save()
    found = accounting.RowCounts(**counted.values()).to_dict()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


# --- metadata, digests, stamps, replayed gaps --------------------------------------------------------------------------


def _raw_metadata(spark, sf_dir):
    """Suppliers as sites whose fields are partly wrong; a name in eleven is shared, one in thirteen missing."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.when(k % 13 == 0, "").when(k % 11 == 0, "shared").otherwise(F.col("s_name")).alias("SITE_ID"), F.when(k % 17 == 0, "north").otherwise((k % 200 - 100).cast("string")).alias("LOCATION_LAT"),
        (k % 400 - 200).cast("string").alias("Longitude"), F.element_at(F.array(*map(F.lit, ("Wet", "CRO", "xyz", ""))), (k % 4 + 1).cast("int")).alias("igbp"),
        F.when(k % 7 == 0, "Q").otherwise("O").alias("System"), F.concat((k % 20 + 2000).cast("string"), F.lit("-05-01")).alias("Start"), F.when(k % 19 == 0, "soon").otherwise("2010").alias("End"),
    )


@query("q_site_violations", """WITH m AS (
    SELECT CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'shared' ELSE s_name END AS site_id, CASE WHEN s_suppkey % 17 = 0 THEN 'north' ELSE (s_suppkey % 200 - 100)::VARCHAR END AS lat,
        s_suppkey % 400 - 200 AS lon, ['Wet', 'CRO', 'xyz', ''][s_suppkey % 4 + 1] AS igbp, CASE WHEN s_suppkey % 7 = 0 THEN 'Q' ELSE 'O' END AS sys, make_date(s_suppkey % 20 + 2000, 5, 1) AS a, s_suppkey % 19 = 0 AS soon
    FROM supplier)
SELECT site_id, 'missing' AS rule, 'site_id' AS field, NULL::VARCHAR AS value FROM m WHERE site_id IS NULL
UNION ALL SELECT site_id, 'unreadable', 'latitude', lat FROM m WHERE lat = 'north' UNION ALL SELECT site_id, 'out of range', 'latitude', lat FROM m WHERE abs(try_cast(lat AS DOUBLE)) > 90
UNION ALL SELECT site_id, 'out of range', 'longitude', lon::VARCHAR FROM m WHERE abs(lon) > 180 UNION ALL SELECT site_id, 'unknown code', 'igbp', igbp FROM m WHERE igbp = 'xyz'
UNION ALL SELECT site_id, 'unknown code', 'instrument_system', sys FROM m WHERE sys = 'Q' UNION ALL SELECT site_id, 'unreadable', 'end_date', 'soon' FROM m WHERE soon
UNION ALL SELECT site_id, 'before start_date', 'end_date', '2010' FROM m WHERE NOT soon AND a > DATE '2010-01-01'
UNION ALL SELECT site_id, 'repeated', 'site_id', (count(*) OVER (PARTITION BY site_id))::VARCHAR FROM m WHERE site_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY site_id) > 1""")
def site_violations(spark, sf_dir):
    return reports.site_violations(_raw_metadata(spark, sf_dir))


@query("q_model_rows_digest", """WITH r AS (SELECT ('0x' || substr(md5(concat_ws(chr(31), coalesce('=' || l_orderkey, '-'), coalesce('=' || l_linenumber, '-'), coalesce('=' || CASE WHEN l_linenumber <> 3 THEN l_returnflag END, '-'))), 1, 15))::BIGINT AS b FROM lineitem)
SELECT count(*) AS n_rows, sum(b)::VARCHAR AS digest_sum, bit_xor(b) AS digest_xor FROM r""")
def model_rows_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag"))
    return model.rows_digest(rows, ["l_orderkey", "l_linenumber", "flag"])


def _text_stamps(spark, sf_dir):
    """Events with stamps as text: with Z, with offsets of two spellings, without any, and (one in fifty) no stamp at all."""
    at, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id")
    stamp = F.when(k % 50 == 7, F.concat(F.lit("at "), at)).when(k % 4 == 0, F.concat(at, F.lit("Z"))).when(k % 4 == 1, F.concat(at, F.lit("+05:30"))).when(k % 4 == 2, F.concat(at, F.lit("-0800"))).otherwise(at)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id"), stamp.alias("stamp"))


@query("q_time_offsets", """WITH e AS (SELECT event_type AS site_id, date_trunc('second', ts) AS t, event_id % 50 = 7 AS bad, event_id % 4 AS k FROM events)
SELECT site_id, count(*) AS n, count(*) FILTER (bad) AS n_bad, count(*) FILTER (NOT bad AND k = 3) AS n_naive, count(DISTINCT k) FILTER (NOT bad AND k < 3) AS n_offsets,
    strftime(min(CASE k WHEN 1 THEN t - INTERVAL 330 MINUTE WHEN 2 THEN t + INTERVAL 8 HOUR ELSE t END) FILTER (NOT bad), '%Y-%m-%d %H:%M:%S') AS first,
    strftime(max(CASE k WHEN 1 THEN t - INTERVAL 330 MINUTE WHEN 2 THEN t + INTERVAL 8 HOUR ELSE t END) FILTER (NOT bad), '%Y-%m-%d %H:%M:%S') AS last FROM e GROUP BY 1""")
def time_offsets(spark, sf_dir):
    return show(timeaxis.stamp_report(_text_stamps(spark, sf_dir), "stamp"))


@query("q_gap_replay", sql([MANIFEST, """later AS (SELECT m.site_id, m.gap_id, m.gap_class, n_rows, n_observed_before_masking, count(h.ts) AS now_rows, count(*) FILTER (h.observed) AS now_observed
    FROM manifest m LEFT JOIN held h ON h.site_id = m.site_id AND h.ts >= gstart AND h.ts < gend AND NOT (dayofyear(h.ts) % 9 = 0 AND h.site_id < 'e') GROUP BY ALL)"""], """
SELECT site_id, gap_id, gap_class, n_rows, now_rows, n_observed_before_masking AS n_observed, now_observed, n_rows = now_rows AND n_observed_before_masking = now_observed AS same FROM later"""))
def gap_replay(spark, sf_dir):
    """The manifest of the intervals, replayed on data of which some sites lost every ninth day since."""
    df, steps, ok = _available(spark, sf_dir)
    stored = gaps.count_rows(df, intervals(df), steps, ok)
    return gaps.replay(df.where(~((F.dayofyear("ts") % 9 == 0) & (F.col("site_id") < "e"))), stored, steps, ok)

