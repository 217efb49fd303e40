from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, FeatureError, FillError, GapError, InsufficientTrainingData, LeakageError, ReportError, SourceError, TimeAxisError
from tidemark.functions import published, student
from tidemark.functions.synthetic import synthetic_sites
from tidemark.operators import features, fill, gaps, leakage, legacy, masks, metrics, model, reports, timeaxis
from tidemark.plans import config
from tidemark.plans.accounting import MANIFEST_FORMAT
from tidemark.plans.validation import validate
from tidemark.sources import tables
from tidemark.streaming import scoring

T0 = datetime(2020, 6, 1)


def frame(spark, values, site="a", step=30, start=T0, extra=None):
    rows = [(site, start + timedelta(minutes=step * k), v, *(extra[k] if extra else ())) for k, v in enumerate(values) if v != "skip"]
    return spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, v double" + (", qc int, sw double" if extra else ""))


def one(df):
    return df.first().asDict()


# --- time axis ----------------------------------------------------------------------------------------------------


def test_durations():
    assert timeaxis.to_duration("30min") == timedelta(minutes=30) and timeaxis.to_periods("7d", "30min") == 336
    assert timeaxis.iso_duration(timedelta(days=7, minutes=30)) == "P7DT0H30M0S"
    assert timeaxis.from_periods(48, "30min") == timedelta(days=1)
    for bad in (30, "30", "-1h", timedelta(0)):
        with pytest.raises(TimeAxisError):
            timeaxis.to_duration(bad)
    with pytest.raises(TimeAxisError):
        timeaxis.to_periods("45min", "30min")


def test_axis_of_a_series_with_a_hole_and_an_odd_stamp(spark):
    df = frame(spark, [1.0, 2.0, "skip", 4.0, 5.0]).unionByName(frame(spark, [9.0], start=T0 + timedelta(minutes=75)))
    steps = timeaxis.step_of(df, "30min")
    s = one(timeaxis.axis_summary(df, steps))
    assert (s["n"], s["n_expected"], s["n_missing"], s["n_off_grid"], s["is_regular"]) == (5, 5, 1, 1, False) and s["coverage"] == 0.8
    assert [r["ts"] for r in timeaxis.missing_rows(df, steps).collect()] == [T0 + timedelta(hours=1)]
    assert [r["ts"] for r in timeaxis.off_grid(df, steps).collect()] == [T0 + timedelta(minutes=75)]
    with pytest.raises(TimeAxisError):
        timeaxis.require_regular(timeaxis.axis_summary(df, steps))
    with pytest.raises(TimeAxisError):
        timeaxis.infer_step(df)


def test_ties_of_the_cadence_go_to_the_smallest(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=m)) for m in (0, 30, 90, 120, 180)], "site_id string, ts timestamp_ntz")
    assert one(timeaxis.infer_step(df))["step_us"] == 30 * 60 * 10**6


def test_duplicates(spark):
    df = spark.createDataFrame([("a", T0, 1, 5.0), ("a", T0, 2, 6.0)], "site_id string, ts timestamp_ntz, ingest_seq int, v double")
    assert one(timeaxis.resolve_duplicates(df, "keep_first"))["v"] == 5.0 and one(timeaxis.resolve_duplicates(df, "keep_last"))["v"] == 6.0
    with pytest.raises(TimeAxisError):
        timeaxis.resolve_duplicates(df, "error")
    _, summary = timeaxis.prepare(df.unionByName(df.withColumn("ts", F.lit(T0 + timedelta(hours=1)).cast("timestamp_ntz"))), on_duplicates="keep_last", frequency="1h")
    assert one(summary)["n_duplicates_removed"] == 2
    with pytest.raises(TimeAxisError):
        timeaxis.check_stamps(df.withColumn("ts", F.lit("x")))
    with pytest.raises(TimeAxisError):
        timeaxis.check_stamps(df.where("v > 100"))


# --- features -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("value, inclusive, exclusive", [(9.9, "weak", "weak"), (10.0, "medium", "weak"), (50.0, "medium", "medium"), (100.0, "medium", "strong"), (100.1, "strong", "strong"), (None, None, None)])
def test_radiation(spark, value, inclusive, exclusive):
    df = spark.createDataFrame([(value,)], "x double")
    got = df.select(features.radiation_tag("x").alias("i"), features.radiation_tag("x", convention="medium_exclusive").alias("e")).first()
    assert tuple(got) == (inclusive, exclusive)


def test_seasons(spark):
    df = spark.createDataFrame([(datetime(2020, m, 15),) for m in range(1, 13)], "ts timestamp_ntz")
    got = [tuple(r) for r in df.select(features.season_tag("ts").alias("n"), features.season_tag("ts", "south").alias("s")).collect()]
    north = ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["autumn"] * 3 + ["winter"]
    assert [g[0] for g in got] == north and [g[1] for g in got] == north[6:] + north[:6]


def test_day_statistics_by_hand(spark):
    df = frame(spark, [float(k) for k in range(1, 9)])
    s = one(features.day_statistics(df, "v"))
    assert (s["q1"], s["q2"], s["q3"]) == (2.75, 4.5, 6.25) and abs(s["std"] - 6**0.5) < 1e-12
    assert abs(one(features.day_statistics(df, "v", ddof=0))["std"] - 5.25**0.5) < 1e-12
    assert abs(one(features.day_statistics(df, "v", ddof=2))["std"] - 7**0.5) < 1e-12


def test_strategies_for_days_without_enough(spark):
    days = [[1.0] * 24, [None] * 24, [None] * 24, [3.0] * 24]
    df = frame(spark, [x for d in days for x in d], step=60)
    got = lambda **k: [r["q2"] for r in features.day_statistics(df, "v", minimum=5, **k).orderBy("day").collect()]
    assert got() == [1.0, None, None, 3.0]
    assert got(strategy="neighbor_day_fallback") == [1.0, 1.0, 3.0, 3.0]
    assert got(strategy="neighbor_day_fallback", window_days=1) == [1.0, 1.0, 3.0, 3.0]
    assert got(strategy="rolling_available", window_days=1) == [1.0, 1.0, 3.0, 3.0]
    assert got(strategy="rolling_available", window_days=2) == [1.0, 2.0, 2.0, 3.0]
    with pytest.raises(FeatureError):
        got(strategy="guess")


def test_a_tie_of_neighbours_goes_to_the_earlier(spark):
    df = frame(spark, [1.0] * 24 + [None] * 24 + [3.0] * 24, step=60)
    assert [r["q2"] for r in features.day_statistics(df, "v", "neighbor_day_fallback").orderBy("day").collect()] == [1.0, 1.0, 3.0]


def test_legacy_statistics_look_a_day_ahead(spark):
    df = frame(spark, [1.0] * 24 + [2.0] * 24, step=60)
    got = [r["v_mean"] for r in legacy.legacy_daily_statistics(df, "v", "v").orderBy("ts").collect()]
    assert got == [1.0] + [2.0] * 23 + [2.0] + [2.0] * 23
    gap = frame(spark, [None, 1.0, None, 3.0, None])
    filled = legacy.interpolate_by_position(gap.withColumn("pos", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("site_id").orderBy("ts"))), ["v"], "pos")
    assert [r["v"] for r in filled.orderBy("ts").collect()] == [None, 1.0, 2.0, 3.0, 3.0]


# --- masks, leakage, gaps -----------------------------------------------------------------------------------------

HOLE = [("g-01", "short", T0 + timedelta(days=2), T0 + timedelta(days=3), 0)]


def hole(spark, rows=HOLE):
    return spark.createDataFrame([("a", *r) for r in rows], "site_id string, gap_id string, gap_class string, start timestamp_ntz, end timestamp_ntz, gap_no int")


def learnable(spark, days=10):
    rows = [(float((k * 37) % 101), 0 if k % 9 else 1, max(0.0, (k % 48 - 14) * 20.0)) for k in range(48 * days)]
    return frame(spark, [r[0] for r in rows], extra=[(r[1], r[2]) for r in rows])


def test_masks(spark):
    df = spark.createDataFrame([(1.0, 0, 25.0), (1.0, None, 20.0), (None, 0, None), (1.0, 2, 5.0), (float("nan"), 0, 1.0)], "v double, qc int, sw double")
    got = [(r["o"], r["d"], r["s"]) for r in df.select(masks.observed("v", "qc").alias("o"), masks.daytime("sw").alias("d"), masks.subsets("sw").alias("s")).collect()]
    assert got == [(True, True, ["all", "daytime"]), (False, False, ["all", "nighttime"]), (False, False, ["all"]), (False, False, ["all", "nighttime"]), (False, False, ["all", "nighttime"])]


def test_of_overlapping_gaps_the_later_counts(spark):
    df = frame(spark, [1.0] * 48 * 6)
    rows = HOLE + [("g-02", "long", T0 + timedelta(days=2, hours=12), T0 + timedelta(days=4), 1)]
    got = masks.with_gap_class(df, hole(spark, rows)).groupBy("gap_class").count().collect()
    assert {r["gap_class"]: r["count"] for r in got} == {None: 48 * 4, "short": 24, "long": 72}


def test_withheld_values_reach_no_feature(spark):
    df = learnable(spark)
    leakage.require_no_leakage(df, hole(spark), "v", ["sw"], "sw", qc="qc", strategy="rolling_available")
    moved = {r["feature"]: r["n_moved"] for r in leakage.moved_features(df, hole(spark), "v", ["sw"], "sw", legacy_mode=True).collect()}
    assert moved["v_mean"] > 0 and moved["season"] == 0
    with pytest.raises(LeakageError):
        leakage.require_no_leakage(df, hole(spark), "v", ["sw"], "sw", hide_target=False)
    held = leakage.validation_features(df, hole(spark), "v", ["sw"], "sw", "qc")
    assert held.where("available and holdout").count() == 0 and held.count() == df.count()


def test_placed_gaps_keep_the_rules(spark):
    df = synthetic_sites(spark, sites=2, days=60, seed=3)
    steps = timeaxis.step_of(df, "30min")
    scenario = gaps.GapScenario(durations={"short": timedelta(hours=12), "long": timedelta(days=2), "very_long": timedelta(days=6)})
    ok = masks.observed("LE", "LE_QC")
    placed = gaps.place(df, steps, ok, scenario).collect()
    assert placed == gaps.place(df.repartition(5), steps, ok, scenario).collect()
    for site in ("site-000", "site-001"):
        mine = sorted((r for r in placed if r["site_id"] == site), key=lambda r: r["start"])
        assert mine and all(a["end"] <= b["start"] for a, b in zip(mine, mine[1:]))
        assert all(r["observed_fraction"] >= 0.5 and r["end"] - r["start"] == scenario.durations[r["gap_class"]] for r in mine)
    with pytest.raises(GapError):
        gaps.known_gaps(df, (("long", 3), ("short", 4)), scenario.durations)
    with pytest.raises(ConfigError):
        gaps.GapScenario(missing_fraction=1.5)


# --- scores and reports -------------------------------------------------------------------------------------------


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 4.0), (4.0, 4.0), (None, 1.0), (5.0, float("nan"))], "m double, p double")
    got = one(df.agg(*metrics.core_metrics("m", "p")))
    assert (got["n"], got["n_offered"]) == (4, 6)
    assert [round(got[k], 12) for k in ("r2", "slope", "rmse", "bias")] == [0.6, 0.8, round(0.5**0.5, 12), 0.5]
    assert round(one(df.agg(*metrics.core_metrics("m", "p", "squared_correlation")))["r2"], 12) == 0.8
    flat = one(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "m double, p double").agg(*metrics.core_metrics("m", "p")))
    assert flat["r2"] is None and flat["slope"] is None and flat["bias"] == 1.5
    none = one(df.where("m > 100").agg(*metrics.core_metrics("m", "p")))
    assert none["n"] == 0 and none["rmse"] is None


def test_energy_balance(spark):
    df = spark.createDataFrame([(10.0, 20.0, 50.0, 10.0), (30.0, 20.0, 70.0, 10.0), (1.0, None, 5.0, 1.0)], "h double, le double, nr double, g double")
    assert one(df.agg(metrics.energy_balance_ratio("h", "le", "nr", "g").alias("x")))["x"] == 0.8
    assert one(df.agg(metrics.energy_balance_ratio("h", "le", "g", "nr").alias("x")))["x"] is None


def test_student():
    assert abs(student.t_quantile(0.975, 10) - 2.2281388520) < 1e-9 and abs(student.t_quantile(0.975, 1) - 12.7062047364) < 1e-8
    assert abs(student.t_two_sided(2.2281388520, 10) - 0.05) < 1e-10 and student.t_two_sided(0, 5) == 1.0


def scores(spark, rows):
    schema = "site string, target string, method string, mode string, gap_class string, subset string, n long, n_offered long, r2 double, slope double, rmse double, bias double, units string"
    return spark.createDataFrame([(s, t, m, "RFR3", "all", "all", 10, 12, r2, 1.0, 2.0, b, u) for s, t, m, r2, b, u in rows], schema)


def test_reports_over_sites(spark):
    r2 = [0.5, 0.6, 0.7, 0.8, 1.1]
    bias = [-2.0, -1.0, 0.0, 1.0, 4.0]
    t = scores(spark, [(f"s{k}", "LE", "RFR3", r2[k], bias[k], "W m-2") for k in range(5)])
    got = one(reports.stratified_summary(t).where("metric = 'r2'"))
    assert [round(got[k], 9) for k in ("q1", "median", "q3", "iqr")] == [0.6, 0.7, 0.8, 0.2]
    iqr = one(reports.bias_iqr(t))
    assert (iqr["bias_q1"], iqr["bias_median"], iqr["bias_q3"], iqr["bias_iqr"]) == (-1.0, 0.0, 1.0, 2.0)
    assert one(reports.median_across_sites(t))["r2"] == 0.7
    with pytest.raises(ReportError):
        reports.median_across_sites(t.unionByName(t))
    assert one(reports.bias_iqr(t.limit(1)))["bias_iqr"] is None


def test_differences_and_welch(spark):
    t = scores(spark, [(f"s{k}", "LE", "RFR3", 0.7 + k / 100, 1.0, None) for k in range(4)] + [(f"s{k}", "LE", "MDS", 0.6 + k / 50, -2.0, None) for k in range(1, 5)])
    d = {r["site"]: r for r in reports.method_differences(t, "RFR3", "MDS").where("metric = 'bias'").collect()}
    assert len(d) == 5 and d["s1"]["change"] == "improved" and d["s0"]["change"] is None
    w = one(reports.welch_comparison(t, "RFR3", "MDS").where("metric = 'r2'"))
    assert w["ci_lower"] < w["mean_difference"] < w["ci_upper"] and 0 < w["p_value"] < 1 and (w["n_method"], w["n_paired"]) == (4, 3)
    flat = one(reports.welch_comparison(t, "RFR3", "MDS").where("metric = 'bias'"))
    assert flat["p_value"] is None and flat["mean_difference"] == 3.0


def test_units_and_published_values(spark):
    t = scores(spark, [("s", "NEE", "RFR3", 0.8, 1.0, published.MODEL_UNITS)])
    once = reports.to_carbon_units(t)
    assert abs(one(once)["bias"] - published.CARBON_FACTOR) < 1e-12 and one(reports.to_carbon_units(once))["bias"] == one(once)["bias"]
    raw = {r["metric"]: r for r in reports.compare_with_published(t).collect()}
    assert raw["bias"]["comparable"] is False and raw["bias"]["difference"] is None and abs(raw["r2"]["difference"] - 0.02) < 1e-12
    with pytest.raises(ReportError):
        reports.to_carbon_units(t.withColumn("units", F.lit("kg")))
    assert published.medians_table(spark).count() == 24 and published.welch_table(spark).count() == 24 and published.uncertainty_table(spark).count() == 9


def test_site_metadata(spark):
    raw = spark.createDataFrame([("A", "−35.5", "Wet", "✓"), ("B", "40", "ENF", "×")], "ID string, Latitude string, IGBP string, `Included in 94  sites` string")
    got = {r["site_id"]: r for r in reports.site_metadata(raw).collect()}
    assert got["A"]["latitude"] == -35.5 and got["A"]["igbp"] == "WET" and got["A"]["included_in_94_site_subset"] is True and got["B"]["included_in_94_site_subset"] is False
    with pytest.raises(ReportError):
        reports.site_metadata(raw.withColumn("IGBP", F.lit("XXX")))


# --- models, fills, sources, streams ------------------------------------------------------------------------------

GRID = {"max_features": (1.0,), "n_estimators": (8,), "max_depth": (6,), "min_samples_leaf": (2,)}


def run_config(**more):
    columns = {"shortwave": "shortwave", "vapour_pressure_deficit": "vapour_pressure_deficit", "air_temperature": "air_temperature"}
    return config.RunConfig(columns=columns, hemisphere="north", grid=GRID, partitions=2, features=config.FeatureConfig(daily_strategy="rolling_available"), **more)


def test_fill_and_save_and_load(spark, tmp_path):
    df = synthetic_sites(spark, sites=1, days=40, seed=5).cache()
    filler = fill.GapFiller(run_config()).fit(df, "LE", "LE_QC")
    out = filler.fill(df)
    report = one(fill.fill_report(out, "LE", "LE_QC", origin=F.lit(T0).cast("timestamp_ntz")))
    assert report["observed_rows"] + report["pre_filled_rows"] + report["missing_rows"] == report["rows"] == 40 * 48
    assert report["filled_rows"] == report["candidate_rows"] > 0
    err = one(out.where("LE_is_filled").agg(F.avg(F.abs(F.col("LE_filled") - F.col("LE_truth"))).alias("e"), F.stddev("LE_truth").alias("s")))
    assert err["e"] < err["s"]
    with pytest.raises(FillError):
        filler.fill(out)
    filler.forest.save(str(tmp_path / "m"))
    again = model.Forest.load(spark, str(tmp_path / "m"))
    assert again.names == filler.forest.names and abs(sum(again.importances().values()) - 1) < 1e-6
    same = one(filler._matrix(df, "LE", F.col("LE"))[0].transform(lambda m: again.predict(m, "x").join(filler.forest.predict(m, "y").select("site_id", "ts", "y"), ["site_id", "ts"])).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("d")))
    assert same["d"] == 0.0
    # a stream of later rows is filled by the same model
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(src)
    scoring.fill_stream(spark.readStream.schema(df.schema).parquet(src), filler, dst, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(dst).count() == df.count()


def test_search_and_folds(spark):
    df = synthetic_sites(spark, sites=1, days=12, seed=6)
    names = ["shortwave", "air_temperature"]
    folds = model.with_folds(df, 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [115, 115, 115, 115, 116]
    forest = model.fit(df, names, "H", {**GRID, "min_samples_leaf": (2, 40)}, folds=3, cv="time_series_split", partitions=2)
    assert forest.score is not None and forest.best["min_samples_leaf"] in (2, 40)
    with pytest.raises(InsufficientTrainingData):
        model.fit(df.withColumn("H", F.lit(None).cast("double")), names, "H", GRID)


def test_time_blocks(spark):
    df = synthetic_sites(spark, sites=2, days=5, seed=6)
    n = df.count()
    rows = model.with_time_blocks(df, 4).select("fold", "ts").toPandas()
    sizes = rows.groupby("fold").size().tolist()
    assert sizes == [n - 4 * (n // 5)] + [n // 5] * 4
    ends = rows.groupby("fold")["ts"].agg(["min", "max"])
    assert (ends["max"].to_numpy()[:-1] <= ends["min"].to_numpy()[1:]).all()  # later blocks are later in time, over all sites


def test_shuffled_folds_are_even_and_repeat(spark):
    df = synthetic_sites(spark, sites=2, days=3, seed=6)
    deal = lambda d: {(r["site_id"], r["ts"]): r["fold"] for r in model.with_folds(d, 3, shuffle_seed=5).collect()}
    a, b = deal(df), deal(df.repartition(3))
    assert a == b and len(set(pd.Series(list(a.values())).value_counts())) <= 2


def test_a_missing_or_odd_hemisphere_is_refused():
    with pytest.raises(ConfigError):
        config.RunConfig().side  # noqa: B018
    with pytest.raises(ConfigError):
        config.RunConfig(hemisphere="west")
    assert config.RunConfig(latitude=-3.0).side == "south"


def test_shortfall_is_told(spark):
    plan = spark.createDataFrame([("a", "long", 2), ("a", "short", 1)], "site_id string, gap_class string, events int")
    placed = spark.createDataFrame([("a", "long"), ("a", "short")], "site_id string, gap_class string")
    assert gaps.shortfalls(plan, placed) == ["site a: 1 of 2 gaps of class long could be placed"]
    with pytest.raises(GapError):
        gaps.place(plan, plan, F.lit(True), gaps.GapScenario(), on_shortfall="perhaps")


def test_overlapping_gaps_count_a_row_once(spark):
    df = synthetic_sites(spark, sites=1, days=6, seed=3)
    start = df.agg(F.min("ts")).first()[0]
    at = lambda h: start + timedelta(hours=h)
    intervals = spark.createDataFrame(
        [("g1", "short", at(24), at(60)), ("g2", "long", at(48), at(72))], "gap_id string, gap_class string, start timestamp_ntz, end timestamp_ntz"
    ).crossJoin(df.select("site_id").distinct())
    found = validate(df, run_config(), ["H"], intervals=intervals)["H"]
    n = {(r["gap_class"], r["subset"]): r["n_offered"] for r in found.scores.collect()}
    assert n["all", "all"] == 96 and n["short", "all"] == 48 and n["long", "all"] == 48
    assert found.predictions.count() == 72 + 48


def test_configuration(tmp_path):
    c = config.from_dict({"mode": "RFR3", "grid": "legacy_fixed", "gaps": {"durations": {"short": "12h", "long": "2d", "very_long": "6d"}}})
    assert c.grid["max_depth"] == (20,) and c.gaps.durations["short"] == timedelta(hours=12) and c.method == "RFR3" and c.as_benchmark_arm().method == "ORF3"
    assert list(config.arm_differences(c, c.as_benchmark_arm())) == ["features.use_limiter"]
    config.require_pair(c, c.as_benchmark_arm())
    path = tmp_path / "c.yaml"
    path.write_text("mode: RFR10\nlatitude: -12\n")
    assert config.load(str(path)).side == "south" and config.load(str(path), hemisphere="north").side == "north"
    for bad in ({"mode": "X"}, {"unknown": 1}, {"features": {"daily_strategy": "x"}}, {"seed": 1.5}, {"grid": "nope"}):
        with pytest.raises(ConfigError):
            config.from_dict(bad)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("TIMESTAMP_START,TA_F_MDS,LE_F_MDS\n201801010030,-9999,5.5\n201801010100,3.5,NA\n")
    df = tables.read_csv(spark, path, "TIMESTAMP_START string, TA_F_MDS double, LE_F_MDS double", "TIMESTAMP_START", "yyyyMMddHHmm")
    rows = tables.prepare_stamped(df, site="x").orderBy("ts").collect()
    assert rows[0]["ts"] == datetime(2018, 1, 1, 0, 30) and rows[0]["TA_F_MDS"] is None and rows[1]["LE_F_MDS"] is None
    found = tables.inspect(["SW_IN_F", "VPD_F_MDS", "TA_F_MDS", "TS_F_MDS_2", "TS_F_MDS_3", "LE_F_MDS", "LE_F_MDS_QC"])
    assert found.best_mode() == "RFR3" and found.columns["soil_temperature"] == "TS_F_MDS_2" and found.flags == {"LE": "LE_F_MDS_QC"}
    with pytest.raises(SourceError):
        found.require("RFR10")
    tables.write_results({"t": df.drop("ts")}, str(tmp_path / "r"), {"kind": "x", "format": MANIFEST_FORMAT}, check=False)
    assert tables.read_manifest(spark, str(tmp_path / "r"))["kind"] == "x"
    with pytest.raises(Exception, match="exists"):
        tables.write_results({"t": df.drop("ts")}, str(tmp_path / "r"))


def test_word_tables(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr>"
    body = row("Site", "r2", "slope", "rmse", "bias") + row("LE", "", "", "", "") + row("S1", "0.5", "0.9", "20", "−1.5")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
    got = tables.site_scores(tables.docx_tables(spark, str(tmp_path / "a.docx")), ["MDS"]).collect()
    assert [tuple(r) for r in got] == [("S1", "LE", "MDS", 0.5, 0.9, 20.0, -1.5)]


def test_generator(spark):
    df = synthetic_sites(spark, sites=2, days=30, noise=0.0, gap_fraction=0.1, seed=2)
    s = one(df.agg(F.count("*").alias("n"), F.max(F.abs(F.col("H_truth") + F.col("LE_truth") - F.col("net_radiation") + F.col("ground_heat_flux"))).alias("closure"), F.min("relative_humidity").alias("lo"), F.max("relative_humidity").alias("hi"), F.count_if(F.isnan("LE")).alias("nan"), F.count_if(F.col("LE").isNull() & (F.col("LE_QC") != 3)).alias("odd")))
    assert s["n"] == 2 * 30 * 48 and s["closure"] < 1e-9 and 5 <= s["lo"] and s["hi"] <= 100 and s["nan"] == 0 and s["odd"] == 0
    assert 0.02 < df.where("LE is null").count() / s["n"] < 0.15


def test_daily_stream(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, [1.0] * 24 + [2.0] * 24 + [3.0] * 24 + [4.0] * 24, step=60).coalesce(1).write.parquet(src)
    stream = scoring.daily_stream(spark.readStream.schema("site_id string, ts timestamp_ntz, v double").parquet(src), "v", "1 hour")
    scoring.run_available(stream, dst, str(tmp_path / "c"))
    got = {str(r["day"]): (r["n"], r["mean"]) for r in spark.read.parquet(dst).collect()}
    assert got["2020-06-01"] == (24, 1.0) and got["2020-06-03"] == (24, 3.0)
