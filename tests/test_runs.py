"""Runs and their accounts: closure, unscored rows, manifests, a model per site, metadata rules, stored models, stamps, replays."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, GapError, GapWarning, MetricError, ModelError, ModelWarning, ProvenanceError, ReportError, TimeAxisError, ValidationWarning
from tidemark.functions.synthetic import synthetic_sites
from tidemark.operators import constraints, fill, gaps, heldout, masks, metrics, model, reports, timeaxis
from tidemark.plans import accounting, config
from tidemark.plans.validation import validate, wide_predictions
from tidemark.sources import tables

GRID = {"n_estimators": (5,), "max_depth": (5,), "max_bins": (32,)}
T0 = datetime(2020, 6, 1)


def settings(**more):
    features = more.pop("features", config.FeatureConfig(daily_strategy="rolling_available", fallback_window_days=3))
    return config.RunConfig(hemisphere="north", grid=GRID, partitions=2, features=features, **more)


def intervals(df, rows):
    start = df.agg(F.min("ts")).first()[0]
    made = [(i, c, start + timedelta(hours=a), start + timedelta(hours=b)) for i, c, a, b in rows]
    return df.sparkSession.createDataFrame(made, "gap_id string, gap_class string, start timestamp_ntz, end timestamp_ntz").crossJoin(df.select("site_id").distinct())


@pytest.fixture(scope="module")
def year(spark):
    return synthetic_sites(spark, sites=2, days=10, seed=5).persist()


# --- closure and unscored rows -----------------------------------------------------------------------------------------


def held(spark, rows):
    return spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, gap_class string, measured double, predicted double")


def test_wide_predictions_keep_stamps_that_one_target_lacks(spark):
    at = [T0 + timedelta(minutes=30 * k) for k in range(3)]
    h = held(spark, [("a", at[0], "short", 1.0, 2.0), ("a", at[1], "short", None, 3.0)])
    le = held(spark, [("a", at[1], "short", 5.0, float("nan")), ("a", at[2], "long", 7.0, 8.0)])
    got = {r["ts"]: tuple(r)[2:] for r in heldout.wide_predictions({"H": h, "LE": le}).collect()}
    assert got == {at[0]: ("short", 1.0, 2.0, None, None), at[1]: ("short", None, 3.0, 5.0, None), at[2]: ("long", None, None, 7.0, 8.0)}
    with pytest.raises(MetricError):
        heldout.wide_predictions({})


def test_energy_balance_counts_what_each_part_costs(spark):
    columns = "site_id string, ts timestamp_ntz, gap_class string, H_measured double, H_predicted double, LE_measured double, LE_predicted double, nr double, g double"
    rows = [
        ("a", T0, "short", 10.0, 12.0, 20.0, 18.0, 50.0, 10.0), ("a", T0, "long", 30.0, 20.0, 10.0, 10.0, 60.0, 0.0), ("a", T0, "long", None, 20.0, 10.0, 10.0, 60.0, 0.0),
        ("a", T0, "long", 1.0, None, 10.0, None, 60.0, None), ("b", T0, "short", 1.0, 1.0, 1.0, 1.0, -5.0, 0.0),
    ]
    got = {(r["site_id"], r["gap_class"]): r for r in heldout.energy_balance(spark.createDataFrame(rows, columns), ("H", "LE"), "nr", "g", ("short", "long", "very_long")).collect()}
    assert len(got) == 8
    whole = got["a", "all"]
    assert (whole["n"], whole["n_offered"], whole["n_missing_measured"], whole["n_missing_filled"], whole["n_missing_available_energy"]) == (2, 4, 1, 1, 1)
    assert math.isclose(whole["measured_ebr"], 70 / 100) and math.isclose(whole["filled_ebr"], 60 / 100) and math.isclose(whole["difference"], -0.1)
    assert math.isclose(got["a", "short"]["filled_ebr"], 30 / 40) and got["a", "long"]["n_offered"] == 3
    assert got["a", "very_long"]["n_offered"] == 0 and got["a", "very_long"]["filled_ebr"] is None and got["a", "very_long"]["available_energy"] is None
    assert got["b", "all"]["n"] == 1 and got["b", "all"]["filled_ebr"] is None  # no energy to close on
    with pytest.raises(MetricError):
        heldout.energy_balance(spark.createDataFrame(rows, columns), ("H", "H"), "nr", "g")
    with pytest.raises(MetricError, match="NEE"):
        heldout.energy_balance(spark.createDataFrame(rows, columns), ("H", "NEE"), "nr", "g")


def test_validation_carries_closure_counts_and_a_full_manifest(spark, year, tmp_path):
    c = settings(validation=config.ValidationConfig(energy_balance=True))
    found = validate(year, c, ["H", "LE"], {"H": "H_QC", "LE": "LE_QC"}, intervals(year, [("g1", "short", 48, 72), ("g2", "long", 100, 150)]))
    balance = found["H"].energy_balance
    assert balance is found["LE"].energy_balance
    rows = {(r["site"], r["gap_class"]): r for r in balance.collect()}
    wide = wide_predictions(found).join(year.select("site_id", "ts", "net_radiation", "ground_heat_flux"), ["site_id", "ts"]).toPandas()
    for (site, gap_class), r in rows.items():
        own = wide[(wide["site_id"] == site) & ((wide["gap_class"] == gap_class) | (gap_class == "all"))]
        whole = own.dropna(subset=["H_measured", "LE_measured", "H_predicted", "LE_predicted", "net_radiation", "ground_heat_flux"])
        assert r["n"] == len(whole) and r["n_offered"] == len(own) and r["method"] == "RFR3"
        energy = (whole["net_radiation"] - whole["ground_heat_flux"]).sum()
        if energy > 0:
            assert math.isclose(r["measured_ebr"], (whole["H_measured"] + whole["LE_measured"]).sum() / energy, rel_tol=1e-9)
            assert math.isclose(r["filled_ebr"], (whole["H_predicted"] + whole["LE_predicted"]).sum() / energy, rel_tol=1e-9)
    h = found["H"]
    reasons = h.unscored.toPandas()
    assert (reasons["n_offered"] == reasons["n_scored"] + reasons[list(heldout.REASONS)].sum(axis=1)).all()
    assert reasons["n_offered"].sum() == h.rows.prediction_rows_offered == 2 * (48 + 100)
    manifest = accounting.require_complete(h.manifest())
    assert manifest["rows"]["training_rows"] == h.forest.report["fitted_rows"] and len(manifest["gaps"]["intervals"]) == 4
    tables.write_results({"metrics": h.scores}, str(tmp_path / "r"), h.manifest())
    assert tables.read_manifest(spark, str(tmp_path / "r"))["seed"] == 42
    with pytest.raises(ConfigError, match="ground_heat_flux"):
        validate(year.drop("ground_heat_flux"), c, ["H", "LE"])
    with pytest.raises(ConfigError, match="not validated"):
        validate(year, c, ["H"], energy_pair=("H", "LE"))


def test_settings_of_a_validation_have_effect(spark, year):
    c = settings(validation=config.ValidationConfig(by_gap_class=False, bias_spread=False, energy_balance=True))
    gap = intervals(year, [("g1", "short", 48, 60)])
    found = validate(year, c, ["LE"], intervals=gap)["LE"]
    assert found.spread is None and found.energy_balance is None  # no pair
    assert {r["gap_class"] for r in found.scores.select("gap_class").distinct().collect()} == {"all"}
    twice = year.unionByName(year.where("hour(ts) = 3")).withColumn("nr", F.monotonically_increasing_id())
    with pytest.raises(TimeAxisError):
        validate(twice, c, ["LE"], intervals=gap)
    once = validate(twice, c, ["LE"], intervals=gap, on_duplicates="keep_first", sequence="nr")["LE"]
    assert once.rows == found.rows
    with pytest.raises(ModelError):
        validate(year, c, ["LE"], intervals=gap, min_rows=10**6)
    with pytest.raises(ConfigError, match="lacks nothing"):
        validate(year, c, ["nothing"], intervals=gap)


def test_a_run_that_scores_nothing_warns(year):
    whole_days = intervals(year, [("g1", "long", 48, 120)])
    with pytest.warns(ValidationWarning, match="none of"):
        found = validate(year, settings(features=config.FeatureConfig(daily_strategy="missing")), ["LE"], intervals=whole_days)["LE"]
    assert found.rows.prediction_rows == 0 and found.rows.prediction_rows_offered == 288


def test_scores_put_together_from_cells_equal_those_of_the_rows(spark):
    rows = [("a", c, d, 1000 + k * 0.37 + (k % 5), 999 + k * 0.4 if k % 7 else None) for k in range(60) for c, d in [((None, "short", "long")[k % 3], 10.0 * (k % 4))]]
    df = spark.createDataFrame(rows, "site string, gap_class string, sw double, m double, p double")
    for options in ({}, {"definition": "squared_correlation"}, {"intercept": False}):
        got = {(r["gap_class"], r["subset"]): r for r in metrics.metrics_grid(df, "m", "p", "gap_class", masks.subsets("sw"), ["site"], ["short", "long", "none"], list(masks.SUBSETS), **options).collect()}
        assert len(got) == 12
        for (gap_class, subset), r in got.items():
            own = df if gap_class == "all" else df.where(F.col("gap_class") == gap_class)
            own = own.where({"all": "true", "daytime": "sw > 20", "nighttime": "sw <= 20"}[subset])
            want = own.agg(*metrics.core_metrics("m", "p", **options)).first()
            for name in ("n", "n_offered", "r2", "slope", "rmse", "bias"):
                assert r[name] == want[name] or math.isclose(r[name], want[name], rel_tol=1e-9), (gap_class, subset, name)


# --- manifests ---------------------------------------------------------------------------------------------------------


def test_row_counts_refuse_contradictions():
    ok = accounting.RowCounts(5, 8, 2, 3)
    assert ok.to_dict()["training_rows_dropped"] == 3 and ok.to_dict()["prediction_rows_dropped"] == 1
    for bad in ((9, 8, 0, 0), (1, 1, 4, 3), (-1, 1, 0, 0), (True, 1, 0, 0), (1.0, 1, 0, 0)):
        with pytest.raises(ProvenanceError):
            accounting.RowCounts(*bad)


def test_an_incomplete_manifest_is_refused_before_anything_is_written(spark, tmp_path):
    df, path = spark.range(2), str(tmp_path / "r")
    full = {s: {"x": 1} for s in (*accounting.SECTIONS, "fill")} | {"format": accounting.MANIFEST_FORMAT, "kind": "fill", "rows": accounting.RowCounts(1, 2, 1, 2).to_dict()}
    for s in (*accounting.SECTIONS, "fill"):
        with pytest.raises(ProvenanceError, match=s):
            tables.write_results({"t": df}, path, {k: v for k, v in full.items() if k != s})
    with pytest.raises(ProvenanceError, match="training"):
        tables.write_results({"t": df}, path, full | {"rows": {"training_rows": 3, "training_rows_offered": 1, "prediction_rows": 0, "prediction_rows_offered": 0}})
    assert not (tmp_path / "r").exists()
    tables.write_results({"t": df}, path, full)
    assert tables.read_manifest(spark, path)["rows"]["training_rows"] == 1
    tables.write_results({"t": df}, path + "2", {"kind": "x"}, check=False)
    with pytest.raises(ProvenanceError):
        tables.read_manifest(spark, path + "2")
    with pytest.raises(ProvenanceError):
        tables.read_manifest(spark, path + "3")


def test_a_fill_is_counted_by_the_pass_that_writes_it(spark, year, tmp_path):
    df = year
    filler = fill.GapFiller(settings()).fit(df, "LE", "LE_QC")
    manifest = accounting.write_fill(filler, df, str(tmp_path / "f"))
    back = spark.read.option("header", True).csv(str(tmp_path / "f/filled"))
    report = spark.read.option("header", True).csv(str(tmp_path / "f/report")).first()
    assert manifest["rows"]["prediction_rows"] == back.where("LE_is_filled = 'true'").count() == int(report["filled_rows"])
    assert manifest["rows"]["prediction_rows_offered"] == back.where("LE_original is null").count() == int(report["candidate_rows"])
    assert manifest["axis"]["n"] == df.count() and tables.read_manifest(spark, str(tmp_path / "f"))["digest"] == settings().digest()


# --- a model per site --------------------------------------------------------------------------------------------------


def test_models_per_site_equal_single_fills(spark, tmp_path):
    sites = synthetic_sites(spark, sites=4, days=8, seed=2)
    few = sites.where("site_id = 'site-0'").limit(0)
    names = sorted(r["site_id"] for r in sites.select("site_id").distinct().collect())
    # one site has no value to learn from
    df = sites.withColumn("LE", F.when(F.col("site_id") != names[-1], F.col("LE"))).unionByName(few).persist()
    made = fill.SiteFillers(settings(), str(tmp_path / "sites"))
    state = {r["site_id"]: r for r in made.fit(df, "LE", "LE_QC").collect()}
    assert {s: r["state"] for s, r in state.items()} == {s: fill.FEW_ROWS if s == names[-1] else fill.FITTED for s in names}
    assert state[names[-1]]["fitted_rows"] == 0 and state[names[-1]]["rows"] == 8 * 48
    got = {(r["site_id"], r["ts"]): (r["LE_filled"], r["LE_fill_method"]) for r in made.fill(df).collect()}
    assert len(got) == 4 * 8 * 48
    for s in names[:-1]:
        own = df.where(F.col("site_id") == s)
        for r in fill.GapFiller(settings()).fit(own, "LE", "LE_QC").fill(own).collect():
            assert got[s, r["ts"]] == (r["LE_filled"], r["LE_fill_method"])
    assert {m for (s, _), (_, m) in got.items() if s == names[-1]} == {"unfilled_incomplete_features"}
    # run again on the folder: the stored models are used
    again = fill.SiteFillers(settings(), str(tmp_path / "sites"))
    assert {r["site_id"]: r["rows_digest"] for r in again.fit(df, "LE", "LE_QC").collect()} == {s: r["rows_digest"] for s, r in state.items()}


# --- stored models -----------------------------------------------------------------------------------------------------


def test_a_stored_model_knows_its_rows_settings_and_versions(spark, year, tmp_path):
    rows = year.select("site_id", "ts", "shortwave", "air_temperature", "LE")
    forest = model.fit(rows, ["shortwave", "air_temperature"], "LE", GRID, partitions=2)
    forest.settings = "s1"
    path = str(tmp_path / "m")
    forest.save(path)
    back = model.Forest.load(spark, path, "s1")
    assert back.rows == forest.rows and back.fitted_on(rows.orderBy(F.rand(3)).repartition(5)) and not back.fitted_on(rows.limit(400))
    assert not back.fitted_on(rows.withColumn("LE", F.when(F.col("ts") > F.lit(T0), F.col("LE") + 1e-9).otherwise(F.col("LE") + 1)))
    with pytest.raises(ModelError, match="settings"):
        model.Forest.load(spark, path, "s2")
    with pytest.raises(ModelError, match="no saved forest"):
        model.Forest.load(spark, path + "x")
    text = spark.read.text(f"{path}/meta").first()["value"].replace('"pyspark": "', '"pyspark": "0.')
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(str(tmp_path / "m2/meta"))
    back.model.write().save(str(tmp_path / "m2/forest"))
    with pytest.warns(ModelWarning, match="pyspark 0"):
        model.Forest.load(spark, str(tmp_path / "m2"))


def test_digest_of_rows_counts_repeats_and_ignores_order(spark):
    digest = lambda rows: tuple(model.rows_digest(spark.createDataFrame(rows, "a long, b string"), ["a", "b"]).first())
    rows = [(1, "x"), (2, None), (2, ""), (3, "y")]
    assert digest(rows) == digest(rows[::-1]) and digest(rows) != digest(rows[:3]) and digest([*rows, rows[0], rows[0]]) != digest(rows)
    assert digest([(1, None)]) != digest([(1, "-")]) and tuple(model.rows_digest(spark.range(0), ["id"]).first()) == (0, "0", 0)


# --- metadata ----------------------------------------------------------------------------------------------------------

META = "Site string, Lat string, LONG string, IGBP string, System string, Start string, End string, Note string"


def test_every_breach_of_metadata_is_listed(spark):
    rows = [("A", "91", "0", "Wet", "O", "2001-01-01", "2000-01-01", "n"), ("A", "x", "-181", "zzz", "P", "soon", None, None), (None, None, None, None, None, None, None, None), ("B", "−45", "10", "cro", "c", "2001", "2002", None)]
    raw = spark.createDataFrame(rows, META)
    got = sorted((r["site_id"] or "", r["field"], r["rule"]) for r in reports.site_violations(raw).collect())
    assert got == sorted([
        ("A", "latitude", "out of range"), ("A", "end_date", "before start_date"), ("A", "latitude", "unreadable"), ("A", "longitude", "out of range"), ("A", "igbp", "unknown code"),
        ("A", "instrument_system", "unknown code"), ("A", "start_date", "unreadable"), ("", "site_id", "missing"), ("A", "site_id", "repeated"), ("A", "site_id", "repeated"),
    ])
    with pytest.raises(ReportError, match="igbp unknown code: 1 rows, such as A"):
        reports.site_metadata(raw)
    good = reports.site_metadata(raw.where("Site = 'B'"))
    assert good.columns == [*reports.CANONICAL, "note"]
    r = good.first()
    assert (r["latitude"], r["igbp"], r["instrument_system"], r["start_date"], r["elevation"]) == (-45.0, "CRO", "C", datetime(2001, 1, 1), None)
    assert reports.site_metadata(good).first() == r
    with pytest.raises(ReportError, match="both describe latitude"):
        reports.site_metadata(raw.withColumn("latitude", F.lit("1")))
    with pytest.raises(ReportError, match="no site column"):
        reports.site_metadata(raw.drop("Site"))
    assert constraints.describe(reports.site_violations(raw.where("Site = 'B'")), "site_id") == []


def test_a_repeated_site_or_a_stratum_named_all_is_refused(spark):
    results = spark.createDataFrame([("A", "LE", "m", "d", "all", "all", 1, 1, 0.5, 1.0, 1.0, 0.0, "u")], "site string, target string, method string, mode string, gap_class string, subset string, n long, n_offered long, r2 double, slope double, rmse double, bias double, units string")
    twice = spark.createDataFrame([("A", "CRO"), ("A", "GRA")], "site_id string, igbp string")
    with pytest.raises(ReportError, match="2 rows of metadata"):
        reports.site_report(results, twice)
    report = reports.site_report(results, spark.createDataFrame([("A", "all")], "site_id string, igbp string"))
    with pytest.raises(Exception, match="pool of all"):
        reports.stratified_summary(report, "igbp").collect()


# --- stamps and gaps ---------------------------------------------------------------------------------------------------


def test_stamps_with_offsets(spark):
    at = {
        "2020-01-01T00:30:00Z": datetime(2020, 1, 1, 0, 30), "2020-01-01 00:30:00+05:30": datetime(2019, 12, 31, 19, 0), "2020-01-01T00:30-0800": datetime(2020, 1, 1, 8, 30),
        "2020-01-01T00:30:00.250+01": datetime(2019, 12, 31, 23, 30, 0, 250_000), "2020-05-01": datetime(2020, 5, 1), "2020-01-01 00:30": datetime(2020, 1, 1, 0, 30), "soon": None, "": None, None: None,
    }
    df = spark.createDataFrame([("a", k) for k in at], "site_id string, stamp string")
    got = {r["stamp"]: r["t"] for r in df.select("stamp", timeaxis.parse_offset("stamp").alias("t")).collect()}
    assert got == at
    report = timeaxis.stamp_report(df, "stamp").first()
    assert (report["n"], report["n_bad"], report["n_naive"], report["n_offsets"]) == (9, 3, 2, 4)
    with pytest.raises(TimeAxisError, match="3 of 9"):
        timeaxis.set_text_time(df, "stamp")
    good = df.where("length(stamp) > 4")
    with pytest.raises(TimeAxisError, match="mixes offsets"):
        timeaxis.set_text_time(good, "stamp")
    assert timeaxis.set_text_time(good, "stamp", "utc").agg(F.min("ts")).first()[0] == datetime(2019, 12, 31, 19, 0)
    assert timeaxis.set_text_time(good.where("stamp like '%Z'"), "stamp").count() == 1


def test_interval_bounds():
    assert timeaxis.interval_bounds(T0, duration="1d") == (T0, T0 + timedelta(days=1)) == timeaxis.interval_bounds(T0, T0 + timedelta(days=1))
    for bad in ({}, {"end": T0, "duration": "1d"}, {"end": T0}):
        with pytest.raises(TimeAxisError):
            timeaxis.interval_bounds(T0, **bad)


def test_a_gap_manifest_can_be_replayed(spark, year, tmp_path):
    ok, steps = masks.observed("LE", "LE_QC"), timeaxis.step_of(year, "30min")
    stored = gaps.count_rows(year, intervals(year, [("g1", "short", 24, 30), ("g2", "long", 48, 96)]), steps, ok)
    gaps.save(stored, str(tmp_path / "g"), gaps.GapScenario(), 7, ["LE"], ["a note"])
    back, meta = gaps.load(spark, str(tmp_path / "g"))
    assert meta["seed"] == 7 and meta["targets"] == ["LE"] and meta["warnings"] == ["a note"] and sorted(map(tuple, back.collect())) == sorted(map(tuple, stored.collect()))
    assert gaps.require_replay(year, back, steps, ok) is back
    changed = year.where("not (hour(ts) = 1)")
    assert {r["gap_id"]: r["same"] for r in gaps.replay(changed, back, steps, ok).collect()} == {"g1": False, "g2": False}
    with pytest.raises(GapError, match="when it was made"):
        gaps.require_replay(changed, back, steps, ok)
    with pytest.raises(GapError, match="no gap manifest"):
        gaps.load(spark, str(tmp_path / "h"))
    with pytest.warns(GapWarning, match="share off"):
        assert gaps.warn_on_tolerance(gaps.achieved(year, stored, ok, gaps.GapScenario()))


@pytest.mark.parametrize("overlap", [False, True])
def test_gaps_are_those_of_a_plain_walk(spark, overlap):
    """Placing by totals of days draws and takes the starts that a walk over the whole series does, over days without rows as well."""
    df = synthetic_sites(spark, sites=2, days=40, seed=4).where("dayofyear(ts) % 11 <> 3 and not (site_id like '%1' and minute(ts) = 30)").persist()
    ok, steps = masks.observed("LE", "LE_QC"), timeaxis.step_of(df, "30min")
    day = timedelta(days=1)
    scenario = gaps.GapScenario(durations={"short": day / 2, "long": 2 * day, "very_long": 5 * day}, missing_fraction=0.3, max_attempts=6, allow_overlap=overlap, min_observed_fraction=0.4)
    plan = {(r["site_id"], r["gap_class"]): (r["events"], r["per_event"]) for r in gaps.allocate(gaps.site_spans(df, steps, ok), scenario.table(spark), scenario.missing_fraction, scenario.basis).collect()}
    want = []
    for site in sorted({s for s, _ in plan}):
        rows = sorted((r["ts"], r["ok"]) for r in df.where(F.col("site_id") == site).select("ts", ok.alias("ok")).collect())
        rng, taken = np.random.default_rng(9), []
        for name in ("very_long", "long", "short"):
            events, expected = plan[site, name]
            span = scenario.durations[name]
            starts = sum(t + span <= rows[-1][0] + timedelta(minutes=30) for t, _ in rows)
            for _ in range(events if starts else 0):
                for _ in range(scenario.max_attempts):
                    lo = int(rng.integers(starts))
                    hi = lo + sum(rows[lo][0] <= t < rows[lo][0] + span for t, _ in rows)
                    n = sum(o for _, o in rows[lo:hi])
                    if (overlap or all(hi <= a or b <= lo for a, b, *_ in taken)) and n >= scenario.min_observed_fraction * expected:
                        taken.append((lo, hi, name, n))
                        break
                else:
                    break
        want += [(site, name, rows[lo][0], hi - lo, n) for lo, hi, name, n in taken]
    got = gaps.place(df, steps, ok, scenario, 9, "ignore").select("site_id", "gap_class", "start", "n_rows", "n_observed_before_masking").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
