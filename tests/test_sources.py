"""Readers of published site tables, availability of headers and sites, spellings, descriptions of features."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, FillError, SourceError
from tidemark.functions import spellings
from tidemark.operators import fill
from tidemark.operators.gaps import GapScenario
from tidemark.plans.config import DRIVERS, FeatureConfig, RunConfig
from tidemark.sources import site_tables, tables

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(path, caption, *bodies):
    """A Word document of captions and tables; a cell is text or a list of paragraphs."""
    cell = lambda c: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in ([c] if isinstance(c, str) else c)) + "</w:tc>"
    parts = [f"<w:p><w:r><w:t>{c}</w:t></w:r></w:p>" for c in caption]
    parts += ["<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in body) + "</w:tbl>" for body in bodies]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(parts)}</w:body></w:document>')
    return str(path)


HEAD9 = [["", "MDS", "", "", "", "RFR3", "", "", ""], ["Site", *["R2", "Slope", "RMSE", "Bias"] * 2]]
HEAD = [["", "MDS", "", "", "", "RFR3", "", "", "", "RFR10", "", "", ""], ["Site", *["R2", "Slope", "RMSE", "Bias"] * 3]]


def test_nee_scores(spark, tmp_path):
    rows = [*HEAD9, ["A-1", "0.5", "0.9", "2", "−1.5", "0.75", "", "3", "0"], [""] * 9, ["B-2", *["1"] * 8]]
    path = document(tmp_path / "s9.docx", ["Supplementary Table S9. Scores"], rows)
    got = {(r["site"], r["method"]): r for r in site_tables.read_nee_scores(spark, path).collect()}
    assert len(got) == 4 and list(next(iter(got.values())).asDict()) == list(site_tables.SCORE_COLUMNS)
    a = got["A-1", "MDS"]
    assert (a["target"], a["mode"], a["r2"], a["bias"], a["units"], a["site_population"], a["source"], a["n"]) == ("NEE", None, 0.5, -1.5, "umol CO2 m-2 s-1", "194-site set", "Table S9", None)
    assert got["A-1", "RFR3"]["slope"] is None and got["A-1", "RFR3"]["mode"] == "RFR3"
    assert {r["units"] for r in site_tables.read_nee_scores(spark, path, "x").collect()} == {"x"}


def test_three_tables_of_a_document(spark, tmp_path):
    block = lambda v: [*HEAD, ["LE", *[""] * 12], ["A", *[v] * 12], ["NEE", *[""] * 12], ["A", *[v] * 12]]
    path = document(tmp_path / "s.docx", ["Table S4", "Table S5", "Table S6"], block("1"), block("2"), block("3"))
    got = site_tables.read_diel_scores(spark, path)
    assert got.count() == 18
    assert sorted(map(tuple, got.select("subset", "r2", "source").distinct().collect())) == [("all", 1.0, "Table S4"), ("daytime", 2.0, "Table S5"), ("nighttime", 3.0, "Table S6")]
    assert sorted(map(tuple, got.select("target", "units").distinct().collect())) == [("LE", "W m-2"), ("NEE", "g C m-2 d-1")]


@pytest.mark.parametrize(
    "rows, message",
    [
        ([HEAD[0][:9], HEAD[1], ["H", *[""] * 12], ["A", *["1"] * 12]], "must name MDS"),
        ([HEAD[0], ["Site", *["R2", "RMSE"] * 6], ["H", *[""] * 12], ["A", *["1"] * 12]], "must be r2, slope"),
        ([*HEAD, ["A", *["1"] * 12]], "before any target"),
        ([*HEAD, ["H", *[""] * 12], ["A", *["1"] * 11]], "is not of 13 cells"),
        ([*HEAD, ["H", *[""] * 12], ["A", *["1"] * 11, "n/a"]], "is no number"),
        ([*HEAD, ["H", *[""] * 12], ["A", *["1"] * 12], ["A", *["1"] * 12]], "scored twice"),
    ],
)
def test_other_layouts_are_refused(spark, rows, message):
    cells = spark.createDataFrame([("d", 0, k, r) for k, r in enumerate(rows)], "file string, table_no int, row_no int, cells array<string>")
    with pytest.raises(SourceError, match=message):
        site_tables.read_score_cells(cells, site_tables.S4)


def test_sites_of_several_documents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    document(tmp_path / "d" / "a.docx", ["Table S2"], [["x", "y"], ["1", "2"]], [["", "Latitude", "IGBP", "Start"], ["A", "−33.5", "Wet", "2001"], ["B", "10", "cro", ""]])
    document(tmp_path / "d" / "b.docx", ["Table S2"], [["", "IGBP", "Latitude"], ["D", ["ENF", ""], "2"]])
    got = {r["site_id"]: r for r in site_tables.read_sites(spark, str(tmp_path / "d")).collect()}
    assert sorted(got) == ["A", "B", "D"] and got["A"]["latitude"] == -33.5 and got["A"]["igbp"] == "WET" and got["A"]["start_date"].year == 2001
    assert got["B"]["start_date"] is None and got["D"]["igbp"] == "ENF" and got["D"]["latitude"] == 2.0
    with pytest.raises(SourceError, match="does not have Table S9"):
        site_tables.read_nee_scores(spark, str(tmp_path / "d"))
    with pytest.raises(SourceError, match="not as wide"):
        site_tables.read_sites(spark, document(tmp_path / "c.docx", ["Table S2"], [["", "Latitude", "IGBP"], ["A", "1"]]))
    with pytest.raises(SourceError, match="no table with"):
        site_tables.read_sites(spark, document(tmp_path / "e.docx", ["Table S2"], [["", "Latitude"], ["A", "1"]]))
    (tmp_path / "f.docx").write_text("no archive")
    with pytest.raises(Exception, match="is not a Word document"):
        tables.docx_tables(spark, str(tmp_path / "f.docx")).collect()


def test_paragraphs_of_a_cell_are_apart(spark, tmp_path):
    path = document(tmp_path / "p.docx", [], [[["two ", "words"], "one"]])
    assert tables.docx_tables(spark, path).first()["cells"] == ["two words", "one"]


def test_availability_of_a_header():
    found = tables.inspect(["TIMESTAMP_START", "SW_IN_F", "VPD_F_MDS", "TA_F_MDS", "H_F_MDS", "LE_F_MDS", "LE_F_MDS_QC"])
    assert found.stamp == "TIMESTAMP_START" and found.lacks("RFR10")[0] == "net_radiation" and found.lacks("RFR3") == ()
    assert found.missing_fluxes == {"NEE": "NEE_VUT_REF"} and found.missing_flags == {"NEE": "NEE_VUT_REF_QC", "H": "H_F_MDS_QC"}
    assert found.target_columns() == ("H_F_MDS", "LE_F_MDS") and found.flag_columns() == {"LE_F_MDS": "LE_F_MDS_QC"} and found.heat_targets() == ("H_F_MDS", "LE_F_MDS")
    assert found.column_map() == {"shortwave": "SW_IN_F", "vapour_pressure_deficit": "VPD_F_MDS", "air_temperature": "TA_F_MDS"}
    assert found.column_map("RFR3", {"air_temperature": "T2"})["air_temperature"] == "T2"
    assert found.require("RFR3", ["LE"]) == found.column_map()
    with pytest.raises(SourceError, match="driver net_radiation.*flux NEE.*flags of H"):
        found.require("RFR10", ["NEE", "H"])
    with pytest.raises(SourceError, match="net_radiation"):
        found.column_map("RFR10")
    with pytest.raises(SourceError, match="no flux NEE"):
        found.target_columns(["NEE"])
    assert "3 of 10 drivers, best mode RFR3" in found.summary() and found.to_dict()["best_mode"] == "RFR3"
    assert tables.inspect([]).heat_targets() is None and tables.inspect([]).best_mode() is None


def test_availability_of_sites(spark):
    rows = [("a", 1.0, 1.0, 1.0), ("a", 2.0, None, 1.0), ("b", 1.0, float("nan"), 1.0), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "site_id string, sw double, v double, t double")
    columns = {"shortwave": "sw", "vapour_pressure_deficit": "v", "air_temperature": "t"}
    got = {r["site_id"]: (r["n_rows"], r["n_drivers"], r["rows_RFR3"], r["rows_RFR10"], r["best_mode"]) for r in tables.site_availability(df, columns).collect()}
    assert got == {"a": (2, 3, 1, 0, "RFR3"), "b": (1, 2, 0, 0, None), "c": (1, 0, 0, 0, None)}
    assert {r["site_id"]: r["best_mode"] for r in tables.site_availability(df, columns, 2).collect()}["a"] is None
    assert {r["best_mode"] for r in tables.site_availability(df, dict.fromkeys(DRIVERS, "sw")).where("site_id <> 'c'").collect()} == {"RFR10"}
    with pytest.raises(SourceError, match="unknown drivers"):
        tables.site_availability(df, {"sun": "sw"})


def test_spellings(spark):
    assert spellings.coerce(" Very-Long ", ("short", "very_long"), "class") == "very_long"
    for bad in ("week", None, 3):
        with pytest.raises(ConfigError, match="known are"):
            spellings.coerce(bad, ("short",), "class", spellings.GAP_CLASS_SPELLINGS)
    assert RunConfig(mode="rfr10", hemisphere="S").side == "south" and RunConfig(mode="rfr10").digest() == RunConfig(mode="RFR10").digest()
    assert dict(GapScenario(mix={"24h": 0.2, "7d": 0.3, "30D": 0.5}).mix) == {"short": 0.2, "long": 0.3, "very_long": 0.5}
    df = spark.createDataFrame([("7d",), ("week",), ("week",), (None,)], "c string")
    assert [tuple(r) for r in spellings.unknown_spellings(df, "c", ("long",), spellings.GAP_CLASS_SPELLINGS).collect()] == [("week", 2)]


def test_description_of_features():
    new = RunConfig(latitude=-3.0).feature_description("LE")
    assert new["names"][-1] == "LE_daily_std" and new["hemisphere"] == "south" and new["hemisphere_from"] == "latitude" and new["season_codes"]["autumn"] == 3 and new["ddof"] == 1
    old = RunConfig(hemisphere="north", features=FeatureConfig(mode="legacy")).feature_description("LE")
    assert old["sees_withheld_truth"] and old["season_codes"]["winter"] == 1 and old["names"][0] == "LE_max"
    plain = RunConfig(features=FeatureConfig(use_limiter=False)).feature_description("LE")
    assert plain["names"] == plain["drivers"] and "hemisphere" not in plain


def test_filled(spark):
    rows = spark.range(10).select(F.lit("a").alias("site_id"), F.timestamp_add("HOUR", F.col("id"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ts"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"))
    frame = fill.with_provenance(rows.withColumn("p", F.lit(7.0)), "v", "p", "RFR3", "x")
    done = fill.Filled(frame, "v", "RFR3", RunConfig())
    assert list(done.columns) == ["original", "filled", "is_observed", "is_filled", "fill_method", "model_version"] and done.column("is_filled").where("is_filled").count() == 4
    assert done.to_dict()["fill"]["filled_rows"] == 4 and done.report(by_site=True).first()["site_id"] == "a" and done.axis().first()["n"] == 10
    with pytest.raises(FillError, match="no column"):
        done.column("other")
