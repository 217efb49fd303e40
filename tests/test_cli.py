import json

from tidemark import cli
from tidemark.functions.synthetic import synthetic_sites
from tidemark.sources import tables

SCHEMA = "site_id string, stamp string, shortwave double, vapour_pressure_deficit double, air_temperature double, LE double, LE_QC int"


def test_fill_from_a_file(spark, tmp_path, capsys):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = synthetic_sites(spark, sites=1, days=12).selectExpr("site_id", "date_format(ts, 'yyyyMMddHHmm') AS stamp", *names[2:])
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    (tmp_path / "c.json").write_text(json.dumps({"grid": {"n_estimators": [5], "max_depth": [5]}, "partitions": 2, "hemisphere": "north", "features": {"daily_strategy": "rolling_available"}}))
    call = ["fill", str(tmp_path / "in"), "--schema", SCHEMA, "--config", str(tmp_path / "c.json"), "--timestamp", "stamp", "--format", "yyyyMMddHHmm", "--target", "LE", "--qc", "LE=LE_QC", "--out", str(tmp_path / "out")]
    assert cli.main(call) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out/LE/filled")).count() == 12 * 48
    assert tables.read_manifest(spark, str(tmp_path / "out/LE"))["target"] == "LE"
    (tmp_path / "bad.json").write_text(json.dumps({"mode": "none"}))
    call[call.index("--config") + 1] = str(tmp_path / "bad.json")
    assert cli.main(call) == 1 and "unknown mode" in capsys.readouterr().err
