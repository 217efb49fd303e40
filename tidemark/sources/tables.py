"""Sources and sinks: CSV with text stamps, sentinels, header discovery, flag counts, Word tables, result folders."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from io import BytesIO
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ProvenanceError, SourceError
from ..functions.expressions import finite
from ..plans.accounting import MANIFEST_FORMAT, require_complete
from ..plans.config import DRIVERS, MODES

SENTINEL = -9999.0
# Usual station names of the drivers, of the fluxes and of their flags.
STATION_NAMES = {
    "shortwave": "SW_IN_F", "vapour_pressure_deficit": "VPD_F_MDS", "air_temperature": "TA_F_MDS", "net_radiation": "NETRAD", "wind_speed": "WS",
    "wind_direction": "WD", "ground_heat_flux": "G_F_MDS", "soil_temperature": "TS_F_MDS", "relative_humidity": "RH", "soil_water": "SWC_F_MDS",
}
FLUX_NAMES = {"NEE": "NEE_VUT_REF", "H": "H_F_MDS", "LE": "LE_F_MDS"}
#: Drivers measured at several depths, numbered from the surface.
DEPTHS = ("soil_temperature", "soil_water")


def parse_stamp(text: str | Column, pattern: str = "yyyyMMddHHmm") -> Column:
    """A stamp such as 201801010030 (a trailing .0 goes); anything else is an error in ANSI mode."""
    c = F.col(text) if isinstance(text, str) else text
    return F.to_timestamp_ntz(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), F.lit(pattern))


def replace_sentinel(df: DataFrame, sentinel: float = SENTINEL, columns: Sequence[str] | None = None) -> DataFrame:
    """Exactly the sentinel becomes null, in numeric columns only."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    chosen = [c for c in numeric if columns is None or c in columns]
    return df.withColumns({c: F.when(F.col(c) != sentinel, F.col(c)) for c in chosen})


def prepare_stamped(df: DataFrame, stamp: str = "TIMESTAMP_START", site: str | None = None, sentinel: float = SENTINEL, drop: bool = True) -> DataFrame:
    """A site frame from raw columns: site_id, ts, values with the sentinel as null."""
    if stamp not in df.columns:
        raise SourceError(f"there is no stamp column {stamp!r}")
    out = df.withColumn("ts", parse_stamp(stamp)).withColumn("site_id", F.lit(site) if site else F.col("site_id"))
    raw = [c for c in ("TIMESTAMP_START", "TIMESTAMP_END") if c in out.columns]
    if (bad := out.where("ts is null").count()) > 0:
        raise SourceError(f"{stamp} lacks {bad} stamps")
    out = out.drop(*raw) if drop else out
    return replace_sentinel(out, sentinel, [c for c in out.columns if c not in raw])


def read_csv(spark: SparkSession, path: str, schema: str, stamp: str, pattern: str | None = None, na_values: Sequence[str] = ("", "NA", "NaN")) -> DataFrame:
    """CSV with its stamp read as text, so that 201801010030 is no number of seconds, and several spellings of missing."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    text = spark.read.option("header", True).schema(", ".join(f"{n} string" for n in names)).csv(path)
    kinds = {c.strip().split()[0]: c.strip().split()[1] for c in schema.split(",")}
    value = lambda n: F.when(~F.trim(n).isin(list(na_values)), F.trim(n)).cast(kinds[n])
    out = text.select(*[value(n).alias(n) if n != stamp else F.trim(n).alias(n) for n in names])
    return out.withColumn("ts", parse_stamp(stamp, pattern) if pattern else F.to_timestamp_ntz(stamp))


def read_stamped_csv(spark: SparkSession, path: str, schema: str, site: str, stamp: str = "TIMESTAMP_START") -> DataFrame:
    return prepare_stamped(spark.read.option("header", True).schema(schema).csv(path), stamp, site)


@dataclass(frozen=True)
class Availability:
    """Which drivers, fluxes and flags a header has, and under which names those that it lacks were looked for."""

    columns: Mapping[str, str]
    missing: tuple[str, ...]
    fluxes: Mapping[str, str]
    flags: Mapping[str, str]
    stamp: str | None = None

    @property
    def missing_fluxes(self) -> dict[str, str]:
        return {t: usual for t, usual in FLUX_NAMES.items() if t not in self.fluxes}

    @property
    def missing_flags(self) -> dict[str, str]:
        return {t: f"{self.fluxes.get(t, usual)}_QC" for t, usual in FLUX_NAMES.items() if t not in self.flags}

    def lacks(self, mode: str) -> tuple[str, ...]:
        """Drivers that a mode needs and the header has not."""
        return tuple(d for d in MODES[mode] if d not in self.columns)

    def supports(self, mode: str) -> bool:
        return not self.lacks(mode)

    def best_mode(self) -> str | None:
        return next((m for m in ("RFR10", "RFR3") if self.supports(m)), None)

    def column_map(self, mode: str | None = None, overrides: Mapping[str, str] | None = None) -> dict[str, str]:
        """Driver to column for a mode (the best one, if none is named)."""
        mode = mode or self.best_mode() or "RFR3"
        if lost := self.lacks(mode):
            raise SourceError(f"{mode} needs {', '.join(f'{d} ({STATION_NAMES[d]})' for d in lost)}")
        return {d: self.columns[d] for d in MODES[mode]} | dict(overrides or {})

    def target_columns(self, fluxes: Sequence[str] | None = None) -> tuple[str, ...]:
        """Columns of the fluxes, for validate(targets=...)."""
        wanted = tuple(self.fluxes if fluxes is None else fluxes)
        if lost := [t for t in wanted if t not in self.fluxes]:
            raise SourceError(f"there is no flux {', '.join(lost)}; there are {', '.join(self.fluxes) or 'none'}")
        return tuple(self.fluxes[t] for t in wanted)

    def flag_columns(self, fluxes: Sequence[str] | None = None) -> dict[str, str]:
        """Flux column to flag column, for validate(qc=...); a flux without flags is left out, and so counts as observed wherever it has a value."""
        names = tuple(self.fluxes if fluxes is None else fluxes)
        return {c: self.flags[t] for t, c in zip(names, self.target_columns(names)) if t in self.flags}

    def heat_targets(self) -> tuple[str, str] | None:
        """The columns of H and LE, for validate(energy_pair=...)."""
        return (self.fluxes["H"], self.fluxes["LE"]) if {"H", "LE"} <= set(self.fluxes) else None

    def require(self, mode: str, fluxes: Sequence[str] = (), need_flags: bool = True) -> Mapping[str, str]:
        """The column map of a mode, if that and these fluxes can be run; else all that is lacking at once.

        need_flags: a flux without its flags is lacking too, for values filled by others would pass as measured.
        """
        lost = [f"driver {d} ({STATION_NAMES[d]})" for d in self.lacks(mode)]
        lost += [f"flux {t} ({FLUX_NAMES.get(t, t)})" for t in fluxes if t not in self.fluxes]
        lost += [f"flags of {t} ({self.fluxes[t]}_QC)" for t in fluxes if need_flags and t in self.fluxes and t not in self.flags]
        if lost:
            raise SourceError(f"{mode} needs {', '.join(lost)}")
        return {d: self.columns[d] for d in MODES[mode]}

    def to_dict(self) -> dict:
        return {
            "drivers": dict(self.columns), "missing_drivers": {d: STATION_NAMES[d] for d in self.missing}, "fluxes": dict(self.fluxes), "missing_fluxes": self.missing_fluxes,
            "flags": dict(self.flags), "missing_flags": self.missing_flags, "stamp": self.stamp, "best_mode": self.best_mode(),
        }

    def summary(self) -> str:
        """What there is and what is lacking, in lines."""
        named = lambda m: ", ".join(f"{a} ({b})" for a, b in m.items()) or "none"
        found = self.to_dict()
        lines = [f"{len(self.columns)} of {len(DRIVERS)} drivers, best mode {self.best_mode() or 'none'}"]
        return "\n".join(lines + [f"{k.replace('_', ' ')}: {named(found[k])}" for k in ("drivers", "missing_drivers", "fluxes", "missing_fluxes", "flags", "missing_flags")])


def inspect(header: Sequence[str], overrides: Mapping[str, str] | None = None) -> Availability:
    """Find drivers, fluxes, flags and the stamp in a header; of depth-indexed columns X_1 .. X_10 the shallowest counts."""
    have, overrides = set(header), dict(overrides or {})
    if lost := [c for c in overrides.values() if c not in have]:
        raise SourceError(f"there are no columns {', '.join(lost)}")

    def find(name: str, usual: str) -> str | None:
        if name in overrides:
            return overrides[name]
        if usual in have:
            return usual
        return next((c for k in range(1, 11) if (c := f"{usual}_{k}") in have), None) if name in DEPTHS else None

    columns = {d: c for d in DRIVERS if (c := find(d, STATION_NAMES[d]))}
    fluxes = {t: c for t, usual in FLUX_NAMES.items() if (c := overrides.get(t) or (usual if usual in have else t if t in have else None))}
    flags = {t: f"{c}_QC" for t, c in fluxes.items() if f"{c}_QC" in have}
    stamp = next((c for c in ("TIMESTAMP_START", "TIMESTAMP_END", "TIMESTAMP") if c in have), None)
    return Availability(columns, tuple(d for d in DRIVERS if d not in columns), fluxes, flags, stamp)


def site_availability(df: DataFrame, columns: Mapping[str, str], least: int = 1) -> DataFrame:
    """What each site's own rows carry, in one scan: a header that all sites share says nothing of a site without values.

    columns: driver to column. site_id, n_rows, n_drivers (with at least `least` finite values), missing_drivers (in the
    order of DRIVERS, comma-joined), rows_RFR3 and rows_RFR10 (rows complete in the mode), best_mode (the widest mode all of
    whose drivers the site has; null if none).
    """
    if unknown := [d for d in columns if d not in DRIVERS]:
        raise SourceError(f"unknown drivers {', '.join(unknown)}")
    count = lambda d: F.count_if(finite(columns[d])) if d in columns else F.lit(0).cast("long")

    def complete(mode: str) -> Column:
        if any(d not in columns for d in MODES[mode]):
            return F.lit(0).cast("long")
        every = F.lit(True)
        for d in MODES[mode]:
            every = every & finite(columns[d])
        return F.count_if(every)

    counted = df.groupBy("site_id").agg(F.count("*").alias("n_rows"), *[count(d).alias(f"_{d}") for d in DRIVERS], *[complete(m).alias(f"rows_{m}") for m in MODES])
    lost = F.filter(F.array(*[F.when(F.col(f"_{d}") < least, F.lit(d)) for d in DRIVERS]), lambda d: d.isNotNull())
    best = F.lit(None).cast("string")
    for mode in ("RFR3", "RFR10"):  # the wider one has the last word
        best = F.when(~F.arrays_overlap(lost, F.array(*map(F.lit, MODES[mode]))), mode).otherwise(best)
    return counted.select("site_id", "n_rows", (len(DRIVERS) - F.size(lost)).cast("long").alias("n_drivers"), F.array_join(lost, ",").alias("missing_drivers"), *[f"rows_{m}" for m in MODES], best.alias("best_mode"))


def select_columns(df: DataFrame, columns: Mapping[str, str], keep: Sequence[str] = ("site_id", "ts")) -> DataFrame:
    """The canonical frame of a column map; unknown and missing names are refused."""
    if unknown := [d for d in columns if d not in DRIVERS]:
        raise SourceError(f"unknown drivers {', '.join(unknown)}")
    if lost := [c for c in columns.values() if c not in df.columns]:
        raise SourceError(f"there are no columns {', '.join(lost)}")
    return df.select(*keep, *[F.col(c).cast("double").alias(d) for d, c in columns.items()])


def qc_summary(df: DataFrame, qc: str, target: str, accepted: Sequence[int] = (0,), keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """n_rows, n_unflagged, n_measured, n_prefilled, n_missing_value per key; fractional flags are refused."""
    if dict(df.dtypes)[qc] in ("double", "float") and df.where(F.col(qc) != F.floor(qc)).limit(1).count():
        raise SourceError(f"{qc} has fractional flags")
    ok, there = F.coalesce(F.col(qc).isin(list(accepted)), F.lit(False)), finite(target)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(qc).isNull()).alias("n_unflagged"), F.count_if(ok & there).alias("n_measured"),
        F.count_if(~ok & there).alias("n_prefilled"), F.count_if(~there).alias("n_missing_value"),
    )


def flag_counts(df: DataFrame, qc: str, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    return df.where(F.col(qc).isNotNull()).groupBy(*keys, F.col(qc).cast("int").alias("flag")).agg(F.count("*").alias("n"))


def docx_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, text, tables (of rows of cells) of Word documents; paragraphs of a cell are set apart by a blank."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    @F.udf("struct<text:string,tables:array<array<array<string>>>>")
    def parse(content):
        try:
            with zipfile.ZipFile(BytesIO(content)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        words = lambda parts: " ".join(" ".join(parts).split())
        cell = lambda c: words("".join(t.text or "" for t in p.iter(f"{w}t")) for p in c.iter(f"{w}p"))
        return words(["".join(root.itertext())]), [[[cell(c) for c in row.findall(f"{w}tc")] for row in table.findall(f"{w}tr")] for table in root.iter(f"{w}tbl")]

    read = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), parse("content").alias("d"))
    whole = F.when(F.col("d").isNull(), F.raise_error(F.concat("file", F.lit(" is not a Word document")))).otherwise(F.col("d"))
    return read.select("file", whole.alias("d")).select("file", "d.*")


def docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, table_no, row_no, cells of the tables of Word documents; one row per table row."""
    tables = docx_documents(spark, path).select("file", F.posexplode("tables").alias("table_no", "rows"))
    return tables.select("file", "table_no", F.posexplode("rows").alias("row_no", "cells"))


def site_scores(rows: DataFrame, methods: Sequence[str], metrics: Sequence[str] = ("r2", "slope", "rmse", "bias")) -> DataFrame:
    """Tidy site scores from document tables: section rows carry the target, then a site and a block of metrics per method."""
    from pyspark.sql import Window

    order = Window.partitionBy("file", "table_no").orderBy("row_no")
    section = F.when(F.size(F.filter("cells", lambda c: c != "")) == 1, F.element_at("cells", 1))
    body = rows.withColumn("target", F.last(section, True).over(order)).where(section.isNull() & (F.col("row_no") > 0))
    blocks = F.array(*[F.struct(F.lit(m).alias("method"), *[F.expr(f"try_cast(translate(try_element_at(cells, {2 + k * len(metrics) + j}), '−', '-') as double)").alias(x) for j, x in enumerate(metrics)]) for k, m in enumerate(methods)])
    out = body.select(F.element_at("cells", 1).alias("site"), "target", F.explode(blocks).alias("b")).select("site", "target", "b.*")
    if (row := out.groupBy("site", "target", "method").count().where("count > 1").first()) is not None:
        raise SourceError(f"{row['site']} has {row['count']} rows of {row['target']}, {row['method']}")
    return out


def write_results(tables: Mapping[str, DataFrame], folder: str, manifest: Mapping | None = None, check: bool = True) -> None:
    """Each table as CSV in a folder of its own, and the manifest as JSON; existing ones are not overwritten.

    A manifest that lacks a part is refused before anything is written, unless check is off.
    """
    if manifest is not None and check:
        require_complete(manifest)
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")
    if manifest is not None:
        spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a folder of results, as data; anything else that stands there is refused."""
    try:
        found = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/manifest").collect()))
    except (ValueError, AnalysisException) as e:
        raise ProvenanceError(f"no manifest can be read from {folder}: {e}") from e
    if not isinstance(found, Mapping) or found.get("format") != MANIFEST_FORMAT:
        raise ProvenanceError(f"{folder} has no manifest of format {MANIFEST_FORMAT}")
    return dict(found)
