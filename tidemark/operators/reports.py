"""Reports over runs and sites: unions, medians, pivots, strata, differences between methods, tests, published values."""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError, ReportWarning
from ..functions import published, student
from ..functions.expressions import clean, finite, ratio
from ..functions.published import GAP_CLASSES, METHODS, METRICS, SUBSETS, TARGETS
from . import constraints

KEYS = ["target", "method", "mode", "gap_class", "subset"]
DIMENSIONAL = ("rmse", "bias")
POOLED = "all"

# Spellings of metadata headers of published site tables, folded to a-z, 0-9 and _, and the columns that they mean.
HEADERS = {
    "site_id": "site_id", "site": "site_id", "siteid": "site_id", "id": "site_id", "latitude": "latitude", "lat": "latitude", "location_lat": "latitude",
    "longitude": "longitude", "lon": "longitude", "long": "longitude", "location_long": "longitude", "koppen_climate": "koppen", "koppen_climate_class": "koppen",
    "start": "start_date", "end": "end_date", "location_elev": "elevation", "system": "instrument_system", "instrument_to_canopy_height_ratio": "height_ratio",
    "included_in_94_sites": "included_in_94_site_subset",
}
# Codes of the land cover classes.
IGBP = ("CRO", "CSH", "CVM", "DBF", "DNF", "EBF", "ENF", "GRA", "MF", "OSH", "SAV", "URB", "WAT", "WET", "WSA", "BSV", "SNO")


def rank_of(column: str | Column, order: Sequence[str]) -> Column:
    """Position in a reporting order; what is not in it comes after."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        out = F.when(c == name, F.lit(k)).otherwise(out)
    return out


def in_reporting_order(df: DataFrame) -> DataFrame:
    ranks = [rank_of(c, o) for c, o in (("target", TARGETS), ("method", METHODS), ("gap_class", GAP_CLASSES), ("subset", SUBSETS), ("metric", METRICS)) if c in df.columns]
    first = [F.when(F.col("stratum") == POOLED, 0).otherwise(1), F.coalesce("stratum", F.lit(""))] if "stratum" in df.columns else []
    return df.orderBy(*ranks, *first, *[F.coalesce(F.col(c), F.lit("")) for c in ("site", "mode", "units") if c in df.columns])


def long_by_metric(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric, with its value."""
    return df.unpivot([c for c in df.columns if c not in metrics], list(metrics), "metric", "value")


def _refuse_repeats(df: DataFrame, keys: Sequence[str], what: str) -> None:
    if (row := df.groupBy(*keys).count().where("count > 1").first()) is not None:
        raise ReportError(f"{what}: the cell {', '.join(str(row[k]) for k in keys)} occurs {row['count']} times")


def gap_length_table(reports: Mapping[str, DataFrame] | DataFrame, units: Mapping[str, str] | None = None) -> DataFrame:
    """The reports of many sites as one table: site from the key, missing columns null, units by target where not stated.

    Reports of many sites that are one frame already, with a column site, pass as that frame: it is read once.
    """
    units = {"NEE": published.MODEL_UNITS, "H": published.HEAT_UNITS, "LE": published.HEAT_UNITS} | dict(units or {})
    if isinstance(reports, DataFrame):
        out = reports
    else:
        parts = [df.withColumn("site", F.lit(site)) for site, df in reports.items()]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = F.lit(None).cast("string")
    for target, unit in units.items():
        known = F.when(F.col("target") == target, F.lit(unit)).otherwise(known)
    own = F.col("units") if "units" in out.columns else F.lit(None).cast("string")
    return out.withColumn("units", F.coalesce(own, known))


def median_across_sites(table: DataFrame, check: bool = True) -> DataFrame:
    """Median of each metric over sites, with the number of sites and summed counts; null keys are kept as keys."""
    if check:
        if table.where("site is null").limit(1).count():
            raise ReportError("rows without a site cannot enter a median across sites")
        _refuse_repeats(table, ["site", *KEYS, "units"], "median across sites")
    return table.groupBy(*KEYS, "units").agg(
        F.count_distinct("site").alias("n_sites"), F.sum("n").alias("n"), F.sum("n_offered").alias("n_offered"), *[F.median(clean(m)).alias(m) for m in METRICS]
    )


def gap_length_pivot(table: DataFrame, metric: str = "r2", subset: str = "all", gap_classes: Sequence[str] = GAP_CLASSES[1:], targets: Sequence[str] = TARGETS, methods: Sequence[str] = METHODS, check: bool = True) -> DataFrame:
    """target, gap_class and a column of the metric per method."""
    rows = table.where((F.col("subset") == subset) & F.col("gap_class").isin(list(gap_classes)) & F.col("target").isin(list(targets)))
    if check:
        _refuse_repeats(rows, ["target", "gap_class", "method"], "pivot by gap length")
    return rows.groupBy("target", "gap_class").pivot("method", list(methods)).agg(F.first(metric))


def bias_iqr(table: DataFrame, stratum: str | None = None) -> DataFrame:
    """Quartiles of the bias over sites, pooled ('all') and per stratum; the range needs two defined values."""
    key = ["target", "method", "mode", "gap_class", "subset", "units"]
    spread = table.withColumn("igbp", F.explode(_strata(stratum)))
    out = spread.groupBy(*key, "igbp").agg(
        F.count(clean("bias")).alias("n_sites"), F.count_distinct("site").alias("n_sites_offered"),
        *[F.percentile(clean("bias"), q).alias(n) for q, n in ((0.25, "bias_q1"), (0.5, "bias_median"), (0.75, "bias_q3"))],
    )
    return out.withColumn("bias_iqr", F.when(F.col("n_sites") > 1, F.col("bias_q3") - F.col("bias_q1")))


def _strata(stratum: str | None) -> Column:
    """Memberships of a row: pooled, and its stratum if it has one."""
    own = F.lit(None).cast("string") if stratum is None else F.nullif(F.trim(F.col(stratum)), F.lit(""))
    own = F.when(own == POOLED, F.raise_error(F.lit(f"a stratum is named {POOLED!r}, which is the pool of all"))).otherwise(own)
    return F.filter(F.array(F.lit(POOLED), own), lambda s: s.isNotNull())


def fold_header(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    folded = "_".join("".join(c if c.isalnum() else " " for c in plain).split())
    return HEADERS.get(folded, folded)


#: Metadata columns with what they may hold.
NUMBERS = {"latitude": (-90, 90), "longitude": (-180, 180), "elevation": None, "height_ratio": None}
TEXTS = ("continent", "country", "koppen")
DATES = ("start_date", "end_date")
MEMBER = "included_in_94_site_subset"
# Codes of open-path, closed-path and mixed instrument systems.
SYSTEMS = ("O", "C", "M")
CANONICAL = ("site_id", *NUMBERS, *TEXTS, "igbp", "instrument_system", *DATES, MEMBER)


def fold_headers(raw: DataFrame) -> DataFrame:
    """raw under canonical headers; two columns for one field are refused, absent fields are null, others come last."""
    found: dict[str, str] = {}
    for c in raw.columns:
        name = fold_header(c)
        if name in CANONICAL and name in found:
            raise ReportError(f"columns {found[name]!r} and {c!r} both describe {name}; keep one")
        found.setdefault(name, c)
    if "site_id" not in found:
        raise ReportError(f"the metadata has no site column; it has {', '.join(raw.columns) or 'none'}")
    named = raw.toDF(*[fold_header(c) for c in raw.columns])
    return named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in CANONICAL], *[c for c in named.columns if c not in CANONICAL])


def _parsed(field: str) -> Column:
    """A metadata field in its type; null where the text is no such value."""
    c = F.trim(F.col(field).cast("string"))
    if field in NUMBERS:
        return F.expr(f"try_cast(translate(trim(cast({field} as string)), '−', '-') as double)")
    if field in DATES:
        return F.expr(f"cast(coalesce(try_to_date(cast({field} as string), 'yyyy-MM-dd'), try_to_date(cast({field} as string), 'yyyy'), try_to_date(substr(cast({field} as string), 1, 10), 'yyyy-MM-dd')) as timestamp_ntz)")
    if field == MEMBER:
        return F.when(F.lower(c).isin("✓", "true", "yes", "1"), True).when(F.lower(c).isin("×", "x", "false", "no", "0"), False)
    c = F.nullif(c, F.lit(""))
    return F.upper(c) if field in ("igbp", "instrument_system") else c


def metadata_rules() -> list[constraints.Rule]:
    """What a row of folded metadata must meet, field by field."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    rules = [constraints.Rule("missing", "site_id", text("site_id").isNull(), F.lit(None))]
    for c, bounds in NUMBERS.items():
        rules.append(constraints.Rule("unreadable", c, text(c).isNotNull() & _parsed(c).isNull(), F.col(c)))
        if bounds:
            rules.append(constraints.Rule("out of range", c, ~_parsed(c).between(*bounds), F.col(c)))
    rules += [constraints.Rule("unreadable", c, text(c).isNotNull() & _parsed(c).isNull(), F.col(c)) for c in (*DATES, MEMBER)]
    rules += [constraints.Rule("unknown code", c, text(c).isNotNull() & ~_parsed(c).isin(list(known)), F.col(c)) for c, known in (("igbp", IGBP), ("instrument_system", SYSTEMS))]
    return [*rules, constraints.Rule("before start_date", "end_date", _parsed("end_date") < _parsed("start_date"), F.col("end_date"))]


def site_violations(raw: DataFrame) -> DataFrame:
    """site_id, rule, field, value of every breach in raw metadata, repeated sites among them."""
    folded = fold_headers(raw).withColumn("site_id", F.nullif(F.trim(F.col("site_id").cast("string")), F.lit("")))
    return constraints.violations(folded, "site_id", metadata_rules()).withColumnRenamed("key", "site_id")


def site_metadata(raw: DataFrame) -> DataFrame:
    """Metadata with canonical headers and types, every field there is; other columns come last.

    Values are read, not guessed: anything that breaks a rule of metadata_rules(), and a site in several rows, is refused
    with its first sites. Applied again, the table stays as it is.
    """
    folded = fold_headers(raw)
    if bad := constraints.describe(site_violations(raw), "site_id"):
        raise ReportError("site metadata: " + "; ".join(bad))
    made = {c: _parsed(c) for c in CANONICAL if c != "site_id"}
    return folded.withColumns(made).withColumn("site_id", F.trim(F.col("site_id").cast("string")))


def population_summary(metadata: DataFrame, by: str) -> DataFrame:
    """stratum, n_sites, fraction; sites without a stratum are a row of their own."""
    total = metadata.select(F.count("*").alias("total"))
    out = metadata.groupBy(F.col(by).alias("stratum")).agg(F.count("*").alias("n_sites")).crossJoin(F.broadcast(total))
    return out.select("stratum", "n_sites", ratio(F.col("n_sites"), F.col("total")).alias("fraction"))


def site_report(results: DataFrame, metadata: DataFrame, warn: bool = True) -> DataFrame:
    """Results with the metadata of their site; sites without any stay."""
    meta = metadata.withColumnRenamed("site_id", "site")
    if (again := meta.groupBy("site").count().where("count > 1").first()) is not None:
        raise ReportError(f"site {again['site']} has {again['count']} rows of metadata, which would multiply its results")
    if warn:
        lost = [r["site"] for r in results.select("site").distinct().join(meta, "site", "left_anti").limit(5).collect()]
        if lost:
            warnings.warn(f"no metadata for {', '.join(map(str, lost))}", ReportWarning, stacklevel=2)
    return results.join(meta, "site", "left")


def stratified_summary(report: DataFrame, by: str | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Quartiles over sites of each metric, pooled and per stratum."""
    spread = report.withColumn("stratum", F.explode(_strata(by)))
    spread = spread.select("site", *KEYS, "units", "stratum", *metrics).unpivot(["site", *KEYS, "units", "stratum"], list(metrics), "metric", "value")
    out = spread.groupBy(*KEYS, "units", "stratum", "metric").agg(
        F.count(clean("value")).alias("n_sites"), F.count_distinct("site").alias("n_sites_offered"),
        *[F.percentile(clean("value"), q).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))],
    )
    return out.withColumn("iqr", F.when(F.col("n_sites") > 1, F.col("q3") - F.col("q1")))


def change(metric: Column, new: Column, old: Column) -> Column:
    """improved, worsened or unchanged: R2 upwards, slope towards 1, RMSE downwards, bias towards 0."""
    far = lambda x: F.when(metric == "r2", -x).when(metric == "slope", F.abs(x - 1)).when(metric == "rmse", x).otherwise(F.abs(x))
    a, b = far(new), far(old)
    return F.when(a < b, "improved").when(a > b, "worsened").when(a == b, "unchanged")


def method_differences(report: DataFrame, method: str, baseline: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Both methods side by side per site and cell, with the difference and its direction; a cell of one alone stays."""
    keys = ["site", "target", "gap_class", "subset", "units"]
    arm = lambda name, value: long_by_metric(report.where(F.col("method") == name).select(*keys, *metrics), metrics).withColumnRenamed("value", value)
    a, b = arm(method, "method_value").alias("a"), arm(baseline, "baseline_value").alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "metric"]])
    out = a.join(b, same, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in [*keys, "metric"]], "method_value", "baseline_value")
    new, old = clean("method_value"), clean("baseline_value")
    return out.withColumns({"method": F.lit(method), "baseline": F.lit(baseline), "difference": new - old, "change": change(F.col("metric"), new, old)})


def welch_statistics(differences: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, means, Welch's t and degrees of freedom of each cell; no test of fewer than two values or without spread."""
    keys = ["target", "gap_class", "subset", "stratum", "units", "metric"]
    spread = differences.withColumn("stratum", F.explode(_strata(by)))
    new, old = clean("method_value"), clean("baseline_value")
    aggregates = {
        "n_method": F.count(new), "n_baseline": F.count(old), "mean_method": F.avg(new), "mean_baseline": F.avg(old), "_vm": F.var_samp(new), "_vb": F.var_samp(old),
        "_rm": F.max(new) - F.min(new), "_rb": F.max(old) - F.min(old), "n_paired": F.count_if(finite("method_value") & finite("baseline_value")),
        **{f"n_{k}": F.count_if(F.col("change") == k) for k in ("improved", "worsened", "unchanged")},
    }
    out = spread.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    test = (F.col("n_method") >= 2) & (F.col("n_baseline") >= 2) & ((F.col("_rm") > 0) | (F.col("_rb") > 0))
    sm, sb = F.col("_vm") / F.col("n_method"), F.col("_vb") / F.col("n_baseline")
    v = sm + sb
    out = out.withColumn("mean_difference", F.col("mean_method") - F.col("mean_baseline"))
    return out.withColumns({
        "df": F.when(test, F.try_divide(v * v, sm * sm / (F.col("n_method") - 1) + sb * sb / (F.col("n_baseline") - 1))),
        "standard_error": F.when(test, F.sqrt(v)), "t_statistic": F.when(test, F.try_divide(F.col("mean_difference"), F.sqrt(v))),
    }).drop("_vm", "_vb", "_rm", "_rb")


def welch_comparison(report: DataFrame, method: str, baseline: str, metrics: Sequence[str] = METRICS, by: str | None = None, confidence: float = 0.95) -> DataFrame:
    """welch_statistics with interval, p-value and significance."""
    if not 0 < confidence < 1:
        raise ReportError(f"confidence must be between 0 and 1, got {confidence}")
    differences = method_differences(report, method, baseline, metrics)
    if by is not None:
        differences = differences.join(report.groupBy("site").agg(F.first(by).alias(by)), "site", "left")
    out = welch_statistics(differences, by)
    half = student.critical(F.lit(0.5 + confidence / 2), F.col("df")) * F.col("standard_error")
    out = out.withColumns({"_half": half, "p_value": student.p_value(F.col("t_statistic"), F.col("df")), "confidence": F.lit(confidence), "method": F.lit(method), "baseline": F.lit(baseline)})
    return out.withColumns({"ci_lower": F.col("mean_difference") - F.col("_half"), "ci_upper": F.col("mean_difference") + F.col("_half"), "significant": F.col("p_value") < 1 - confidence}).drop("_half")


def compare_with_published(table: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """A run's cells beside the published medians, a row per metric; other units are reported, not subtracted."""
    keys = ["target", "method", "gap_class", "subset"]
    pub = long_by_metric(published.medians_table(table.sparkSession), METRICS).withColumnsRenamed({"value": "published", "units": "published_units"})
    run = long_by_metric(table.select(*keys, "units", *METRICS), METRICS).withColumnsRenamed({"value": "run", "units": "run_units"})
    out = run.join(F.broadcast(pub), [*keys, "metric"]).where(F.col("metric").isin(list(metrics)))
    scaled = F.col("metric").isin(list(DIMENSIONAL))
    out = out.withColumns({c: F.when(scaled, F.col(c)).otherwise(F.lit("1")) for c in ("run_units", "published_units")})
    same = F.col("run_units").eqNullSafe(F.col("published_units"))
    note = F.when(~same, F.lit("units differ")).when(F.col("published").isNull(), "not published").when(clean("run").isNull(), "undefined in the run")
    return out.select(*keys, "metric", clean("run").alias("run"), "published", F.when(same, clean("run") - F.col("published")).alias("difference"), "run_units", "published_units", same.alias("comparable"), note.alias("note"))


def to_carbon_units(table: DataFrame, target: str = "NEE", factor: float = published.CARBON_FACTOR, check: bool = True) -> DataFrame:
    """RMSE and bias of the target in carbon units; rows that are in them stay, unknown units are refused."""
    mine = F.col("target") == target
    if check and table.where(mine & ~F.coalesce(F.col("units").isin(published.MODEL_UNITS, published.CARBON_UNITS), F.lit(False))).limit(1).count():
        raise ReportError(f"{target} has rows in units that cannot be converted")
    convert = mine & (F.col("units") == published.MODEL_UNITS)
    scaled = {m: F.when(convert, F.col(m) * factor).otherwise(F.col(m)) for m in DIMENSIONAL}
    return table.withColumns(scaled).withColumn("units", F.when(convert, F.lit(published.CARBON_UNITS)).otherwise(F.col("units")))


def compare_with_published_welch(welch: DataFrame) -> DataFrame:
    """Pooled tests beside the published ones; other units are reported, not subtracted."""
    keys = ["target", "metric", "method", "baseline"]
    pooled = welch.where((F.col("gap_class") == "all") & (F.col("subset") == "all") & (F.col("stratum") == POOLED))
    pub = published.welch_table(welch.sparkSession).withColumnsRenamed({"mean_difference": "published_difference", "significant": "published_significant", "ci_lower": "published_ci_lower", "ci_upper": "published_ci_upper"})
    out = pooled.join(F.broadcast(pub), keys)
    scaled = F.col("metric").isin(list(DIMENSIONAL))
    wanted = F.when(F.col("target") == "NEE", F.lit(published.CARBON_UNITS)).otherwise(F.lit(published.HEAT_UNITS))
    same = ~scaled | F.col("units").eqNullSafe(wanted)
    return out.select(
        *keys, F.col("mean_difference").alias("run_difference"), "published_difference",
        F.when(same, F.col("mean_difference") - F.col("published_difference")).alias("difference"), same.alias("comparable"),
        *(["significant", "published_significant", (F.col("significant") == F.col("published_significant")).alias("significance_agrees")] if "significant" in welch.columns else []),
    )


def site_level_evidence(evidence: DataFrame) -> DataFrame:
    """The widest population behind each target and method, and the tables that have it."""
    return evidence.groupBy("target", "method").agg(F.max("n_sites").alias("n_sites"), F.array_join(F.array_sort(F.collect_set("table_name")), ", ").alias("tables"))
