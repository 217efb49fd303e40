"""Published tables of sites, read from Word documents: metadata, and scores of methods site by site.

All readers take one document or many (a folder, a pattern). A row of a table is a row of Spark from the start; checks of
the layout are rules on those rows, looked at in one scan, and name what breaks them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.published import CARBON_UNITS, HEAT_UNITS, METHODS, METRICS, MODEL_UNITS, TARGETS
from ..operators import constraints, reports
from .tables import docx_documents


@dataclass(frozen=True)
class ScoreLayout:
    """A published table of scores: a row that names the methods, one that names the metrics under each, then a row a site."""

    name: str
    population: str
    subset: str = "all"
    targets: tuple[str, ...] = TARGETS
    methods: tuple[str, ...] = METHODS
    nee_units: str = CARBON_UNITS

    def units(self, nee_units: str | None = None) -> Mapping[str, str]:
        return {t: (nee_units or self.nee_units) if t == "NEE" else HEAT_UNITS for t in self.targets}


# The published tables of scores site by site, and the populations they cover.
OF_94, OF_194 = "94-site subset", "194-site set"
S4 = ScoreLayout("Table S4", OF_94)
S5 = ScoreLayout("Table S5", OF_94, "daytime")
S6 = ScoreLayout("Table S6", OF_94, "nighttime")
S9 = ScoreLayout("Table S9", OF_194, "all", ("NEE",), ("MDS", "RFR3"), MODEL_UNITS)

SCORE_COLUMNS = ("site", "target", "method", "mode", "gap_class", "subset", "n", "n_offered", *METRICS, "units", "site_population", "source")
_BODY = 2  # the first row of a table that is no header


def _cell(k: int) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit(""))


def _number(cell: Column) -> Column:
    """A printed number, whose minus may be a typographic one; null where the cell is empty or no number."""
    return F.translate(F.trim(cell), "−", "-").try_cast("double")


def _filled() -> Column:
    return F.filter("cells", lambda c: c != "")


def read_score_cells(rows: DataFrame, layout: ScoreLayout, nee_units: str | None = None) -> DataFrame:
    """Tidy scores (SCORE_COLUMNS) from file, table_no, row_no, cells of tables that all have this layout.

    A row that holds nothing but a target's name opens that target's block; a layout of one target needs none. Row 0
    must name the layout's methods and row 1 the four metrics under each. Refused, with the first rows concerned: other
    headers, a site before any target, a row of another width, a cell that is no number, a site scored twice. Rows of
    empty cells are passed over, an empty cell is a null score. Counts of rows are not published: n and n_offered are null.
    """
    width = 1 + len(METRICS) * len(layout.methods)
    names = F.concat_ws(", ", _filled())
    metrics = F.lower(F.concat_ws(", ", F.filter(F.slice("cells", 2, 100_000), lambda c: c != "")))
    section = F.when((F.size(_filled()) == 1) & _filled()[0].isin(list(layout.targets)), _filled()[0])
    in_order = Window.partitionBy("file", "table_no").orderBy("row_no")  # a table came out of one document, so it is small
    open_target = F.last(section, True).over(in_order)
    body = (F.col("row_no") >= _BODY) & (F.size(_filled()) > 0) & section.isNull()
    marked = rows.select(
        "file", "table_no", "row_no", "cells", body.alias("is_site"), F.coalesce(open_target, F.lit(layout.targets[0] if len(layout.targets) == 1 else None).cast("string")).alias("target"),
        F.format_string("%s, table %d, row %d", F.element_at(F.split("file", "/"), -1), F.col("table_no"), F.col("row_no")).alias("place"),
    )
    site = F.col("is_site")
    scores = F.slice("cells", 2, width - 1)
    no_number = F.exists(scores, lambda c: (F.trim(c) != "") & _number(c).isNull())
    rules = [
        constraints.Rule(f"must name {', '.join(layout.methods)}", "methods", (F.col("row_no") == 0) & (names != ", ".join(layout.methods)), names),
        constraints.Rule(f"must be {', '.join(METRICS)} under each method", "metrics", (F.col("row_no") == 1) & (metrics != ", ".join(METRICS * len(layout.methods))), metrics),
        constraints.Rule("before any target", "site", site & F.col("target").isNull(), _cell(1)),
        constraints.Rule(f"is not of {width} cells", "row", site & (F.size("cells") != width), F.size("cells").cast("string")),
        constraints.Rule("is no number", "score", site & no_number, F.concat_ws(", ", scores)),
    ]
    broken = constraints.violations(marked, "place", rules, unique=False)
    at = lambda m, k: _number(_cell(2 + m * len(METRICS) + k))
    blocks = F.array(*[F.struct(F.lit(m).alias("method"), *[at(i, k).alias(x) for k, x in enumerate(METRICS)]) for i, m in enumerate(layout.methods)])
    sites = marked.where("is_site").select("file", "table_no", _cell(1).alias("site"), "target", blocks.alias("blocks"))
    again = sites.groupBy("file", "table_no", "site", "target").agg(F.count("*").alias("n")).where("n > 1")
    again = again.select(F.concat_ws(" ", "site", "target").alias("key"), F.lit("scored twice").alias("rule"), F.lit("site").alias("field"), F.col("n").cast("string").alias("value"))
    if found := constraints.describe(broken.unionByName(again)):
        raise SourceError(f"{layout.name}: " + "; ".join(found))
    units = F.lit(None).cast("string")
    for target, unit in layout.units(nee_units).items():
        units = F.when(F.col("target") == target, unit).otherwise(units)
    out = sites.select("site", "target", F.explode("blocks").alias("b")).select("site", "target", "b.*")
    none = F.lit(None).cast("long")
    return out.withColumns({
        "mode": F.when(F.col("method").startswith("RFR"), F.col("method")), "gap_class": F.lit(reports.POOLED), "subset": F.lit(layout.subset), "n": none, "n_offered": none,
        "units": units, "site_population": F.lit(layout.population), "source": F.lit(layout.name),
    }).select(*SCORE_COLUMNS)


def _documents(spark: SparkSession, path: str, captions: Sequence[str], tables: int | None) -> DataFrame:
    """The documents, if each has these captions, in this order, and this many tables."""
    docs = docx_documents(spark, path)
    places = [F.instr("text", c) for c in captions]
    lost = F.lit(False)
    for place in places:
        lost = lost | (place == 0)
    for a, b in zip(places, places[1:]):
        lost = lost | (a >= b)
    if tables is not None:
        lost = lost | (F.size("tables") != tables)
    if (bad := docs.where(lost).select("file", F.size("tables").alias("n")).first()) is not None:
        raise SourceError(f"{bad['file']} does not have {', then '.join(captions)}" + ("" if tables is None else f" and {tables} table(s); it has {bad['n']}"))
    return docs


def _rows(docs: DataFrame) -> DataFrame:
    whole = docs.select("file", F.posexplode("tables").alias("table_no", "rows"))
    return whole.select("file", "table_no", F.posexplode("rows").alias("row_no", "cells"))


def read_diel_scores(spark: SparkSession, path: str, nee_units: str | None = None) -> DataFrame:
    """The three tables of scores of a document (all day, daytime, nighttime), one tidy table.

    The document states no units; nee_units labels those of NEE, carbon per day unless stated.
    """
    rows = _rows(_documents(spark, path, ["Table S4", "Table S5", "Table S6"], 3))
    parts = [read_score_cells(rows.where(F.col("table_no") == k), layout, nee_units) for k, layout in enumerate((S4, S5, S6))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_nee_scores(spark: SparkSession, path: str, nee_units: str | None = None) -> DataFrame:
    """The table of NEE scores at the widest set of sites; its caption gives the model's units."""
    return read_score_cells(_rows(_documents(spark, path, ["Table S9"], 1)), S9, nee_units)


def site_cells(rows: DataFrame) -> DataFrame:
    """Site metadata from file, table_no, row_no, cells: of each document the first table whose header has Latitude and IGBP.

    An empty first header stands over the site codes. Documents may order their columns differently. Refused: a document
    without such a table, a row of another width than its header, and all that site_metadata() refuses.
    """
    first = rows.where(F.col("row_no") == 0).withColumn("is_site", F.array_contains("cells", "Latitude") & F.array_contains("cells", "IGBP"))
    chosen = first.groupBy("file").agg(F.min(F.when(F.col("is_site"), F.struct("table_no", F.col("cells").alias("header")))).alias("t"))
    if (bad := chosen.where("t is null").first()) is not None:
        raise SourceError(f"{bad['file']} has no table with the headers Latitude and IGBP")
    chosen = chosen.select("file", "t.*").withColumn("header", F.when(F.element_at("header", 1) == "", F.concat(F.array(F.lit("site_id")), F.slice("header", 2, 100_000))).otherwise(F.col("header")))
    body = rows.where(F.col("row_no") > 0).join(F.broadcast(chosen), ["file", "table_no"])  # a row a document
    uneven = body.where(F.size("cells") != F.size("header")).agg(F.count("*").alias("n"), F.min(F.struct("file", "row_no")).alias("at")).first()
    if uneven["n"]:
        raise SourceError(f"{uneven['n']} rows are not as wide as their header, such as row {uneven['at']['row_no']} of {uneven['at']['file']}")
    names = [r[0] for r in chosen.select(F.explode("header")).distinct().orderBy("col").collect()]  # headers of one kind of table
    pairs = body.select(F.map_from_arrays("header", "cells").alias("m"))
    return reports.site_metadata(pairs.select(*[F.try_element_at("m", F.lit(n)).alias(n) for n in names]))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site metadata of the documents of the published site table."""
    return site_cells(_rows(_documents(spark, path, ["Table S2"], None)))
