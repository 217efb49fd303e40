"""Queries over what sources bring: tables of documents, availability of drivers by site, spellings of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spellings
from ..functions.published import METHODS, METRICS, TARGETS
from ..sources import site_tables, tables
from .frames import show, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_STEP = 1_000_000  # rows of a document between the headings of two targets


def _printed_scores(spark, sf_dir):
    """Suppliers as sites of printed score tables, a document a nation: two header rows, then a block of sites under each target; some cells are empty, minus is typographic."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("file"), F.lit(0).alias("table_no"), "s_suppkey", "s_name")
    files = s.select("file", "table_no").distinct()
    text = lambda values: F.array(*[F.lit(v) for v in values])
    methods = text(["", *[c for m in METHODS for c in (m, *[""] * (len(METRICS) - 1))]])
    heads = [(0, methods), (1, text(["Site", *["R2", "Slope", "RMSE", "Bias"] * len(METHODS)]))]
    heads += [(_STEP * (k + 1), text([t, *[""] * (len(METRICS) * len(METHODS))])) for k, t in enumerate(TARGETS)]
    out = files.select("*", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("row_no"), c.alias("cells")) for n, c in heads])).alias("r")).select("file", "table_no", "r.*")
    k = F.col("s_suppkey")
    for t in range(len(TARGETS)):
        number = lambda j: F.translate((((k * (j + 3) + t * 17) % 2000 - 1000).cast("decimal(10,2)") / 100).cast("decimal(10,2)").cast("string"), "-", "−")  # noqa: E731, B023
        cells = [F.when(k % 9 == j, "").otherwise(number(j)) for j in range(len(METRICS) * len(METHODS))]
        out = out.unionByName(s.select("file", "table_no", (k + 1 + _STEP * (t + 1)).alias("row_no"), F.array("s_name", *cells).alias("cells")))
    return out


@query("q_published_scores", """WITH b AS (SELECT s_name AS site, s_suppkey AS k, t, m FROM supplier, range(3) a(t), range(3) c(m)),
v AS (SELECT *, list_transform(range(4), lambda i: CASE WHEN k % 9 <> m * 4 + i THEN ((k * (m * 4 + i + 3) + t * 17) % 2000 - 1000) / 100.0::DOUBLE END) AS x FROM b)
SELECT site, ['NEE', 'H', 'LE'][t + 1] AS target, ['MDS', 'RFR3', 'RFR10'][m + 1] AS method, [NULL, 'RFR3', 'RFR10'][m + 1] AS mode, 'all' AS gap_class, 'daytime' AS subset, NULL::BIGINT AS n, NULL::BIGINT AS n_offered,
    x[1] AS r2, x[2] AS slope, x[3] AS rmse, x[4] AS bias, CASE t WHEN 0 THEN 'g C m-2 d-1' ELSE 'W m-2' END AS units, '94-site subset' AS site_population, 'Table S5' AS source FROM v""")
def published_scores(spark, sf_dir):
    return show(site_tables.read_score_cells(_printed_scores(spark, sf_dir), site_tables.S5))


def _printed_sites(spark, sf_dir):
    """Suppliers as rows of printed site tables, a document a nation; every other document has its columns in another order and a table before."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    odd = F.col("s_nationkey") % 2 == 1
    both = lambda a, b: F.when(odd, F.array(*[a[i] for i in b])).otherwise(F.array(*a))
    order = [0, 3, 2, 1, 4]
    head = both([F.lit(c) for c in ("", "Latitude", "Longitude (°)", "IGBP", "Included in 94 sites")], order)
    igbp = F.element_at(F.array(*map(F.lit, ("Wet", "CRO", "ENF", ""))), (k % 4 + 1).cast("int"))
    row = both([F.col("s_name"), F.translate((k % 180 - 90).cast("string"), "-", "−"), (k % 360 - 180).cast("string"), igbp, F.when(k % 2 == 0, "✓").otherwise("×")], order)
    s = s.withColumns({"file": F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), "table_no": F.when(odd, 1).otherwise(0), "head": head, "row": row})
    files = s.select("file", "table_no", "head").distinct()
    out = s.select("file", "table_no", (k + 1).alias("row_no"), F.col("row").alias("cells")).unionByName(files.select("file", "table_no", F.lit(0).cast("long").alias("row_no"), F.col("head").alias("cells")))
    return out.unionByName(files.where("table_no = 1").select("file", F.lit(0).alias("table_no"), F.lit(0).cast("long").alias("row_no"), F.array(F.lit("Latitude"), F.lit("notes")).alias("cells")))


@query("q_published_sites", """SELECT s_name AS site_id, (s_suppkey % 180 - 90)::DOUBLE AS latitude, ['WET', 'CRO', 'ENF', NULL][s_suppkey % 4 + 1] AS igbp, s_suppkey % 2 = 0 AS included_in_94_site_subset,
    (s_suppkey % 360 - 180)::DOUBLE AS longitude FROM supplier""")
def published_sites(spark, sf_dir):
    return show(site_tables.site_cells(_printed_sites(spark, sf_dir)).select("site_id", "latitude", "longitude", "igbp", "included_in_94_site_subset"))


#: Drivers of order lines: those of some suppliers lack one or several.
_CARRIED = {
    "shortwave": "l_quantity", "vapour_pressure_deficit": "vpd", "air_temperature": "temperature", "net_radiation": "l_extendedprice", "wind_speed": "l_tax", "wind_direction": "l_discount",
    "ground_heat_flux": "flux", "soil_temperature": "l_tax", "relative_humidity": "l_discount", "soil_water": "l_quantity",
}


@query("q_site_availability", """WITH l AS (
    SELECT l_suppkey::VARCHAR AS site_id, l_suppkey % 5 = 0 OR l_linenumber = 2 AS no_vpd, l_suppkey % 7 = 0 OR l_quantity > 40 AS no_t, l_suppkey % 2 = 0 AS no_g FROM lineitem),
c AS (SELECT site_id, count(*) AS n_rows, bool_and(no_vpd) AS v, bool_and(no_t) AS t, bool_and(no_g) AS g, count(*) FILTER (NOT no_vpd AND NOT no_t) AS rows_RFR3, count(*) FILTER (NOT no_vpd AND NOT no_t AND NOT no_g) AS rows_RFR10 FROM l GROUP BY 1)
SELECT site_id, n_rows, 10 - v::BIGINT - t::BIGINT - g::BIGINT AS n_drivers, concat_ws(',', CASE WHEN v THEN 'vapour_pressure_deficit' END, CASE WHEN t THEN 'air_temperature' END, CASE WHEN g THEN 'ground_heat_flux' END) AS missing_drivers,
    rows_RFR3 AS "rows_RFR3", rows_RFR10 AS "rows_RFR10", CASE WHEN v OR t THEN NULL WHEN g THEN 'RFR3' ELSE 'RFR10' END AS best_mode FROM c""")
def site_availability(spark, sf_dir):
    k = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "site_id": k.cast("string"), "vpd": F.when(~((k % 5 == 0) | (F.col("l_linenumber") == 2)), F.col("l_tax")), "temperature": F.when(F.col("l_quantity") > 40, float("nan")).when(k % 7 != 0, F.col("l_tax")),
        "flux": F.when(k % 2 == 0, float("inf")).otherwise(F.col("l_tax")),
    })
    return tables.site_availability(rows, _CARRIED)


@query("q_spelled_gap_classes", """WITH l AS (SELECT ['24h', ' Very-Long', 'LONG', '30d', 'very long', 'week', 'Short '][(l_orderkey % 7)::INT + 1] AS label, l_linenumber = 5 AS none FROM lineitem)
SELECT CASE WHEN NOT none THEN CASE label WHEN '24h' THEN 'short' WHEN 'Short ' THEN 'short' WHEN 'LONG' THEN 'long' WHEN 'week' THEN NULL ELSE 'very_long' END END AS gap_class, count(*) AS n, count(*) FILTER (NOT none) AS n_labelled FROM l GROUP BY 1""")
def spelled_gap_classes(spark, sf_dir):
    """Labels of several sources as gap classes; those that are none are counted, not guessed."""
    labels = F.array(*map(F.lit, ("24h", " Very-Long", "LONG", "30d", "very long", "week", "Short ")))
    label = F.when(F.col("l_linenumber") != 5, F.element_at(labels, (F.col("l_orderkey") % 7 + 1).cast("int")))
    rows = table(spark, sf_dir, "lineitem").select(label.alias("label"))
    return rows.groupBy(spellings.coerced("label", ("short", "long", "very_long"), spellings.GAP_CLASS_SPELLINGS).alias("gap_class")).agg(F.count("*").alias("n"), F.count("label").alias("n_labelled"))
