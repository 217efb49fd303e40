"""Site frames and score tables made of the bundled star schema, and the SQL that makes the same."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, metrics

START = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(ts: str, minutes: int):
    origin = F.lit(START).cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", F.floor(F.timestamp_diff("MINUTE", origin, F.col(ts)) / minutes) * minutes, origin)


def site_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as half-hourly sites: site_id, ts, v (mean), sw (largest), qc (least k mod 4)."""
    k = F.get_json_object("props", "$.k").cast("int") % 4
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("site_id"), bucket("ts", 30).alias("ts")).agg(F.avg("value").alias("v"), F.max("value").alias("sw"), F.min(k).alias("qc"))


SITE = f"""site AS (
    SELECT event_type AS site_id, time_bucket(INTERVAL 30 minutes, ts, TIMESTAMP '{START}') AS ts, avg(value) AS v, max(value) AS sw,
        min(json_extract_string(props, '$.k')::INTEGER % 4) AS qc
    FROM events GROUP BY 1, 2)"""

#: (gap_id, class, start, end), in manifest order; the last two overlap the one before.
INTERVALS = (
    ("short-01", "short", "2024-01-05 00:00:00", "2024-01-06 00:00:00"),
    ("long-01", "long", "2024-01-10 00:00:00", "2024-01-17 00:00:00"),
    ("very_long-01", "very_long", "2024-01-15 06:00:00", "2024-01-25 06:00:00"),
    ("short-02", "short", "2024-01-20 12:00:00", "2024-01-21 12:00:00"),
)


def intervals(df: DataFrame, rows=INTERVALS) -> DataFrame:
    """The intervals for every site of df."""
    at = lambda t: datetime.strptime(t, "%Y-%m-%d %H:%M:%S")
    made = df.sparkSession.createDataFrame([(i, c, at(a), at(b), k) for k, (i, c, a, b) in enumerate(rows)], "gap_id string, gap_class string, start timestamp_ntz, end timestamp_ntz, gap_no int")
    return df.select("site_id").distinct().crossJoin(F.broadcast(made))


def intervals_sql(rows=INTERVALS) -> str:
    values = ", ".join(f"('{i}', '{c}', TIMESTAMP '{a}', TIMESTAMP '{b}', {k})" for k, (i, c, a, b) in enumerate(rows))
    return f"gap AS (SELECT * FROM (VALUES {values}) AS g(gap_id, gap_class, gstart, gend, gap_no))"


GAP = intervals_sql()

#: Intervals over the years of the orders.
LONG_INTERVALS = (
    ("short-01", "short", "1996-03-01 00:00:00", "1996-03-15 00:00:00"),
    ("long-01", "long", "1997-01-01 00:00:00", "1997-04-01 00:00:00"),
    ("short-02", "short", "1998-05-01 00:00:00", "1998-05-20 00:00:00"),
    ("very_long-01", "very_long", "1999-01-01 00:00:00", "2000-01-01 00:00:00"),
)
LONG_GAP = intervals_sql(LONG_INTERVALS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and part as measured and predicted values of sites (return flags)."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.col("l_returnflag").alias("site_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_quantity").alias("sw"),
        (F.col("l_extendedprice") / 997).alias("measured"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * F.col("p_retailprice") / 997).alias("predicted"),
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey",
    )


PAIRS = """pairs AS (
    SELECT l_returnflag AS site_id, l_shipdate AS ts, l_quantity AS sw, l_extendedprice / 997 AS measured,
        CASE WHEN l_linenumber <> 7 THEN l_quantity * p_retailprice / 997 END AS predicted,
        l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber, l_suppkey
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""

#: Aggregates of core_metrics over m and p, given with nulls on both sides of a broken pair.
CORE = """count(m) AS n, count(*) AS n_offered,
    CASE WHEN regr_sxx(p, m) > 0 THEN 1 - sum((p - m) * (p - m)) / regr_sxx(p, m) END AS r2,
    CASE WHEN regr_sxx(p, m) > 0 THEN regr_sxy(p, m) / regr_sxx(p, m) END AS slope,
    sqrt(avg((p - m) * (p - m))) AS rmse, (sum(p) - sum(m)) / nullif(count(m), 0) AS bias"""


def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of sites (nations of suppliers) by target, method, gap class and subset."""
    p, s, n = pairs(spark, sf_dir), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = p.join(s, p["l_suppkey"] == s["s_suppkey"]).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.col("l_linenumber") % 3
    rows = rows.select(
        F.col("n_name").alias("site"), F.when(line == 0, "NEE").when(line == 1, "H").otherwise("LE").alias("target"),
        F.when(F.col("site_id") == "A", "MDS").when(F.col("site_id") == "N", "RFR3").otherwise("RFR10").alias("method"), F.lit("RFR3").alias("mode"),
        F.when(F.year("ts") < 1997, "short").when(F.year("ts") < 1999, "long").otherwise("very_long").alias("gap_class"), "sw", "measured", "predicted",
    )
    out = metrics.metrics_grid(rows, "measured", "predicted", "gap_class", masks.subsets("sw"), ["site", "target", "method", "mode"], ["short", "long", "very_long"], list(masks.SUBSETS))
    return out.withColumn("units", F.when(F.col("target") == "NEE", "umol CO2 m-2 s-1").otherwise("W m-2"))


TIDY = f"""{PAIRS},
base AS (
    SELECT n_name AS site, CASE l_linenumber % 3 WHEN 0 THEN 'NEE' WHEN 1 THEN 'H' ELSE 'LE' END AS target,
        CASE site_id WHEN 'A' THEN 'MDS' WHEN 'N' THEN 'RFR3' ELSE 'RFR10' END AS method, 'RFR3' AS mode,
        CASE WHEN year(ts) < 1997 THEN 'short' WHEN year(ts) < 1999 THEN 'long' ELSE 'very_long' END AS gc,
        sw, CASE WHEN predicted IS NOT NULL THEN measured END AS m, predicted AS p
    FROM pairs JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
cells AS (
    SELECT site, target, method, mode, gap_class, subset, {CORE}
    FROM base, unnest(['all', gc]) AS a(gap_class), unnest(['all', CASE WHEN sw > 20 THEN 'daytime' ELSE 'nighttime' END]) AS b(subset)
    GROUP BY ALL),
frame AS (
    SELECT * FROM (SELECT DISTINCT site, target, method, mode FROM base), unnest(['all', 'short', 'long', 'very_long']) AS a(gap_class),
        unnest(['all', 'daytime', 'nighttime']) AS b(subset)),
tidy AS (
    SELECT site, target, method, mode, gap_class, subset, coalesce(n, 0) AS n, coalesce(n_offered, 0) AS n_offered, r2, slope, rmse, bias,
        CASE target WHEN 'NEE' THEN 'umol CO2 m-2 s-1' ELSE 'W m-2' END AS units
    FROM frame LEFT JOIN cells USING (site, target, method, mode, gap_class, subset))"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sites with their region as stratum; one nation in five has none."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("site_id"), F.when(F.col("n_nationkey") % 5 != 4, F.col("r_name")).alias("igbp"), ((F.col("n_nationkey") - 12) * 5.0).alias("latitude"))


SITES = """sites AS (
    SELECT n_name AS site_id, CASE WHEN n_nationkey % 5 <> 4 THEN r_name END AS igbp, (n_nationkey - 12) * 5.0::DOUBLE AS latitude
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def show(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded (own: digits of single columns) and stamps as text, so that results compare across engines."""
    made = {}
    for name, kind in df.dtypes:
        if kind == "double":
            made[name] = F.round(name, own.get(name, digits))
        elif kind in ("timestamp_ntz", "timestamp"):
            made[name] = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            made[name] = F.date_format(name, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            made[name] = F.col(name).cast("long")
    return df.withColumns(made)


def sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def text(column: str, kind: str = "ts") -> str:
    return f"strftime({column}, '%Y-%m-%d{' %H:%M:%S' if kind == 'ts' else ''}')"
