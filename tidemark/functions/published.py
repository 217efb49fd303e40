"""Published values that runs are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TARGETS = ("NEE", "H", "LE")
METHODS = ("MDS", "RFR3", "RFR10")
GAP_CLASSES = ("all", "short", "long", "very_long")
SUBSETS = ("all", "daytime", "nighttime")
METRICS = ("r2", "slope", "rmse", "bias")

CARBON_UNITS, MODEL_UNITS, HEAT_UNITS = "g C m-2 d-1", "umol CO2 m-2 s-1", "W m-2"
#: umol CO2 m-2 s-1 to g C m-2 d-1.
CARBON_FACTOR = 12.011e-6 * 86400

# Medians over 94 sites (target, method, gap class, subset, r2, slope, rmse, bias).
MEDIANS = (
    ("NEE", "MDS", "all", "all", 0.72, 0.79, 2.98, 0.00),
    ("NEE", "RFR3", "all", "all", 0.78, 0.79, 2.63, -0.01),
    ("NEE", "RFR10", "all", "all", 0.84, 0.84, 2.42, 0.02),
    ("H", "MDS", "all", "all", 0.67, 0.72, 50.33, -1.12),
    ("H", "RFR3", "all", "all", 0.78, 0.78, 39.37, 0.26),
    ("H", "RFR10", "all", "all", 0.90, 0.90, 26.80, -0.13),
    ("LE", "MDS", "all", "all", 0.63, 0.70, 39.84, -2.36),
    ("LE", "RFR3", "all", "all", 0.75, 0.76, 33.50, -0.11),
    ("LE", "RFR10", "all", "all", 0.85, 0.85, 25.51, -0.46),
    ("NEE", "MDS", "very_long", "all", 0.59, 0.85, 2.99, -0.48),
    ("NEE", "RFR3", "very_long", "all", 0.74, 0.97, 2.61, -0.14),
    ("NEE", "RFR10", "very_long", "all", 0.74, 0.97, 2.48, -0.04),
    ("H", "MDS", "very_long", "all", 0.62, 0.88, 55.00, -9.41),
    ("H", "RFR3", "very_long", "all", 0.76, 0.99, 40.11, 0.66),
    ("H", "RFR10", "very_long", "all", 0.89, 1.00, 26.80, -0.20),
    ("LE", "MDS", "very_long", "all", 0.57, 0.85, 45.45, -20.24),
    ("LE", "RFR3", "very_long", "all", 0.74, 0.98, 34.59, -0.35),
    ("LE", "RFR10", "very_long", "all", 0.83, 0.99, 25.49, -3.66),
    ("H", "MDS", "all", "nighttime", 0.03, 0.16, 29.88, None),
    ("H", "RFR3", "all", "nighttime", 0.16, 0.20, 19.46, None),
    ("H", "RFR10", "all", "nighttime", 0.49, 0.47, 14.24, None),
    ("LE", "MDS", "all", "nighttime", 0.02, 0.17, 21.93, None),
    ("LE", "RFR3", "all", "nighttime", 0.10, 0.15, 12.75, None),
    ("LE", "RFR10", "all", "nighttime", 0.27, 0.32, 9.79, None),
)

# Welch comparisons over 94 sites (target, metric, method, baseline, mean difference, interval, significant).
WELCH = (
    ("NEE", "r2", "RFR3", "MDS", 0.07, 0.0, 0.1, True),
    ("NEE", "r2", "RFR10", "RFR3", 0.05, 0.02, 0.09, True),
    ("NEE", "slope", "RFR3", "MDS", 0.01, -0.0274, 0.0484, False),
    ("NEE", "slope", "RFR10", "RFR3", 0.04, 0.00, 0.08, True),
    ("NEE", "bias", "RFR3", "MDS", 0.00, -0.1, 0.1, False),
    ("NEE", "bias", "RFR10", "RFR3", 0.03, -0.03, 0.08, False),
    ("NEE", "rmse", "RFR3", "MDS", -0.40, -0.9, 0.1, True),
    ("NEE", "rmse", "RFR10", "RFR3", -0.24, -0.67, 0.18, False),
    ("H", "r2", "RFR3", "MDS", 0.11, 0.0817, 0.146, True),
    ("H", "r2", "RFR10", "RFR3", 0.12, 0.10, 0.15, True),
    ("H", "slope", "RFR3", "MDS", 0.06, 0.0, 0.1, True),
    ("H", "slope", "RFR10", "RFR3", 0.11, 0.09, 0.13, True),
    ("H", "bias", "RFR3", "MDS", 1.97, 0.7, 3.2, True),
    ("H", "bias", "RFR10", "RFR3", -0.06, -0.81, 0.68, False),
    ("H", "rmse", "RFR3", "MDS", -10.55, -15.3, -5.8, True),
    ("H", "rmse", "RFR10", "RFR3", -13.05, -16.49, -9.62, True),
    ("LE", "r2", "RFR3", "MDS", 0.11, 0.0705, 0.141, True),
    ("LE", "r2", "RFR10", "RFR3", 0.10, 0.07, 0.13, True),
    ("LE", "slope", "RFR3", "MDS", 0.05, 0.0, 0.1, True),
    ("LE", "slope", "RFR10", "RFR3", 0.09, 0.06, 0.12, True),
    ("LE", "bias", "RFR3", "MDS", 2.99, 1.6, 4.4, True),
    ("LE", "bias", "RFR10", "RFR3", -0.85, -1.48, -0.22, True),
    ("LE", "rmse", "RFR3", "MDS", -7.89, -12.7, -3.0, True),
    ("LE", "rmse", "RFR10", "RFR3", -8.19, -11.60, -4.78, True),
)

# Normalised uncertainty of very long gaps (target, method, lower, upper).
UNCERTAINTY = (
    ("NEE", "MDS", 5.21, 5.34),
    ("NEE", "RFR3", 2.90, 2.97),
    ("NEE", "RFR10", 0.87, 0.89),
    ("H", "MDS", 5.37, 5.63),
    ("H", "RFR3", 2.46, 2.57),
    ("H", "RFR10", 1.65, 1.72),
    ("LE", "MDS", 7.90, 8.93),
    ("LE", "RFR3", 2.25, 2.55),
    ("LE", "RFR10", 1.79, 2.02),
)

# The site-level tables (table, targets, methods, sites).
SITE_TABLES = (
    ("Table S4", ("NEE", "H", "LE"), ("MDS", "RFR3", "RFR10"), 94),
    ("Table S5", ("NEE", "H", "LE"), ("MDS", "RFR3", "RFR10"), 94),
    ("Table S6", ("NEE", "H", "LE"), ("MDS", "RFR3", "RFR10"), 94),
    ("Table S9", ("NEE",), ("MDS", "RFR3"), 194),
)


def published_units(target: str) -> str:
    return CARBON_UNITS if target == "NEE" else HEAT_UNITS


def medians_table(spark: SparkSession, **only) -> DataFrame:
    """The medians with their units; only: target, method, gap_class, subset -> values to keep."""
    rows = [(*r, published_units(r[0])) for r in MEDIANS]
    df = spark.createDataFrame(rows, "target string, method string, gap_class string, subset string, r2 double, slope double, rmse double, bias double, units string")
    for column, values in only.items():
        if values is not None:
            df = df.where(df[column].isin(list(values)))
    return df


def welch_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WELCH), "target string, metric string, method string, baseline string, mean_difference double, ci_lower double, ci_upper double, significant boolean")


def uncertainty_table(spark: SparkSession) -> DataFrame:
    """Ranges to read, not to compare: the normalisation behind them is not known."""
    return spark.createDataFrame(list(UNCERTAINTY), "target string, method string, lower double, upper double")


def evidence_table(spark: SparkSession) -> DataFrame:
    rows = [(name, t, m, n) for name, targets, methods, n in SITE_TABLES for t in targets for m in methods]
    return spark.createDataFrame(rows, "table_name string, target string, method string, n_sites long")
