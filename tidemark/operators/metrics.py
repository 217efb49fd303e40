"""Scores of predictions: R2, slope, RMSE, bias, energy balance, over gap classes and day and night, in one pass each.

A pair counts if both sides are finite. What is undefined is null, never NaN or zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clean, finite


def core_metrics(measured: str, predicted: str, definition: str = "residual", intercept: bool = True) -> list[Column]:
    """Aggregates n, n_offered, r2, slope, rmse, bias.

    r2: residual is 1 - SSres / SStot, squared_correlation the square of the correlation. slope: of predicted on
    measured, with an intercept or through the origin.
    """
    both = finite(measured) & finite(predicted)
    m, p = F.when(both, clean(measured)), F.when(both, clean(predicted))
    n = F.count(m)
    ss, sp, cross = F.regr_sxx(p, m), F.regr_syy(p, m), F.regr_sxy(p, m)
    if definition == "residual":
        r2 = F.when(ss > 0, 1 - F.try_divide(F.sum((p - m) * (p - m)), ss))
    else:
        r2 = F.when((ss > 0) & (sp > 0), F.try_divide(cross * cross, ss * sp))
    slope = F.when(ss > 0, F.try_divide(cross, ss)) if intercept else F.try_divide(F.sum(m * p), F.nullif(F.sum(m * m), F.lit(0.0)))
    return [
        n.alias("n"), F.count("*").alias("n_offered"), r2.alias("r2"), slope.alias("slope"),
        F.sqrt(F.avg((p - m) * (p - m))).alias("rmse"), F.try_divide(F.sum(p) - F.sum(m), n).alias("bias"),
    ]


def moments(measured: str, predicted: str) -> list[Column]:
    """Aggregates that add up: counts, means, centred sums of squares and products, and sums that core_metrics needs."""
    both = finite(measured) & finite(predicted)
    m, p = F.when(both, clean(measured)), F.when(both, clean(predicted))
    return [
        F.count(m).alias("n"), F.count("*").alias("n_offered"), F.avg(m).alias("_am"), F.avg(p).alias("_ap"), F.regr_sxx(p, m).alias("_mm"), F.regr_syy(p, m).alias("_pp"), F.regr_sxy(p, m).alias("_mp"),
        F.sum((p - m) * (p - m)).alias("_ee"), F.sum(p - m).alias("_e"), F.sum(m * p).alias("_xmp"), F.sum(m * m).alias("_xmm"),
    ]


def from_moments(cells: DataFrame, keys: Sequence[str], definition: str = "residual", intercept: bool = True) -> DataFrame:
    """core_metrics of the groups of cells of moments: centred sums of a union are those of its parts plus those of the parts' means."""
    group = Window.partitionBy(*keys)
    mean = lambda c: F.try_divide(F.sum(F.col("n") * F.coalesce(c, F.lit(0.0))).over(group), F.sum("n").over(group))
    cells = cells.withColumns({"_dm": F.col("_am") - mean("_am"), "_dp": F.col("_ap") - mean("_ap")})
    joint = lambda c, a, b: F.sum(F.when(F.col("n") > 0, F.coalesce(c, F.lit(0.0)) + F.col("n") * F.col(a) * F.col(b)))
    t = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_offered").alias("n_offered"), joint("_mm", "_dm", "_dm").alias("_mm"), joint("_pp", "_dp", "_dp").alias("_pp"), joint("_mp", "_dm", "_dp").alias("_mp"),
        *[F.sum(c).alias(c) for c in ("_ee", "_e", "_xmp", "_xmm")],
    )
    has = F.col("_mm") > 0
    r2 = F.when(has, 1 - F.try_divide(F.col("_ee"), F.col("_mm"))) if definition == "residual" else F.when(has & (F.col("_pp") > 0), F.try_divide(F.col("_mp") * F.col("_mp"), F.col("_mm") * F.col("_pp")))
    slope = F.when(has, F.try_divide(F.col("_mp"), F.col("_mm"))) if intercept else F.try_divide(F.col("_xmp"), F.nullif(F.col("_xmm"), F.lit(0.0)))
    return t.select(*keys, "n", "n_offered", r2.alias("r2"), slope.alias("slope"), F.sqrt(F.try_divide(F.col("_ee"), F.col("n"))).alias("rmse"), F.try_divide(F.col("_e"), F.col("n")).alias("bias"))


def metrics_grid(rows: DataFrame, measured: str, predicted: str, gap_class: str, subset_array: Column, keys: list[str], classes: list[str], subsets: list[str], **options) -> DataFrame:
    """core_metrics for every key, gap class ('all' and each) and subset; cells without rows appear with n = 0.

    Each row goes into one aggregate, by its class and the subsets it is in; the few cells of moments that this leaves
    are what all, the classes and the subsets are put together from.
    """
    base = rows.select(*keys, F.col(measured).alias("_m"), F.col(predicted).alias("_p"), F.col(gap_class).alias("_c"), subset_array.alias("_s"))
    base = base.groupBy(*keys, "_c", "_s").agg(*moments("_m", "_p"))
    member = F.filter(F.array(F.lit("all"), F.col("_c")), lambda c: c.isNotNull())
    cells = base.withColumn("gap_class", F.explode(member)).withColumn("subset", F.explode("_s"))
    cells = from_moments(cells, [*keys, "gap_class", "subset"], **options)
    spark = rows.sparkSession
    frame = base.select(*keys).distinct()
    frame = frame.crossJoin(F.broadcast(spark.createDataFrame([(c, s) for c in ["all", *classes] for s in subsets], "gap_class string, subset string")))
    out = frame.join(cells, [*keys, "gap_class", "subset"], "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"n": F.coalesce("n", zero), "n_offered": F.coalesce("n_offered", zero)})


def bias_spread(rows: DataFrame, measured: str, predicted: str, keys: list[str], gap_class: str = "gap_class", gap_id: str = "gap_id") -> DataFrame:
    """Quartiles over gaps of each gap's mean error, per class; the range between quartiles needs two gaps."""
    both = finite(measured) & finite(predicted)
    error = F.when(both, clean(predicted) - clean(measured))
    per = rows.groupBy(*keys, gap_class, gap_id).agg(F.avg(error).alias("bias"))
    q = [F.percentile("bias", x) for x in (0.25, 0.5, 0.75)]
    out = per.groupBy(*keys, gap_class).agg(F.count("bias").alias("n_gaps"), F.count("*").alias("n_gaps_offered"), *[a.alias(n) for a, n in zip(q, ("bias_q1", "bias_median", "bias_q3"))])
    return out.withColumn("bias_iqr", F.when(F.col("n_gaps") > 1, F.col("bias_q3") - F.col("bias_q1")))


def energy_balance_ratio(h: str, le: str, radiation: str, ground: str) -> Column:
    """Sum of the heat fluxes over the available energy, of rows that have all four; null if that is not positive."""
    ok = finite(h) & finite(le) & finite(radiation) & finite(ground)
    energy = F.sum(F.when(ok, clean(radiation) - clean(ground)))
    return F.when(energy > 0, F.try_divide(F.sum(F.when(ok, clean(h) + clean(le))), energy))


def energy_balance_comparison(measured: tuple[str, str], filled: tuple[str, str], radiation: str, ground: str) -> list[Column]:
    """Measured and filled ratio on the rows that have everything, and why others were dropped."""
    has_m, has_f = finite(measured[0]) & finite(measured[1]), finite(filled[0]) & finite(filled[1])
    has_e = finite(radiation) & finite(ground)
    ok = has_m & has_f & has_e
    energy = F.sum(F.when(ok, clean(radiation) - clean(ground)))
    part = lambda pair: F.when(energy > 0, F.try_divide(F.sum(F.when(ok, clean(pair[0]) + clean(pair[1]))), energy))
    return [
        F.count_if(ok).alias("n"), F.count("*").alias("n_offered"), F.count_if(~has_m).alias("n_missing_measured"), F.count_if(~has_f).alias("n_missing_filled"),
        F.count_if(~has_e).alias("n_missing_available_energy"), energy.alias("available_energy"), part(measured).alias("measured_ebr"),
        part(filled).alias("filled_ebr"), (part(filled) - part(measured)).alias("difference"),
    ]
