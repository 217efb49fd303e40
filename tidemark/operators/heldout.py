"""Withheld rows of several targets: what each was offered, what was scored, and whether the fills close the energy balance.

Rows have site_id, ts, gap_class, measured (null unless observed), predicted (null without a prediction).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MetricError
from ..functions.expressions import clean, finite

#: Why a withheld row was not scored, the first that holds.
REASONS = ("missing_target", "not_observed", "incomplete_features", "no_prediction")


def wide_predictions(by_target: Mapping[str, DataFrame]) -> DataFrame:
    """site_id, ts, gap_class and, for each target, its measured and predicted value: one row a site and stamp.

    The targets' rows meet in one grouping, whatever their number, and a stamp that one target lacks stays.
    """
    if not by_target:
        raise MetricError("there is no target to put side by side")
    parts = [df.select("site_id", "ts", "gap_class", F.lit(t).alias("_target"), clean("measured").alias("_m"), clean("predicted").alias("_p")) for t, df in by_target.items()]
    rows = reduce(DataFrame.unionByName, parts)
    own = lambda t, c: F.max(F.when(F.col("_target") == t, F.col(c)))
    values = [own(t, c).alias(f"{t}_{n}") for t in by_target for c, n in (("_m", "measured"), ("_p", "predicted"))]
    return rows.groupBy("site_id", "ts").agg(F.max("gap_class").alias("gap_class"), *values)


def energy_balance(wide: DataFrame, heat: tuple[str, str], radiation: str, ground: str, classes: Sequence[str] | None = None, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """keys, sensible_heat, latent_heat, gap_class and the comparison of measured and filled closure over withheld rows.

    wide: wide_predictions() with the two components of the available energy. Every withheld row is offered; it enters
    both ratios only where both measured fluxes, both predictions, radiation and ground heat are there, and the counts
    say what each missing part cost (a row may lack several). gap_class is all and, with classes, each of them, with
    zeros where a site has no such row. A ratio is null where the available energy is not positive. Sums of the classes
    add up to those of all, so the rows are aggregated once.
    """
    h, le = heat
    if h == le:
        raise MetricError("the energy balance needs two different heat fluxes")
    lost = [c for c in (f"{h}_measured", f"{h}_predicted", f"{le}_measured", f"{le}_predicted", radiation, ground) if c not in wide.columns]
    if lost:
        raise MetricError(f"the energy balance lacks {', '.join(lost)}")
    has_m, has_f = (finite(f"{h}_{x}") & finite(f"{le}_{x}") for x in ("measured", "predicted"))
    has_e = finite(radiation) & finite(ground)
    ok = has_m & has_f & has_e
    total = lambda x: F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0))
    cells = wide.groupBy(*keys, "gap_class").agg(
        F.count_if(ok).alias("n"), F.count("*").alias("n_offered"), F.count_if(~has_m).alias("n_missing_measured"), F.count_if(~has_f).alias("n_missing_filled"),
        F.count_if(~has_e).alias("n_missing_available_energy"), total(clean(radiation) - clean(ground)).alias("available_energy"),
        total(clean(f"{h}_measured") + clean(f"{le}_measured")).alias("_m"), total(clean(f"{h}_predicted") + clean(f"{le}_predicted")).alias("_f"),
    )
    named = [c for c in cells.columns if c not in (*keys, "gap_class")]
    member = F.array(F.lit("all")) if classes is None else F.filter(F.array(F.lit("all"), F.when(F.col("gap_class").isin(list(classes)), F.col("gap_class"))), lambda c: c.isNotNull())
    cells = cells.withColumn("gap_class", F.explode(member)).groupBy(*keys, "gap_class").agg(*[F.sum(c).alias(c) for c in named])
    every = wide.sparkSession.createDataFrame([(c,) for c in ("all", *(classes or ()))], "gap_class string")
    out = wide.select(*keys).distinct().crossJoin(F.broadcast(every)).join(cells, [*keys, "gap_class"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in named[:5]})
    part = lambda c: F.when(F.col("available_energy") > 0, F.try_divide(F.col(c), F.col("available_energy")))
    out = out.withColumns({"measured_ebr": part("_m"), "filled_ebr": part("_f"), "available_energy": F.when(F.col("n") > 0, F.col("available_energy"))})
    return out.select(
        *keys, F.lit(h).alias("sensible_heat"), F.lit(le).alias("latent_heat"), "gap_class", *named[:6], "measured_ebr", "filled_ebr", (F.col("filled_ebr") - F.col("measured_ebr")).alias("difference")
    )


def reason(truth: str | Column, observed: str | Column, complete: str | Column, predicted: str | Column) -> Column:
    """Why a withheld row is not scored; null where it is."""
    c = [F.col(x) if isinstance(x, str) else x for x in (observed, complete)]
    return F.when(~finite(truth), REASONS[0]).when(~c[0], REASONS[1]).when(~c[1], REASONS[2]).when(~finite(predicted), REASONS[3])


def unscored(offered: DataFrame, scored: DataFrame, why: Column, keys: Sequence[str] = ("site_id", "gap_class")) -> DataFrame:
    """keys, n_offered, n_scored and a count a reason: the withheld rows beside those that a score rests on.

    offered: the withheld rows; scored: site_id and ts of the rows with a prediction and a measured value. why is a
    reason for each offered row, of which the rows that were not scored are counted; one that has none but was not
    scored counts as no_prediction.
    """
    hit = scored.select("site_id", "ts", F.lit(True).alias("_scored")).distinct()
    rows = offered.withColumn("_why", why).join(hit, ["site_id", "ts"], "left").withColumn("_why", F.when(F.col("_scored").isNull(), F.coalesce("_why", F.lit(REASONS[3]))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_offered"), F.count("_scored").alias("n_scored"), *[F.count_if(F.col("_why") == r).alias(r) for r in REASONS])
