"""Features for validation that cannot see withheld truth, and a probe that proves it."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LeakageError, LeakageWarning
from . import features, legacy, masks


def validation_features(
    df: DataFrame,
    gaps: DataFrame,
    target: str,
    drivers: Sequence[str],
    shortwave: str,
    qc: str | None = None,
    accepted: Sequence[int] = (0,),
    legacy_mode: bool = False,
    hide_target: bool = True,
    **options,
) -> DataFrame:
    """site_id, ts, truth, observed, holdout, available, the features, and complete (no feature missing).

    Order matters: withheld rows are marked first, the target is hidden there, and only then are day statistics built.
    truth is taken from the source and never read by a feature. The legacy mode looks at withheld values by design and
    says so. hide_target=False is for the probe alone.
    """
    held = masks.with_holdout(df, gaps)
    held = held.withColumn("observed", masks.observed(target, qc, accepted))
    held = held.withColumn("available", masks.available(F.col("observed")))
    shown = F.when(F.col("observed" if legacy_mode or not hide_target else "available"), F.col(target))
    held = held.withColumn("_shown", shown)
    if legacy_mode:
        warnings.warn("the legacy feature mode reads withheld values", LeakageWarning, stacklevel=2)
        matrix = legacy.legacy_features(held, target, "_shown", shortwave, options.pop("hemisphere", "north"))
        names = legacy.legacy_feature_names(target)
    else:
        matrix = features.feature_matrix(held, drivers, shortwave, target, "_shown", **options)
        names = features.feature_names(drivers, target, options.get("limiter", True))
    base = held.select("site_id", "ts", F.col(target).alias("truth"), "observed", "holdout", "available")
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    return base.join(matrix, ["site_id", "ts"]).withColumn("complete", complete)


def corrupt_hidden_truth(df: DataFrame, gaps: DataFrame, target: str, magnitude: float = 1e9) -> DataFrame:
    """df with absurd, distinct values in place of the target wherever it is withheld."""
    held = masks.with_holdout(df, gaps)
    number = F.row_number().over(Window.partitionBy("site_id", "holdout").orderBy("ts"))
    return held.withColumn(target, F.when(F.col("holdout"), F.lit(magnitude) * (1 + number)).otherwise(F.col(target))).drop("holdout")


def moved_features(df: DataFrame, gaps: DataFrame, target: str, drivers: Sequence[str], shortwave: str, **options) -> DataFrame:
    """feature, n_moved: in how many rows each feature changes when withheld truth is corrupted; 0 for a safe feature."""
    names = legacy.legacy_feature_names(target) if options.get("legacy_mode") else features.feature_names(drivers, target, options.get("limiter", True))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", LeakageWarning)
        plain = validation_features(df, gaps, target, drivers, shortwave, **options)
        odd = validation_features(corrupt_hidden_truth(df, gaps, target), gaps, target, drivers, shortwave, **options)
    both = plain.select("site_id", "ts", *[F.col(n).cast("double").alias(f"a_{n}") for n in names]).join(
        odd.select("site_id", "ts", *[F.col(n).cast("double").alias(f"b_{n}") for n in names]), ["site_id", "ts"]
    )
    same = lambda n: F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")) | (F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) <= 1e-9 * F.abs(F.col(f"a_{n}")))
    counts = both.agg(*[F.count_if(~F.coalesce(same(n), F.lit(False))).alias(n) for n in names])
    return counts.unpivot([], names, "feature", "n_moved")


def require_no_leakage(df: DataFrame, gaps: DataFrame, target: str, drivers: Sequence[str], shortwave: str, **options) -> None:
    moved = [r["feature"] for r in moved_features(df, gaps, target, drivers, shortwave, **options).where("n_moved > 0").collect()]
    if moved:
        raise LeakageError(f"withheld values of {target} reach {', '.join(moved)}")
