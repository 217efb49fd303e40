"""Random forests over feature matrices: fit with search and folds, predict, save, load."""

from __future__ import annotations

import itertools
import json
import platform
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyspark
from pyspark.errors import AnalysisException
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InsufficientTrainingData, ModelError, ModelWarning
from ..functions.expressions import finite

MODEL_FORMAT = 1
#: Spark's trees are no deeper than this.
MOST_DEPTH = 30


def complete(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & finite(n)
    return out


def fit_report(matrix: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """One row: rows, fitted_rows, dropped_missing_target, dropped_missing_features, worst_feature, worst_missing.

    Missing features are counted over rows with a target; of features missing as often the last by name is the worst.
    """
    has = finite(target)
    missing = [F.count_if(has & ~finite(n)).alias(f"_{k}") for k, n in enumerate(names)]
    t = matrix.agg(F.count("*").alias("rows"), F.count_if(has & complete(names)).alias("fitted_rows"), F.count_if(~has).alias("dropped_missing_target"), F.count_if(has & ~complete(names)).alias("dropped_missing_features"), *missing)
    worst = F.array_max(F.array(*[F.struct(F.col(f"_{k}").alias("n"), F.lit(n).alias("name")) for k, n in enumerate(names)]))
    return t.select("rows", "fitted_rows", "dropped_missing_target", "dropped_missing_features", F.when(worst["n"] > 0, worst["name"]).alias("worst_feature"), worst["n"].alias("worst_missing"))


def with_folds(rows: DataFrame, folds: int, order: Sequence[str] = ("site_id", "ts"), shuffle_seed: int | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """rows with fold 0..folds-1: contiguous blocks in row order, the first n % folds of them one row longer.

    Shuffled folds take a hash of the order columns and the seed instead, so they don't depend on partitions. groups
    deals folds within each group (such as a site), which spreads the numbering over as many tasks. Without groups,
    rows are numbered within stretches of the order (days of a site, ranges of the hash), whose counts are summed.
    """
    if groups:
        key = [F.xxhash64(F.lit(shuffle_seed), *order)] if shuffle_seed is not None else list(order)
        whole = Window.partitionBy(*groups)
        placed = rows.withColumn("_place", F.row_number().over(whole.orderBy(*key)) - 1).withColumn("_n", F.count("*").over(whole))
    else:
        placed = _placed(rows, order, shuffle_seed)
    place, n = F.col("_place"), F.col("_n")
    small = F.floor(n / folds)
    long_rows = (n % folds) * (small + 1)
    fold = F.when(place < long_rows, F.floor(place / (small + 1))).otherwise((n % folds) + F.floor((place - long_rows) / F.greatest(small, F.lit(1))))
    return placed.withColumn("fold", fold.cast("int")).drop("_place", "_n")


def with_time_blocks(rows: DataFrame, folds: int) -> DataFrame:
    """rows with fold 0..folds by time over all sites: the last folds blocks have n // (folds + 1) rows each and are scored one
    after another, the first has the rest and is only trained on."""
    placed = _placed(rows, ("ts", "site_id"), None)
    size = F.floor(F.col("_n") / (folds + 1))
    first = F.col("_n") - folds * size
    fold = F.when(F.col("_place") < first, 0).otherwise(1 + F.floor((F.col("_place") - first) / F.greatest(size, F.lit(1))))
    return placed.withColumn("fold", fold.cast("int")).drop("_place", "_n")


def _placed(rows: DataFrame, order: Sequence[str], shuffle_seed: int | None) -> DataFrame:
    """rows with _place (0.. in this order) and _n. Stretches are numbered apart; only their counts meet in one window."""
    if shuffle_seed is not None:
        keyed = rows.withColumn("_key", F.xxhash64(F.lit(shuffle_seed), *order))
        keyed, key = keyed.withColumn("_s0", F.shiftright("_key", 50)), ["_key"]
    else:
        keyed, key = rows, list(order)
        for k, c in enumerate(order):
            keyed = keyed.withColumn(f"_s{k}", F.to_date(c) if c == "ts" else F.col(c))
    stretch = [c for c in keyed.columns if c in ("_s0", "_s1")]
    counts = keyed.groupBy(*stretch).agg(F.count("*").alias("_k"))
    before = counts.select(*[F.col(c).alias(f"{c}_") for c in stretch], (F.sum("_k").over(Window.orderBy(*stretch)) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    within = keyed.withColumn("_within", F.row_number().over(Window.partitionBy(*stretch).orderBy(*key)) - 1)
    met = F.lit(True)
    for c in stretch:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return within.join(before, met).select(*rows.columns, (F.col("_before") + F.col("_within")).alias("_place"), "_n")


def rows_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n_rows, digest_sum, digest_xor: a digest of a multiset of rows, whatever their order and partitions.

    Each row's md5 (of its columns as text, a null as a mark of its own) gives 60 bits; their sum counts repeated rows,
    which their xor does not.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[text(c) for c in columns])), 1, 15), 16, 10).cast("long")
    return rows.select(bits.alias("_bits")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("_bits").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"), F.coalesce(F.bit_xor("_bits"), F.lit(0)).alias("digest_xor"))


def _digest_of(rows: DataFrame, columns: Sequence[str]) -> str:
    found = rows_digest(rows, columns).first()
    return ":".join(str(v) for v in found)


def usable_rows(matrix: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """site_id, ts, features and _y of the rows that a fit uses."""
    return matrix.where(finite(target) & complete(names)).select("site_id", "ts", *[F.col(n).cast("double").alias(n) for n in names], F.col(target).cast("double").alias("_y"))


@dataclass
class Forest:
    """A fitted forest with the order of its features and how it came about."""

    model: RandomForestRegressionModel
    names: list[str]
    target: str
    report: dict
    best: dict
    score: float | None = None
    notes: tuple[str, ...] = ()
    rows: str | None = None
    settings: str | None = None

    def importances(self) -> dict[str, float]:
        return dict(zip(self.names, map(float, self.model.featureImportances.toArray())))

    def predict(self, matrix: DataFrame, column: str = "prediction", on_incomplete: str = "missing") -> DataFrame:
        """matrix with a prediction where every feature is finite and null elsewhere; 'raise' refuses such rows."""
        ok = complete(self.names)
        if on_incomplete == "raise" and matrix.where(~ok).limit(1).count():
            raise ModelError(f"rows lack features of {self.target}")
        vectors = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(self.names))], outputCol="_v")
        filled = matrix.withColumns({f"_f{k}": F.when(ok, F.col(n).cast("double")).otherwise(F.lit(0.0)) for k, n in enumerate(self.names)})
        scored = self.model.setFeaturesCol("_v").setPredictionCol("_p").transform(vectors.transform(filled))
        return scored.withColumn(column, F.when(ok, F.col("_p"))).select(*matrix.columns, column)

    def save(self, path: str) -> None:
        """Model and its description, through Spark's writers, so to any store."""
        self.model.write().overwrite().save(f"{path}/forest")
        meta = {"format": MODEL_FORMAT, "names": self.names, "target": self.target, "report": self.report, "best": self.best, "score": self.score, "notes": list(self.notes), "rows": self.rows, "settings": self.settings, "versions": {"pyspark": pyspark.__version__, "python": platform.python_version()}}
        spark = SparkSession.builder.getOrCreate()  # the one there is, in any thread
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: str | None = None) -> Forest:
        """A saved forest. Other settings than those given are refused, other versions than those of the fit warned of."""
        try:
            meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        except (ValueError, TypeError, AnalysisException) as e:
            raise ModelError(f"{path} is no saved forest: {e}") from e
        if settings is not None and meta.get("settings") != settings:
            raise ModelError(f"{path} was fitted under settings {meta.get('settings')}, not {settings}")
        now = {"pyspark": pyspark.__version__, "python": platform.python_version()}
        if drift := [f"{k} {v} (now {now.get(k)})" for k, v in meta.get("versions", {}).items() if v != now.get(k)]:
            warnings.warn(f"{path} was fitted under {', '.join(drift)}", ModelWarning, stacklevel=2)
        if meta.get("format") != MODEL_FORMAT:
            raise ModelError(f"{path} has model format {meta.get('format')}, not {MODEL_FORMAT}")
        return cls(RandomForestRegressionModel.load(f"{path}/forest"), meta["names"], meta["target"], meta["report"], meta["best"], meta["score"], tuple(meta["notes"]), meta.get("rows"), meta.get("settings"))

    def fitted_on(self, matrix: DataFrame, target: str | None = None) -> bool:
        """Are the usable rows of this matrix those of the fit, in any order?"""
        return self.rows == _digest_of(usable_rows(matrix, self.names, target or self.target), ["site_id", "ts", *self.names, "_y"])


def _estimator(params: Mapping, seed: int, n_features: int) -> tuple[RandomForestRegressor, list[str]]:
    """Spark's forest for parameters under their usual names, and what of them has no counterpart."""
    notes, subset = [], params.get("max_features", 1.0)
    strategy = "all" if subset == 1.0 and not isinstance(subset, int) else subset if isinstance(subset, str) else str(min(int(subset), n_features)) if isinstance(subset, int) else str(float(subset))
    depth = params.get("max_depth")
    if depth is None or depth > MOST_DEPTH:
        notes.append(f"trees are {MOST_DEPTH} deep at most")
    if "min_samples_split" in params:
        notes.append("min_samples_split is not applied")
    return RandomForestRegressor(
        featuresCol="_v", labelCol="_y", predictionCol="_p", numTrees=int(params.get("n_estimators", 100)), maxDepth=min(MOST_DEPTH, int(depth or MOST_DEPTH)),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)), featureSubsetStrategy=strategy, maxBins=int(params.get("max_bins", 128)), seed=seed, bootstrap=bool(params.get("bootstrap", True)),
    ), notes


def fit(
    matrix: DataFrame,
    names: Sequence[str],
    target: str,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = 5,
    cv: str = "kfold",
    shuffle: bool = False,
    seed: int = 42,
    partitions: int = 8,
    min_rows: int = 2,
) -> Forest:
    """Search the grid by R2 over folds and refit the best on all usable rows.

    Rows are dealt by range of (site_id, ts) into a fixed number of partitions and sorted, because a forest depends on
    how its rows lie. Time-series folds train on all rows before the block they score; every fold scores a block.
    """
    names = list(names)
    report = fit_report(matrix, names, target).first().asDict()
    if report["fitted_rows"] < max(min_rows, folds + (cv == "time_series_split") if grid and _candidates(grid) > 1 else 1):
        raise InsufficientTrainingData(f"{target}: {report['fitted_rows']} usable rows of {report['rows']}; worst feature {report['worst_feature']}", report)
    usable = usable_rows(matrix, names, target)
    candidates = [dict(zip(grid, values)) for values in itertools.product(*grid.values())] if grid else [{}]
    if len(candidates) > 1:
        usable = with_time_blocks(usable, folds) if cv == "time_series_split" else with_folds(usable, folds, shuffle_seed=seed if shuffle else None)
    ready = VectorAssembler(inputCols=names, outputCol="_v").transform(usable).repartitionByRange(partitions, "site_id", "ts").sortWithinPartitions("site_id", "ts").persist()
    best, score, notes = candidates[0], None, []
    try:
        digest = _digest_of(ready, ["site_id", "ts", *names, "_y"])
        if len(candidates) > 1:
            judge = RegressionEvaluator(labelCol="_y", predictionCol="_p", metricName="r2")
            scores = []
            for params in candidates:
                estimator, _ = _estimator(params, seed, len(names))
                found = []
                for k in range(1, folds + 1) if cv == "time_series_split" else range(folds):
                    train = ready.where(F.col("fold") < k if cv == "time_series_split" else F.col("fold") != k)
                    found.append(judge.evaluate(estimator.fit(train).transform(ready.where(F.col("fold") == k))))
                scores.append(sum(found) / len(found))
            score = max(scores)
            best = candidates[scores.index(score)]
        estimator, notes = _estimator(best, seed, len(names))
        model = estimator.fit(ready)
    finally:
        ready.unpersist()
    return Forest(model, names, target, report, best, score, tuple(notes), digest)


def _candidates(grid: Mapping[str, Sequence]) -> int:
    n = 1
    for values in grid.values():
        n *= len(values)
    return n
