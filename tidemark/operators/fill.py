"""Operational fill: predictions go where the target is missing, and every row says where its value is from."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FillError, InsufficientTrainingData, ModelError
from ..functions.expressions import finite, yes
from . import features, legacy, masks, model, timeaxis

STATES = ("observed", "pre_filled", "unfilled_incomplete_features")


def fill_columns(target: str) -> list[str]:
    return [f"{target}_{c}" for c in ("original", "filled", "is_observed", "is_filled", "fill_method", "model_version")]


def with_provenance(
    df: DataFrame, target: str, prediction: str | Column, method: str, version: str, qc: str | None = None, accepted: Sequence[int] = (0,), refill_pre_filled: bool = False
) -> DataFrame:
    """df with six columns: original and filled value, whether observed, whether filled, method and model version.

    Candidates are rows without a value (and, on request, those whose flag says that somebody filled them before); a
    candidate without a prediction stays as it is and says so.
    """
    names = fill_columns(target)
    if taken := [n for n in names if n in df.columns]:
        raise FillError(f"the frame has {', '.join(taken)} already")
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    present = finite(target)
    seen = masks.observed(target, qc, accepted)
    candidate = ~seen if refill_pre_filled else ~present
    filled = candidate & finite(p)
    value = F.when(present, F.col(target))
    state = F.when(filled, method).when(seen, STATES[0]).when(present, STATES[1]).otherwise(STATES[2])
    return df.withColumns(dict(zip(names, (value, F.when(filled, p).otherwise(value), seen, filled, state, F.when(filled, version)))))


def fill_report(df: DataFrame, target: str, qc: str | None = None, accepted: Sequence[int] = (0,), refill_pre_filled: bool = False, names: Sequence[str] = (), origin: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of row states and candidates of a filled frame, per key; missing features are counted over candidates."""
    original, is_filled = F.col(f"{target}_original"), F.col(f"{target}_is_filled")
    seen = masks.observed(f"{target}_original", qc, accepted)
    present = original.isNotNull()
    candidate = ~seen if refill_pre_filled else ~present
    counts = {
        "rows": F.count("*"), "observed_rows": F.count_if(seen), "pre_filled_rows": F.count_if(present & ~seen), "missing_rows": F.count_if(~present),
        "candidate_rows": F.count_if(candidate), "filled_rows": F.count_if(is_filled), "unfilled_rows": F.count_if(candidate & ~is_filled),
        "rows_before_fit_origin": F.count_if(yes(F.col("ts") < origin)) if origin is not None else F.lit(0).cast("long"),
        **{f"missing_{n}": F.count_if(candidate & ~finite(n)) for n in names},
    }
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])


@dataclass(frozen=True)
class Filled:
    """A filled frame with its accounting: the frame is lazy, the counts come from one pass over it when they are asked for."""

    frame: DataFrame
    target: str
    method: str
    config: Any
    qc: str | None = None
    refill_pre_filled: bool = False

    @property
    def columns(self) -> dict[str, str]:
        """The six columns that the fill added, by what they hold."""
        return {c.removeprefix(f"{self.target}_"): c for c in fill_columns(self.target)}

    def column(self, what: str) -> DataFrame:
        """site_id, ts and one of original, filled, is_observed, is_filled, fill_method, model_version."""
        if what not in self.columns:
            raise FillError(f"a fill has no column {what!r}; it has {', '.join(self.columns)}")
        return self.frame.select("site_id", "ts", F.col(self.columns[what]).alias(what))

    def report(self, by_site: bool = False) -> DataFrame:
        return fill_report(self.frame, self.target, self.qc, self.config.observed_qc, self.refill_pre_filled, keys=("site_id",) if by_site else ())

    def axis(self) -> DataFrame:
        """site_id, start, end and rows of each site of the frame."""
        return self.frame.groupBy("site_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))

    def to_dict(self) -> dict:
        return {"target": self.target, "method": self.method, "columns": list(self.columns.values()), "fill": self.report().first().asDict(), "config": self.config.to_dict()}


class GapFiller:
    """Fit on the observed rows of sites, then fill these or later slices with the origin of the fit."""

    def __init__(self, config):
        self.config = config
        self.forest: model.Forest | None = None
        self.origin = None

    def _matrix(self, df: DataFrame, target: str, shown: Column) -> tuple[DataFrame, list[str]]:
        c = self.config
        drivers = {d: c.columns.get(d, d) for d in c.drivers}
        renamed = df.withColumns({d: F.col(src) for d, src in drivers.items()}).withColumn("_shown", shown)
        if c.features.mode == "legacy":
            return legacy.legacy_features(renamed, target, "_shown", "shortwave", c.side), legacy.legacy_feature_names(target)
        options = dict(c.features.daily()) if c.features.use_limiter else {}
        low, high = c.features.radiation_thresholds
        matrix = features.feature_matrix(
            renamed, list(drivers), "shortwave", target, "_shown", c.side, None if self.origin is None else F.lit(self.origin).cast("timestamp_ntz"), limiter=c.features.use_limiter,
            **({"low": low, "high": high, "convention": c.features.boundary_convention} if c.features.use_limiter else {}), **options,
        )
        return matrix, features.feature_names(list(drivers), target, c.features.use_limiter)

    def fit(self, df: DataFrame, target: str, qc: str | None = None, min_rows: int = 2, on_duplicates: str = "error", sequence: str = "ingest_seq") -> GapFiller:
        """Several rows of a site and stamp are refused, or one is kept by the sequence column (keep_first, keep_last)."""
        c = self.config
        df = timeaxis.resolve_duplicates(df, on_duplicates, sequence)
        self.target, self.qc = target, qc
        self.origin = df.agg(F.min("ts")).first()[0]
        seen = masks.observed(target, qc, c.observed_qc)
        matrix, names = self._matrix(df, target, F.when(seen, F.col(target)))
        truth = df.select("site_id", "ts", F.when(seen, F.col(target)).alias("_truth"))
        joined = matrix.join(truth, ["site_id", "ts"])
        self.forest = model.fit(joined, names, "_truth", c.grid, c.cv_folds, c.cv, c.cv_shuffle, c.seed, c.partitions, min_rows)
        self.forest.settings = c.digest()
        return self

    def fill(self, df: DataFrame, refill_pre_filled: bool = False, on_incomplete: str = "missing", on_duplicates: str = "error", sequence: str = "ingest_seq") -> DataFrame:
        if self.forest is None:
            raise FillError("fit before filling")
        c = self.config
        df = timeaxis.resolve_duplicates(df, on_duplicates, sequence)
        seen = masks.observed(self.target, self.qc, c.observed_qc)
        matrix, _ = self._matrix(df, self.target, F.when(seen, F.col(self.target)))
        predicted = self.forest.predict(matrix, "_prediction", on_incomplete).select("site_id", "ts", "_prediction")
        joined = df.join(predicted, ["site_id", "ts"], "left")
        out = with_provenance(joined, self.target, "_prediction", c.method, c.digest()[:12], self.qc, c.observed_qc, refill_pre_filled)
        return out.drop("_prediction")

    def result(self, df: DataFrame, refill_pre_filled: bool = False, **options) -> Filled:
        """fill() with its accounting; options are those of fill()."""
        return Filled(self.fill(df, refill_pre_filled, **options), self.target, self.config.method, self.config, self.qc, refill_pre_filled)

    def metrics(self, refill_pre_filled: bool = False) -> dict[str, Column]:
        """What to observe of a filled frame while it is written: candidates, fills and the other states of rows."""
        t = self.target
        present = F.col(f"{t}_original").isNotNull()
        candidate = ~F.col(f"{t}_is_observed") if refill_pre_filled else ~present
        return {
            "prediction_rows": F.count_if(F.col(f"{t}_is_filled")), "prediction_rows_offered": F.count_if(candidate), "rows": F.count(F.lit(1)),
            "observed_rows": F.count_if(F.col(f"{t}_is_observed")), "pre_filled_rows": F.count_if(present & ~F.col(f"{t}_is_observed")), "missing_rows": F.count_if(~present),
        }


#: States of a site's model in SiteFillers.report.
FITTED, FEW_ROWS = "fitted", "insufficient_rows"


class SiteFillers:
    """A model of its own for each site, kept in a folder that driver and executors share.

    The feature matrix of all sites is one job, written by site; each site's fit reads its own files alone, several sites
    at a time, and stores its model beside them. A site with too few rows is reported and left unfilled, the others go
    on. A fit that is run again on its folder skips the sites whose models are there.
    """

    def __init__(self, config, folder: str, parallel: int = 4):
        self.config, self.folder, self.parallel = config, folder.rstrip("/"), parallel

    def _model_path(self, site: str) -> str:
        return f"{self.folder}/models/{quote(site, safe='')}"

    def _each(self, spark: SparkSession, sites: Sequence[str], work) -> list:
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(inheritable_thread_target(spark)(work), sites))

    def _matrix(self, df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
        filler = GapFiller(self.config)
        seen = masks.observed(target, self.qc, self.config.observed_qc)
        # without an origin, elapsed hours count from each site's own first stamp
        return filler._matrix(df, target, F.when(seen, F.col(target)))

    def _by_site(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.withColumn("_site", F.col("site_id")).repartition("_site").sortWithinPartitions("_site", "ts").write.mode("overwrite").partitionBy("_site").parquet(path)
        return df.sparkSession.read.schema(df.withColumn("_site", F.col("site_id")).schema).parquet(path)

    def fit(self, df: DataFrame, target: str, qc: str | None = None, min_rows: int = 2, on_duplicates: str = "error", sequence: str = "ingest_seq") -> DataFrame:
        """site_id, state, fitted_rows, rows, worst_feature and rows_digest of each site."""
        c, spark = self.config, df.sparkSession
        self.target, self.qc = target, qc
        df = timeaxis.resolve_duplicates(df, on_duplicates, sequence)
        matrix, self.names = self._matrix(df, target)
        truth = df.select("site_id", "ts", F.when(masks.observed(target, qc, c.observed_qc), F.col(target)).alias("_truth"))
        rows = self._by_site(matrix.join(truth, ["site_id", "ts"]).select("site_id", "ts", *self.names, "_truth"), "matrix")
        self.sites = [r["_site"] for r in rows.select("_site").distinct().orderBy("_site").collect()]  # names alone

        def one(site: str) -> tuple:
            try:
                forest = model.Forest.load(spark, self._model_path(site), c.digest())
            except ModelError:
                try:
                    forest = model.fit(rows.where(F.col("_site") == site), self.names, "_truth", c.grid, c.cv_folds, c.cv, c.cv_shuffle, c.seed, c.partitions, min_rows)
                except InsufficientTrainingData as e:
                    return site, FEW_ROWS, e.report["fitted_rows"], e.report["rows"], e.report["worst_feature"], None
                forest.settings = c.digest()
                forest.save(self._model_path(site))
            return site, FITTED, forest.report["fitted_rows"], forest.report["rows"], forest.report["worst_feature"], forest.rows

        self.state = {r[0]: r for r in self._each(spark, self.sites, one)}
        return spark.createDataFrame(list(self.state.values()), "site_id string, state string, fitted_rows long, rows long, worst_feature string, rows_digest string")

    def fill(self, df: DataFrame, refill_pre_filled: bool = False, on_incomplete: str = "missing", on_duplicates: str = "error", sequence: str = "ingest_seq") -> DataFrame:
        """df with provenance, each row by its own site's model; a site without a model keeps its gaps and says so."""
        c, spark = self.config, df.sparkSession
        df = timeaxis.resolve_duplicates(df, on_duplicates, sequence)
        matrix, _ = self._matrix(df, self.target)
        rows, path = self._by_site(matrix.select("site_id", "ts", *self.names), "asked"), f"{self.folder}/predicted"
        nothing = spark.createDataFrame([], "site_id string, ts timestamp_ntz, _prediction double")
        nothing.write.mode("overwrite").parquet(path)

        def one(site: str) -> None:
            if self.state[site][1] == FITTED:
                forest = model.Forest.load(spark, self._model_path(site), c.digest())
                found = forest.predict(rows.where(F.col("_site") == site), "_prediction", on_incomplete)
                found.select("site_id", "ts", "_prediction").write.mode("overwrite").parquet(f"{path}/of-{quote(site, safe='')}")

        self._each(spark, self.sites, one)
        predicted = spark.read.schema(nothing.schema).option("recursiveFileLookup", True).parquet(path)
        out = with_provenance(df.join(predicted, ["site_id", "ts"], "left"), self.target, "_prediction", c.method, c.digest()[:12], self.qc, c.observed_qc, refill_pre_filled)
        return out.drop("_prediction")
