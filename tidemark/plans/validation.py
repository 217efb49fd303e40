"""The artificial-gap experiment from end to end, and its manifest."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, LeakageError, ValidationWarning
from ..functions.expressions import finite
from ..operators import features, gaps, heldout, leakage, legacy, masks, metrics, model, timeaxis
from . import accounting
from .config import RunConfig


def keep_on_disk(df: DataFrame) -> DataFrame:
    """df, kept on disk after its first use; a lost part is computed again from its lineage."""
    return df.persist(StorageLevel.DISK_ONLY)

#: Settings that change results and have no single right value, for the manifest.
CHOICES = ("grid", "features.radiation_thresholds", "features.boundary_convention", "gaps.basis", "features.daily_strategy", "cv", "cv_folds", "features.mode", "gaps.fraction_tolerance", "gaps.mix_tolerance", "hemisphere", "features.daily_std_ddof", "validation.r2_definition")




def choices_of(config: RunConfig) -> dict:
    flat = config.to_dict()
    return {c: flat[c.split(".")[0]] if "." not in c else flat[c.split(".")[0]][c.split(".")[1]] for c in CHOICES}


#: What the energy balance needs besides the two heat fluxes, whatever the driver mode.
ENERGY_DRIVERS = ("net_radiation", "ground_heat_flux")


@dataclass
class Validation:
    """Predictions within the gaps of one target, its scores, and how they came about."""

    target: str
    config: RunConfig
    forest: model.Forest
    predictions: DataFrame
    scores: DataFrame
    spread: DataFrame | None
    gaps: DataFrame
    unscored: DataFrame
    rows: accounting.RowCounts
    axis: dict
    names: list[str]
    once: DataFrame
    notes: tuple[str, ...] = ()
    energy_balance: DataFrame | None = None

    def manifest(self) -> dict:
        """Everything that the run rests on; require_complete() has passed it before it is written."""
        flat = self.config.to_dict()
        plain = lambda df: [{k: str(v) if isinstance(v, datetime) else v for k, v in r.asDict().items()} for r in df.collect()]  # noqa: E731  a row a site and gap or cell
        return {
            "format": accounting.MANIFEST_FORMAT, "kind": "validation", "target": self.target, "method": self.config.method, "seed": self.config.seed, "config": flat, "digest": self.config.digest(),
            "choices": choices_of(self.config), "versions": accounting.versions(), "axis": self.axis, "features": self.names, "feature_description": self.config.feature_description(self.target),
            "fit": self.forest.report, "best": self.forest.best, "score": self.forest.score, "notes": [*self.forest.notes, *self.notes], "rows": self.rows.to_dict(),
            "gaps": {"scenario": gaps.describe(self.config.gaps), "intervals": plain(self.gaps)}, "metrics": plain(self.scores.where("gap_class = 'all'")),
        }


def wide_predictions(found: Mapping[str, Validation]) -> DataFrame:
    """site_id, ts, gap_class and each target's measured and predicted value over the withheld rows."""
    return heldout.wide_predictions({t: v.once for t, v in found.items()})


def _energy_pair(config: RunConfig, targets: Sequence[str], columns: Sequence[str], pair: tuple[str, str] | None) -> tuple[str, str] | None:
    """The heat fluxes to compare; None if that is switched off or the run has no such pair."""
    if pair is None:
        if not config.validation.energy_balance or not {"H", "LE"} <= set(targets):
            return None
        pair = ("H", "LE")
    if unknown := [t for t in pair if t not in targets]:
        raise ConfigError(f"the energy balance names targets that are not validated: {', '.join(unknown)}")
    if lost := [d for d in ENERGY_DRIVERS if config.columns.get(d, d) not in columns]:
        raise ConfigError(f"the energy balance needs {', '.join(lost)}, whatever the mode; map them or switch it off")
    return pair


def validate(
    df: DataFrame, config: RunConfig, targets: Sequence[str], qc: Mapping[str, str] | None = None, intervals: DataFrame | None = None, steps: DataFrame | None = None, check_leakage: bool = False,
    energy_pair: tuple[str, str] | None = None, on_duplicates: str = "error", sequence: str = "ingest_seq", min_rows: int = 2, on_incomplete: str = "missing", on_shortfall: str = "warn",
) -> dict[str, Validation]:
    """Withhold gaps, train on the rest, predict the gaps and score them, target by target.

    Gaps are shared by all targets: a row is available for placing them only where every target is observed. Without
    intervals they are placed by the scenario. Rows count for a score if withheld and observed, and once: of overlapping
    gaps the later one gives the class. The spread of bias is over gaps, so there a row counts in each of its gaps.

    With energy_balance in the settings (and targets H and LE) or an energy_pair, the results of the pair carry the
    closure of measured and filled fluxes over the rows withheld from both. on_duplicates, min_rows, on_incomplete and
    on_shortfall are those of resolve_duplicates, fit, predict and place. A target of which no withheld row could be
    scored is warned of; so are shares of gaps that miss their tolerance.
    """
    qc = dict(qc or {})
    if lost := [c for c in (*targets, *qc.values()) if c not in df.columns]:
        raise ConfigError(f"the frame lacks {', '.join(lost)}")
    energy_pair = _energy_pair(config, targets, df.columns, energy_pair)
    energy = {f"_{d}": config.columns.get(d, d) for d in ENERGY_DRIVERS} if energy_pair else {}
    df = timeaxis.resolve_duplicates(df, on_duplicates, sequence)
    if lost := [c for c in (config.columns.get(d, d) for d in config.drivers) if c not in df.columns]:
        raise ConfigError(f"the frame lacks the drivers {', '.join(lost)}")
    drivers = {d: config.columns.get(d, d) for d in config.drivers}
    df = df.withColumns({d: F.col(c) for d, c in drivers.items()})
    if intervals is None:
        every = F.lit(True)
        for t in targets:
            every = every & masks.observed(t, qc.get(t), config.observed_qc)
        placed_on, intervals = every, gaps.place(df, steps, every, config.gaps, config.seed, on_shortfall)
        intervals = keep_on_disk(intervals)
    else:
        placed_on = None
    notes = tuple(gaps.warn_on_tolerance(gaps.achieved(df, intervals, placed_on, config.gaps))) if placed_on is not None else ()
    ends = df.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.count_distinct("site_id").alias("n_sites")).first()
    axis = {k: str(v) if isinstance(v, datetime) else v for k, v in ends.asDict().items()}
    low, high = config.features.radiation_thresholds
    options = dict(config.features.daily(), low=low, high=high, convention=config.features.boundary_convention, hemisphere=config.side)
    out = {}
    for t in targets:
        old = config.features.mode == "legacy"
        opts = {"hemisphere": config.side, "legacy_mode": True} if old else {**options, "limiter": config.features.use_limiter} if config.features.use_limiter else {"limiter": False}
        if check_leakage and not old:
            with warnings.catch_warnings():
                moved = leakage.moved_features(df, intervals, t, list(drivers), "shortwave", qc=qc.get(t), accepted=config.observed_qc, **opts).where("n_moved > 0")
                if (row := moved.first()) is not None:
                    raise LeakageError(f"withheld values of {t} reach {row['feature']}")
        held = leakage.validation_features(df, intervals, t, list(drivers), "shortwave", qc.get(t), config.observed_qc, **opts)
        names = legacy.legacy_feature_names(t) if old else features.feature_names(list(drivers), t, config.features.use_limiter)
        forest = model.fit(held.withColumn("_y0", F.when(F.col("available"), F.col("truth"))), names, "_y0", config.grid, config.cv_folds, config.cv, config.cv_shuffle, config.seed, config.partitions, min_rows)
        withheld = held.where("holdout").withColumn("complete", model.complete(names))
        inside = forest.predict(withheld, "predicted", on_incomplete).select("site_id", "ts", "truth", "observed", "complete", "predicted")
        inside = keep_on_disk(inside)  # predicted once for scores, spread, counts and closure
        rows = masks.gap_rows(inside, intervals.select("site_id", "gap_id", "gap_class", "start", "end"))
        rows = rows.join(df.select("site_id", "ts", F.col("shortwave").alias("_sw")), ["site_id", "ts"])
        rows = rows.withColumn("measured", F.when(F.col("observed"), F.col("truth")))
        v = config.validation
        # where gaps overlap, a row counts once for the scores, with the class of the later gap
        once = masks.with_gap_class(inside, intervals.withColumn("gap_no", F.struct("start", "end", "gap_id")))
        once = once.join(df.select("site_id", "ts", F.col("shortwave").alias("_sw")), ["site_id", "ts"]).withColumn("measured", F.when(F.col("observed"), F.col("truth")))
        classes = list(gaps.CLASSES) if v.by_gap_class else []
        graded = once if v.by_gap_class else once.withColumn("gap_class", F.lit(None).cast("string"))
        scores = metrics.metrics_grid(graded, "measured", "predicted", "gap_class", masks.subsets("_sw", v.daytime_threshold), ["site_id"], classes, list(v.subsets), definition=v.r2_definition)
        scores = scores.withColumns({"target": F.lit(t), "method": F.lit(config.method), "mode": F.lit(config.mode)}).withColumnRenamed("site_id", "site")
        spread = metrics.bias_spread(rows, "measured", "predicted", ["site_id"]) if v.bias_spread else None
        counts = inside.agg(F.count_if(finite("predicted")).alias("n"), F.count("*").alias("offered"), F.count_if(finite("predicted") & F.col("observed") & finite("truth")).alias("scored")).first()
        if counts["offered"] and not counts["scored"]:
            warnings.warn(
                f"{config.method} {t}: none of {counts['offered']} withheld rows could be scored; a gap over whole days has no daily statistics under "
                f"{config.features.daily_strategy!r}, which rolling_available or neighbor_day_fallback would give", ValidationWarning, stacklevel=2,
            )
        reasons = heldout.unscored(once, once.where(finite("predicted") & finite("measured")), heldout.reason("truth", "observed", "complete", "predicted"))
        rows_of = accounting.RowCounts(forest.report["fitted_rows"], forest.report["rows"], counts["n"], counts["offered"])
        out[t] = Validation(t, config, forest, rows, scores, spread, intervals, reasons, rows_of, axis, names, once, notes)
    if energy_pair:
        wide = heldout.wide_predictions({t: out[t].once for t in energy_pair}).join(df.select("site_id", "ts", *[F.col(c).alias(n) for n, c in energy.items()]), ["site_id", "ts"])
        balance = heldout.energy_balance(wide, energy_pair, *energy, classes=gaps.CLASSES if config.validation.by_gap_class else None)
        balance = balance.select(F.lit(config.method).alias("method"), F.lit(config.mode).alias("mode"), F.col("site_id").alias("site"), *balance.columns[1:])
        for t in energy_pair:
            out[t].energy_balance = balance
    return out
