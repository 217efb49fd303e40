"""Row accounting of runs and the completeness of their manifests.

Counts are metrics that Spark observes in the pass that writes the rows: nothing is read twice to be counted.
"""

from __future__ import annotations

import platform
from collections.abc import Mapping
from dataclasses import asdict, dataclass

import pyspark
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ProvenanceError
from ..functions.expressions import finite

MANIFEST_FORMAT = "tidemark-manifest-1"
#: Sections that every manifest has, and those that one kind of run has besides.
SECTIONS = ("format", "kind", "target", "method", "seed", "config", "digest", "choices", "versions", "axis", "features", "fit", "rows")
OF_KIND = {"validation": ("gaps", "metrics"), "fill": ("fill",)}


@dataclass(frozen=True)
class RowCounts:
    """Rows that a fit used and a prediction reached, each beside the rows that were offered."""

    training_rows: int
    training_rows_offered: int
    prediction_rows: int
    prediction_rows_offered: int

    def __post_init__(self):
        for name, value in asdict(self).items():
            if isinstance(value, bool) or not isinstance(value, int):
                raise ProvenanceError(f"{name} must be a whole number, got {value!r}")
            if value < 0:
                raise ProvenanceError(f"{name} is {value}; no count is below 0")
        for what in ("training", "prediction"):
            used, offered = getattr(self, f"{what}_rows"), getattr(self, f"{what}_rows_offered")
            if used > offered:
                raise ProvenanceError(f"{used} {what} rows of {offered} offered")

    def to_dict(self) -> dict[str, int]:
        return asdict(self) | {"training_rows_dropped": self.training_rows_offered - self.training_rows, "prediction_rows_dropped": self.prediction_rows_offered - self.prediction_rows}


class Counted:
    """A frame whose metrics are observed by the action that consumes it; values() has them once that is over."""

    def __init__(self, df: DataFrame, **metrics: Column):
        self._observation = Observation()
        self.df = df.observe(self._observation, *[m.alias(n) for n, m in metrics.items()])

    def values(self) -> dict[str, int]:
        return {k: int(v or 0) for k, v in self._observation.get.items()}


def training_metrics(target: str | Column, complete: Column) -> dict[str, Column]:
    """What to observe of rows offered to a fit: those with a value and every feature are used."""
    return {"training_rows": F.count_if(finite(target) & complete), "training_rows_offered": F.count(F.lit(1))}


def prediction_metrics(candidate: Column, predicted: str | Column) -> dict[str, Column]:
    """What to observe of rows offered to a model: the candidates, and those that received a prediction."""
    return {"prediction_rows": F.count_if(candidate & finite(predicted)), "prediction_rows_offered": F.count_if(candidate)}


def versions() -> dict[str, str]:
    import numpy
    import pandas
    import pyarrow

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}


def missing_sections(manifest: Mapping) -> list[str]:
    """Sections that a manifest of its kind should have and has not, or has empty."""
    wanted = (*SECTIONS, *OF_KIND.get(manifest.get("kind"), ()))
    lost = [s for s in wanted if manifest.get(s) is None or manifest.get(s) == {} or manifest.get(s) == []]
    if manifest.get("kind") not in OF_KIND and "kind" not in lost:
        lost.append("kind")
    return lost


def require_complete(manifest: Mapping) -> Mapping:
    """manifest, unless it lacks a section or its row counts contradict each other."""
    if lost := missing_sections(manifest):
        raise ProvenanceError(f"the manifest lacks {', '.join(lost)}")
    rows = manifest["rows"]
    RowCounts(**{k: rows.get(k) for k in RowCounts.__dataclass_fields__})
    return manifest


def write_fill(filler, df: DataFrame, folder: str, refill_pre_filled: bool = False) -> dict:
    """Fill df, write rows and report, and a manifest with the counts of the pass that wrote the rows; returns it."""
    from ..operators import fill
    from ..sources import tables
    from .validation import choices_of

    c, forest = filler.config, filler.forest
    counted = Counted(filler.fill(df, refill_pre_filled), **filler.metrics(refill_pre_filled))
    tables.write_results({"filled": counted.df}, folder)
    seen = counted.values()
    rows = RowCounts(forest.report["fitted_rows"], forest.report["rows"], seen["prediction_rows"], seen["prediction_rows_offered"])
    ends = df.agg(F.min("ts").cast("string").alias("start"), F.max("ts").cast("string").alias("end"), F.count_distinct("site_id").alias("n_sites")).first().asDict()
    manifest = {
        "format": MANIFEST_FORMAT, "kind": "fill", "target": filler.target, "method": c.method, "seed": c.seed, "config": c.to_dict(), "digest": c.digest(), "choices": choices_of(c), "versions": versions(),
        "axis": ends | {"n": seen["rows"], "origin": str(filler.origin)}, "features": forest.names, "fit": forest.report | {"rows_digest": forest.rows}, "best": forest.best, "score": forest.score,
        "notes": list(forest.notes), "rows": rows.to_dict(), "fill": {k: v for k, v in seen.items() if not k.startswith("prediction")},
    }
    report = fill.fill_report(filled_back(df.sparkSession, folder, counted.df), filler.target, filler.qc, c.observed_qc, refill_pre_filled)
    tables.write_results({"report": report}, folder, manifest)
    return manifest


def filled_back(spark, folder: str, like: DataFrame) -> DataFrame:
    """The filled rows as they were written, in the types of the frame that was."""
    return spark.read.option("header", True).schema(like.schema).csv(f"{folder}/filled")
