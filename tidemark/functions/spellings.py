"""Names with several spellings: settings on the driver, labels in columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .expressions import col

#: Other spellings of the gap classes: their usual durations.
GAP_CLASS_SPELLINGS = {"24h": "short", "1d": "short", "7d": "long", "30d": "very_long", "verylong": "very_long"}
HEMISPHERE_SPELLINGS = {"n": "north", "northern": "north", "s": "south", "southern": "south"}


def _fold(value: str) -> str:
    return value.strip().lower().replace("-", "_").replace(" ", "_")


def coerce(value: object, known: Sequence[str], setting: str, aliases: Mapping[str, str] | None = None) -> str:
    """The known name that value spells: case, outer blanks and -, _ or blank between words do not matter."""
    spelled = {**{_fold(k): k for k in known}, **(aliases or {})}
    if not isinstance(value, str) or _fold(value) not in spelled:
        raise ConfigError(f"unknown {setting} {value!r}; known are {', '.join(sorted({*known, *(aliases or {})}))}")
    return spelled[_fold(value)]


def coerced(column: str | Column, known: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    """coerce() of each label of a column; null where it spells none of the known names."""
    spelled = {**{_fold(k): k for k in known}, **(aliases or {})}
    pairs = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    return F.try_element_at(pairs, F.translate(F.lower(F.trim(col(column))), "- ", "__"))


def unknown_spellings(df: DataFrame, column: str, known: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """value, n of the labels that spell none of the known names; null is no label."""
    return df.where(F.col(column).isNotNull() & coerced(column, known, aliases).isNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
