"""Column expressions that every operator shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def clean(c: str | Column) -> Column:
    """The value where it is finite, else null."""
    return F.when(finite(c), col(c).cast("double"))


def yes(condition: Column) -> Column:
    """A condition with null taken as false."""
    return F.coalesce(condition, F.lit(False))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def normalise(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Numbers as double, with NaN and infinities as null: the one form of a missing value."""
    return df.withColumns({c: clean(c) for c in columns})


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def day_of(ts: str | Column = "ts") -> Column:
    return F.to_date(col(ts))


def midnight(day: Column) -> Column:
    """A date as timestamp_ntz; date_trunc would turn it into a zoned one."""
    return day.cast("timestamp_ntz")


def quartiles(c: str | Column) -> list[Column]:
    """Exact quartiles with linear interpolation."""
    c = col(c)
    return [F.percentile(c, q) for q in (0.25, 0.5, 0.75)]
