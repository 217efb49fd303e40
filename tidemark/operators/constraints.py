"""Constraints on the rows of a table, as a table of what breaks them.

A rule is a condition on a row's own columns; all rules are looked at in one scan. What a row alone cannot tell (a key
that is not unique) is a rule on groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import yes


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where broken holds (null is no breach); value is what it then shows."""

    name: str
    field: str
    broken: Column
    value: Column


def violations(df: DataFrame, key: str, rules: Sequence[Rule], unique: bool = True) -> DataFrame:
    """key, rule, field, value of each breach; with unique, a key that several rows have is a breach a row."""
    struct = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.field).alias("field"), r.value.cast("string").alias("value"))
    broken = F.filter(F.array(*[F.when(yes(r.broken), struct(r)) for r in rules]), lambda x: x.isNotNull())
    out = df.select(F.col(key).alias("key"), F.explode(broken).alias("b")).select("key", "b.*")
    if unique:
        repeated = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
        again = repeated.select("key", F.lit("repeated").alias("rule"), F.lit(key).alias("field"), F.col("n").cast("string").alias("value"), F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        out = out.unionByName(again.drop("col"))
    return out


def describe(found: DataFrame, key: str = "key", most: int = 3) -> list[str]:
    """A text for each rule that is broken: how often, and its first keys."""
    per = found.groupBy("rule", "field").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.coalesce(F.col(key).cast("string"), F.lit("(none)")))), 1, most).alias("keys"))
    return [f"{r['field']} {r['rule']}: {r['n']} rows, such as {', '.join(r['keys'])}" for r in per.orderBy("field", "rule").collect()]
