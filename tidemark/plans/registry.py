"""Queries and oracle SQL of the time-series operators, by name."""

from __future__ import annotations

from . import queries_axis, queries_runs, queries_scores, queries_sources

QUERIES = {**queries_axis.QUERIES, **queries_scores.QUERIES, **queries_runs.QUERIES, **queries_sources.QUERIES}
ORACLES: dict[str, str] = {**queries_axis.ORACLES, **queries_scores.ORACLES, **queries_runs.ORACLES, **queries_sources.ORACLES}
