"""Queries and SQL of the training-data problems."""

from __future__ import annotations

from gleanframe.llm import dedup_queries, mixing_queries, packing_queries, quantile_queries, subject_queries

_PARTS = (dedup_queries, quantile_queries, packing_queries, mixing_queries, subject_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
