"""All queries of the core."""

from __future__ import annotations

from gleanframe.plans import catalog, dealt, library, streams

_PARTS = (dealt, catalog, library, streams)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
