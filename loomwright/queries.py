"""All registered queries over the given tables, and the SQL that they are held against."""

from __future__ import annotations

from .plans import aggregates, events, filters, graphs, joins, payloads, scalars, series, state, terms, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
