"""All queries of the core and their SQL twins."""

from __future__ import annotations

from sievework.plans import analytics, documents, inspection, learning, p7

_PARTS = (analytics, documents, inspection, learning, p7)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in _PARTS for name, q in part.SQL.items()}
