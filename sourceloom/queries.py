"""The library's operators as queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from . import queries_code, queries_more, queries_plans, queries_sources, queries_text, queries_varied

_PARTS = (queries_text, queries_code, queries_more, queries_sources, queries_plans, queries_varied)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
