"""All queries of the reference's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import catalog_queries, geometry_queries, series_queries, source_queries

_PARTS = (catalog_queries, series_queries, geometry_queries, source_queries)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
