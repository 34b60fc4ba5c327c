"""Registered queries of the line operators with their DuckDB twins."""

from linemill.catalog import contracts, lines, shapes  # noqa: F401  (they register their queries)
from linemill.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
