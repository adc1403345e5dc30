"""Every query of the engine by name, and the SQL that states the same result."""

from __future__ import annotations

from .plans import assessment, oracle, queries, surfaces

QUERIES = queries.QUERIES | assessment.QUERIES | surfaces.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | assessment.ORACLE_SQL | surfaces.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
