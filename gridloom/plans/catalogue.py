"""All queries of the engine, and the SQL of those that SQL can express."""

from __future__ import annotations

from gridloom.plans import check_queries, design_queries, queries, source_queries, table_queries

QUERIES = queries.QUERIES | table_queries.QUERIES | check_queries.QUERIES | design_queries.QUERIES | source_queries.QUERIES
ORACLES = queries.ORACLES | table_queries.ORACLES | check_queries.ORACLES | design_queries.ORACLES | source_queries.ORACLES
