"""All registered queries of the library and their SQL."""

from __future__ import annotations

from weftline import chain_queries, queries

QUERIES = queries.QUERIES | chain_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | chain_queries.ORACLE_SQL
