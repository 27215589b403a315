"""The registered queries over the audit operators, and the same results in SQL."""

from . import text_queries, trace_queries, vector_queries

QUERIES: dict = text_queries.Q | vector_queries.Q | trace_queries.Q
ORACLE_SQL: dict[str, str] = text_queries.SQL | vector_queries.SQL | trace_queries.SQL
