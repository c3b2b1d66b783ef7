"""Every named query and the SQL it must equal."""

from __future__ import annotations

from . import account_queries, provider_queries, record_queries, rule_queries, stream_queries, usage_queries, view_queries  # noqa: F401  each registers its queries

QUERIES = usage_queries.QUERIES
ORACLE_SQL = usage_queries.ORACLE_SQL
