"""All named queries of the engine, and the SQL that states the same results."""

from __future__ import annotations

from vellum.plans import account_queries, file_queries, page_queries, rule_queries, service_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **account_queries.QUERIES, **service_queries.QUERIES, **rule_queries.QUERIES, **file_queries.QUERIES, **page_queries.QUERIES}
ORACLE_SQL: dict = {**text_queries.SQL, **account_queries.SQL, **service_queries.SQL, **rule_queries.SQL, **file_queries.SQL, **page_queries.SQL}
