"""All registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from ledgerlens.plans import benchmark_queries, fact_queries, flag_queries, reader_queries, research_queries, store_queries, text_queries

MODULES = [benchmark_queries, flag_queries, reader_queries, research_queries, text_queries, fact_queries, store_queries, reader_queries]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
