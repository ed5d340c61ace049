"""Registered queries of the core library."""

from __future__ import annotations

from . import file_queries, rule_queries, search_queries, table_queries, text_queries

_MODULES = (text_queries, table_queries, search_queries, file_queries, rule_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
