"""All queries of the library and their SQL."""

from __future__ import annotations

from codonloom.plans import character_queries, format_queries, model_queries, sampling_queries, trace_queries, tree_queries

MODULES = (character_queries, tree_queries, model_queries, trace_queries, format_queries, sampling_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
