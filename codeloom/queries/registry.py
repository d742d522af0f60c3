"""All queries of the engine by name, with the SQL that each must agree with."""

from __future__ import annotations

from codeloom.queries import code_queries, row_queries, text_queries

_MODULES = (text_queries, code_queries, row_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
