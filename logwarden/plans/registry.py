"""All registered queries and their checking SQL."""

from __future__ import annotations

from logwarden.plans import (
    oracle_files, oracle_logs, oracle_models, oracle_stats, oracle_text, queries_files, queries_logs, queries_models, queries_stats, queries_text,
)

_MODULES = (
    (queries_logs.QUERIES, oracle_logs.ORACLE),
    (queries_files.QUERIES, oracle_files.ORACLE),
    (queries_text.QUERIES, oracle_text.ORACLE),
    (queries_stats.QUERIES, oracle_stats.ORACLE),
    (queries_models.QUERIES, oracle_models.ORACLE),
)


def queries() -> dict:
    return {name: build for built, _ in _MODULES for name, build in built.items()}


def oracle_sql() -> dict:
    names = queries()
    return {name: sql for _, checks in _MODULES for name, sql in checks.items() if name in names}
