"""Registry of the named queries and of the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

MODULES = ("integrity", "code", "vectors", "stores", "maintenance")


def registry() -> tuple[dict, dict]:
    """All core queries and their SQL, by name."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"quern.queries.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
