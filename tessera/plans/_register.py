"""How queries and their SQL are put into the registry."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function under ``name``, with its SQL for the second engine."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put
