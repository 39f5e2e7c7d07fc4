"""Registered queries and the SQL that states them for another engine."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its SQL where there is one; a name can be taken once."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}: {QUERIES[f.__name__].__module__} and {f.__module__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
