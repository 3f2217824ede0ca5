"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(run):
        key = name or run.__name__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return run

    return add
