"""Where queries register themselves, with SQL that makes the same rows."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put
