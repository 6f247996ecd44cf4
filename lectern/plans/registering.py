"""How a module of queries lists them."""

from __future__ import annotations


def area() -> tuple[dict, dict[str, str], object]:
    """A table of queries, one of their SQL, and the decorator that fills both."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
