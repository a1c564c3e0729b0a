"""Registration of queries with their SQL."""

from __future__ import annotations


def collector():
    """(queries, oracle_sql, query): two empty tables, and the decorator that fills them."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return keep

    return queries, oracle, query
