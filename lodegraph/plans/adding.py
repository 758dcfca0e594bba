"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def adder() -> tuple[dict, dict, Callable]:
    """Queries, their DuckDB oracles, and ``add(name, sql)`` to decorate a query with (an empty ``sql``: no oracle)."""
    queries, oracles = {}, {}

    def add(name: str, sql: str):
        def keep(f):
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return keep

    return queries, oracles, add
