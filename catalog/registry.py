"""Query registration and shared SQL fragments (CTEs) of the oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, body: str, needs: list[str] | None = None) -> None:
    CTES[name] = (needs or [], body)


def with_ctes(sql: str, needs: list[str]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS {'' if 'UNION' in CTES[n][1] else 'MATERIALIZED '}(\n{CTES[n][1]}\n)" for n in order) + "\n" + sql


def query(name: str, sql: str | None = None, needs: list[str] | None = None):
    """Register a query and, where SQL can state it, its oracle."""
    def register(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, needs or [])
        return fn
    return register
