"""The registered queries: each runs operators over the given tables; most have an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query function under a name, with its SQL where there is one."""
    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    """Import the query modules."""
    from foliant.catalogue import building, documents, history, searching, stored  # noqa: F401
