"""Every query of the library by name, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Callable, sql: str | None = None) -> None:
    assert name not in _QUERIES, name
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = sql


def queries() -> dict[str, Callable]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES
