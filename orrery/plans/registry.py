"""All queries of the engine by name, with their SQL for cross-checking.

A query function takes (spark, sf_dir) and returns a DataFrame; `query` registers it under its name. The modules that
hold them are imported when QUERIES or ORACLE is first asked for, so each of them can be imported on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_FOUND: dict[str, dict] = {"QUERIES": {}, "ORACLE": {}}
MODULES = ("risk", "indicators", "news", "graphs", "retrieval", "store", "alerting", "portfolios", "events", "scoring", "lookup", "outlook", "documents", "models")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        _FOUND["QUERIES"][f.__name__] = f
        if sql:
            _FOUND["ORACLE"][f.__name__] = sql
        return f

    return register


def __getattr__(name: str) -> dict:
    if name not in _FOUND:
        raise AttributeError(name)
    for m in MODULES:
        import_module(f"orrery.plans.{m}_queries")
    return _FOUND[name]
