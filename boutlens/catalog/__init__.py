"""The registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with an equivalent SQL text."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> None:
    from boutlens.catalog import dataset, entities, evaluate, ledger, models, names, scalars, scoring  # noqa: F401
