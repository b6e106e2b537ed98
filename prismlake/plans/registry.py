"""Registers a query with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.catalog import Catalog, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers f(catalog) -> DataFrame under its name; sql names adapters and source tables."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Catalog(spark, folder))
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return register
