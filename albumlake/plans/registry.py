"""Queries over the given tables, one or more per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *uses: str):
    """Register a query under its function's name, with DuckDB SQL over the adapters ``uses``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = adapters.sql(" " + oracle, *uses)
        return f

    return add


from . import queries_catalog, queries_search, queries_work  # noqa: E402,F401
