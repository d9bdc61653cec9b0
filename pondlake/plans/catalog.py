"""Registry of named queries: each is ``(spark, sf_dir) -> DataFrame`` over the
given test tables, with an equivalent DuckDB SQL text where one exists.

``QUERIES`` / ``ORACLE`` are filled by the modules that define the operators'
query forms (``plans.queries_*``), so the driver entry only imports this.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query under ``name``; ``sql`` is its DuckDB oracle."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


MODULES = ("queries_series", "queries_large", "queries_crosspond", "queries_drift", "queries_ingest", "queries_files",
           "queries_learn")


def load_all() -> None:
    """Import every query module; their ``@register`` decorators fill the registry."""
    import importlib
    import importlib.util
    for mod in MODULES:
        name = f"pondlake.plans.{mod}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
