"""All queries over the fixture tables, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_views

_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of the tables under its name, with the SQL of the same result."""

    def keep(f: Callable[[Tables], DataFrame]):
        _QUERIES[name or f.__name__] = f, sql
        return f

    return keep


def _loaded() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    from . import queries_graph, queries_retrieval, queries_text  # noqa: F401

    return _QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _loaded().items() if sql}
