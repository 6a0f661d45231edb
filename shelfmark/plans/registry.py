"""Registry of queries: functions of a Library under their names, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Library, with_tables

QUERIES: dict[str, Callable[[Library], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a function of a Library under its name, with its SQL over the named logical tables."""

    def put(f: Callable[[Library], DataFrame]):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import composites, media, queries  # noqa: F401  (they register themselves)

    return {name: (lambda spark, sf_dir, f=f: f(Library(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
