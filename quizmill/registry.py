"""Every query of the library by name, with the same query as SQL for DuckDB.

Queries whose result depends on a fold that SQL cannot express have no SQL;
tests hold those against fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quizmill.sources.tables import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; ``sql`` may use the exam views and continues their WITH list."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = SQL_VIEWS + sql
        return f

    return register
