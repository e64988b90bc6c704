"""Where queries over the driver's tables are registered, each with its oracle if SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import duckdb_sql, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, oracle: str | None = None):
    """Register a function of DataFrames, which gets the named views, and the oracle, which may read any view."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(spark_view(spark, sf_dir, v) for v in views.split()))
        if oracle:
            ORACLES[name] = duckdb_sql(oracle)
        return f

    return add
