"""Registry of runnable queries: a Spark callable per key and, where SQL can say it, the check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantmetrics.plans.oracle import with_views
from plantmetrics.session import configure
from plantmetrics.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(star) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Star], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Star(configure(spark), folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register
