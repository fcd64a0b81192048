"""Registry that keeps every query next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from weirspan.bindings import Tables, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``Tables -> DataFrame`` function, with the SQL giving the same rows where there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql:
            CHECKS[name] = check_sql(dedent(sql))
        return fn

    return register
