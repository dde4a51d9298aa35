"""Pairs each registered query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.views import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", body: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its own name, with SQL over the views."""
    def register(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if body is not None:
            ORACLES[name] = sql(views, body)
        return fn

    return register
