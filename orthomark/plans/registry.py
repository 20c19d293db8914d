"""Registration of runnable queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthomark.plans import fixture_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Attribute access to the tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture_views.view(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` sees the named views."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fixture_views.with_views(views, sql, recursive)
        return fn

    return register
