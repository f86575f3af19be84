"""Collects the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deckloom.plans.fixtures import check_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Attribute access to the tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", ctes: str = "", final: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``final`` is the checking SQL, if there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if final is not None:
            CHECKS[name] = check_sql(views, ctes, final)
        return fn

    return wrap
