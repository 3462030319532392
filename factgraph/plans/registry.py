"""Registration of queries beside their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Driver tables and the model tables made of them, by attribute: ``t.lineitem``, ``t.edges``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of Tables. sql may name model tables; they are added to it as common table expressions."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = fixtures.with_models(sql)
        return f

    return add
