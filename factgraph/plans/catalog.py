"""All registered queries of the graph operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from factgraph.plans.registry import ORACLE, QUERIES

for _part in ("graph_queries", "retrieval_queries", "shape_queries", "metric_queries", "curation_queries", "stream_queries", "maintenance_queries"):
    import_module(f"factgraph.plans.{_part}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["j5_current_facts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
