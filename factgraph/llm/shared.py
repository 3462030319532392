"""Places and small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions.places import new_path, written

__all__ = ["LOWER", "SPACES", "UPPER", "lower_ascii", "new_path", "sized", "table", "written"]

#: The six characters that count as white space between words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sized(spark: SparkSession, rows: int, each: int = 100_000) -> int:
    """Tasks for a known number of small rows: ``each`` rows a task, and all cores in any case."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


