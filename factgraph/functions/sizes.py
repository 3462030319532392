"""Broadcasts behind a check of size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be sent to every task.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to have few rows, else with a hint to meet by sorting.

    The proof is a count that stops at the bound; equi-joins then fall back to a shuffle, whatever Spark estimates.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def blocks(df: DataFrame, key: str, rows: int = SMALL_ROWS) -> list[DataFrame]:
    """df in blocks of about ``rows`` rows each, by a hash of the key: for conditions that no equi-join can serve, one pass a block."""
    n = -(-df.count() // rows)
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


def containing(rows: DataFrame, texts: list[Column], queries: DataFrame, q: Column, key: str) -> DataFrame:
    """rows joined with the queries that one of the texts contains, case ignored.

    A query of three characters or more meets the rows by its first three: a row brings only those of its trigrams
    that some query begins with. Shorter queries have no such key and take one pass a block of them.
    """
    asked = queries.withColumn("_q", F.lower(q))
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in texts]
    holds = reduce(lambda a, b: a | b, (c.contains(F.col("_q")) for c in low))
    long = asked.where(F.length("_q") >= 3).withColumn("_gram", F.substring("_q", 1, 3))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))
    keyed = rows.withColumn("_gram", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, low))))))
    keyed = keyed.join(small(long.select("_gram").distinct()), "_gram", "left_semi")
    met = keyed.join(small(long), "_gram").where(holds).drop("_gram", "_q")
    short = [rows.join(F.broadcast(part), holds).drop("_q") for part in blocks(asked.where(F.length("_q") < 3), key)]
    return reduce(DataFrame.unionByName, [met, *short])
