"""Stages that keep whole rows, on tables with many and oddly named columns."""

import numpy as np
from pyspark.sql import functions as F

from factgraph.llm import decontaminate, line_dedup, quality, simhash


def test_rows_come_through_whole(spark):
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey"))), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.col("id"), F.lit(1).alias("row"), F.lit("x").alias("odd name"), F.array(F.lit(1)).alias("a-b"), F.struct(F.lit(1).alias("c d")).alias("s"), F.lit(None).cast("timestamp").alias("score"), *(F.lit(i).alias(f"n{i}") for i in range(40)))
    model = quality.fit(np.zeros((1, len(quality.FEATURES))), np.array([True]))
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    for out, n in ((quality.keep_good(docs, model), 6), (decontaminate.decontaminate(docs, benchmark), 4), (simhash.near_dedup(docs), 3)):
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() == n
    carried = line_dedup.dedup_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    assert carried.count() == 6 and len(carried.columns) == len(docs.columns) - 1 + 3
