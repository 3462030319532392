"""Continuous forms: ingest, counters, windows, deduplication and job states as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from factgraph.functions import columns as C

STUCK_SECONDS, MAX_RETRIES, KEEP_DAYS = 300, 3, 7


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that process for over five minutes go back to pending, to dead at the retry limit."""
    stuck = (F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("started_at") > STUCK_SECONDS)
    again = F.col("retry_count") + 1
    status = F.when(stuck & (again >= MAX_RETRIES), "dead").when(stuck, "pending").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "retry_count": F.when(stuck, again).otherwise(F.col("retry_count"))})


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The next jobs of a micro-batch: priority, then age."""
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(n)


def retained(jobs: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Jobs without those that ended over a week ago."""
    return jobs.where(F.col("completed_at").isNull() | (F.datediff(now, F.col("completed_at")) <= days))


def daily_counters(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Counters by tumbling day; late rows count until the watermark passes."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def weekly_counters(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tumbling weeks that begin on a Monday (the epoch was a Thursday)."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "7 days", "7 days", "4 days")).agg(F.count("*").alias("n"))


def signal_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").count()


def unseen(events: DataFrame, keys: list[str], watermark: str = "24 hours") -> DataFrame:
    """Rows whose key was not seen within the watermark: the incremental cursor and the content-hash dedupe."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def run_merge(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Ingest: shaping before this, one merge a micro-batch, progress in the checkpoint; a replayed batch has the same number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shape_jobs(stream: DataFrame) -> DataFrame:
    """Stateless part of ingest: content hash, preview, source."""
    return stream.select("*", F.substring(F.sha2("content", 256), 1, 32).alias("content_hash"), F.substring("content", 1, 500).alias("preview"), C.normal_source(F.col("source")).alias("normal_source"))
