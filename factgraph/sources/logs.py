"""Append-only logs, snapshots and catalogues as files that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from factgraph.functions import columns as C
from factgraph.functions.sizes import small


def read_jsonl(spark: SparkSession, path: str, schema: str, day: str | None = None) -> DataFrame:
    """Rows of a JSON-lines log; blank and malformed lines are skipped. With a day, only its partition (``date=``) or rows are read."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if day is None else rows.where(F.col("date") == F.lit(day).cast(rows.schema["date"].dataType))


def parse_lines(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """The same for lines that are a column already."""
    parsed = lines.select(F.from_json(column, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def append_jsonl(rows: DataFrame, path: str, day: str = "date") -> None:
    """Appends rows under a folder for each day."""
    rows.write.mode("append").partitionBy(day).json(path)


def save_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Writes one version; a reader takes the newest that is complete (its _SUCCESS file comes last)."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def keep_versions(rows: DataFrame, n: int, by: str = "version") -> DataFrame:
    """Rows of the newest n versions. Versions are counted apart, so no task sorts all rows."""
    kept = rows.select(by).distinct().orderBy(F.desc(by)).limit(n)
    return rows.join(F.broadcast(kept), by, "left_semi")


def capped_log(rows: DataFrame, order: list[Column], above: int = 10_000, keep: int = 8_000) -> DataFrame:
    """The newest ``keep`` rows once there are more than ``above``: the cap is the feature.

    The cut is one row found by a top-k, not a window over the log.
    """
    if rows.count() <= above:
        return rows
    return rows.orderBy(*order).limit(keep)


def archive(spark: SparkSession, rows: DataFrame, path: str, cutoff: Column, day: str = "date") -> DataFrame:
    """Writes rows of days before the cutoff as gzip JSON, leaving out days that the archive has; returns the days written."""
    old = rows.where(F.col(day) < cutoff)
    days = old.select(day).distinct()
    try:
        days = days.join(spark.read.json(path).select(F.col(day).cast("date").alias(day)).distinct(), day, "left_anti")
    except AnalysisException:  # no archive yet
        pass
    fresh = old.join(small(days), day, "left_semi")
    written = [r[0] for r in days.collect()]
    fresh.where(F.col(day).isin(written)).write.mode("append").option("compression", "gzip").partitionBy(day).json(path)
    return spark.createDataFrame([(d,) for d in written], f"{day} date")


def type_catalogue(rows: DataFrame) -> DataFrame:
    """Types of (name, description, threshold): normalised names, thresholds within 0 and 1 (0.5 if missing), first of each name; empty names go."""
    name = F.lower(F.regexp_replace(F.trim("name"), r"\s+", "_"))
    clean = rows.select("pos", name.alias("name"), F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.concat(F.lit("type "), name)).alias("description"), C.clamp(F.col("threshold"), default=0.5).alias("threshold"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    return clean.where("name <> ''").withColumn("rank", first).where("rank = 1").drop("rank", "pos")


def submit_jobs(rows: DataFrame, at: Column) -> DataFrame:
    """Job rows of (content, source, speaker, priority): pending, no retries, stamped."""
    return rows.select(F.sha2(F.concat_ws("|", "content", "source", "speaker"), 256).alias("id"), "content", C.normal_source(F.col("source")).alias("source"), "speaker", F.coalesce("priority", F.lit(0)).alias("priority"), at.alias("reference_time"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))
