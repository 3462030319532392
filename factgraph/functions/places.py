"""Tables in the folder that driver and executors share, and row numbers that need no task to hold a whole group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir (or the context's checkpoint folder); ``clear`` removes it.

    Where neither is set a temporary folder serves, but only with a local master: elsewhere executors couldn't see it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = context._jsc.sc().getCheckpointDir()
        if not set_dir.isEmpty():
            found = set_dir.get()
        elif context.master.split("[")[0] == "local":
            found = _LOCAL.get(context.applicationId) or _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/tables-{context.applicationId}"


#: Paths given out inside each open ``scoped`` block.
_SCOPES: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here and Spark knows the table's true size."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """df without repeated rows as a table in the shared folder, in buckets of a key, as many as the session deals to.

    It is dealt once, here: joins on the key read it where it is. On the key and other columns they do so too if the other
    side is dealt by its key first (``dealt_like``) and they run inside ``met_by_part``.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    parts, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, key).distinct().write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def dealt_like(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key as ``written_by`` deals."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def met_by_part(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside the block take sides that are dealt alike by a part of their keys as they are."""
    before = spark.conf.get(_CO_PARTITION, "true")
    spark.conf.set(_CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(_CO_PARTITION, before)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block go when it ends: for what is written elsewhere, or counted, before it does."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Removes all tables of this application, once the results that read them are no longer needed."""
    _remove(spark, shared_dir(spark))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """rows with their number (from 1) within each group in an order that has no ties, however large a group is.

    Rows are dealt by ranges of (group, order) and written, so that the parts stay what they are; rows of the parts
    before are counted, and only within a part are rows numbered by a window.
    """
    part = [*by, "part"]
    dealt = rows.repartitionByRange(*(F.asc_nulls_first(c) for c in by), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "numbered")
    sizes = dealt.groupBy(*part).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("part")) - F.col("size")
    # only the first group of a part can have rows in parts before it: a row a part at most
    offsets = sizes.select(*(F.col(c).alias(f"of_{c}") for c in part), before.alias("before")).where("before > 0")
    same = F.lit(True)
    for c in part:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return dealt.withColumn(name, within).join(F.broadcast(offsets), same, "left").withColumn(name, F.coalesce("before", F.lit(0)) + F.col(name)).select(*rows.columns, name)


def carried(rows: DataFrame, by: list[str], order: list[Column], total: str | None = None, last: str | None = None) -> DataFrame:
    """rows with so_far (running sum of ``total``, the row included) and previous (``last`` of the row before), however large a group is.

    Rows are dealt by ranges of (group, order) and written; each part has a row for each of its groups with its sum and
    its last value, from which the sum and the value before every part follow; only within a part do windows run. Rows
    that tie in order have no order among themselves.
    """
    part = [*by, "part"]
    dealt = rows.repartitionByRange(*(F.asc_nulls_first(c) for c in by), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "carried")
    within = Window.partitionBy(*part).orderBy(*order)
    of = [F.col(c).alias(f"of_{c}") for c in part]
    parts = Window.partitionBy(*(by or [F.lit(1)])).orderBy("part")  # a row for each group and part
    same = F.lit(True)
    for c in part:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    out = dealt
    if total:
        sums = dealt.groupBy(*part).agg(F.sum(total).alias("size"))
        offsets = sums.select(*of, (F.sum("size").over(parts) - F.col("size")).alias("before"))
        out = out.withColumn("so_far", F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, 0))).join(offsets.hint("merge"), same).withColumn("so_far", F.col("before") + F.col("so_far")).select(*dealt.columns, "so_far")
    if last:
        ends = dealt.withColumn("place", F.row_number().over(within)).groupBy(*part).agg(F.max_by(F.struct(F.col(last).alias("v")), "place").alias("end"))
        ends = ends.select(*of, F.lag("end").over(parts).alias("before"))
        held = out.withColumn("place", F.row_number().over(within)).withColumn("near", F.lag(last).over(within)).join(ends.hint("merge"), same)
        out = held.withColumn("previous", F.when(F.col("place") == 1, F.col("before")["v"]).otherwise(F.col("near")))
    return out.select(*rows.columns, *(["so_far"] if total else []), *(["previous"] if last else []))
