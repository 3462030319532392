"""Streams and runs whose state is a table: what a batch leaves is written beside its output, under its number.

A batch reads the state that the batch before it left, so that a batch played again gives the same and overwrites what
it wrote. Keys are never gathered: a batch is a set of rows like any other, and a hot key is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from factgraph.functions.places import written
from factgraph.operators.metrics import rolling_health
from factgraph.sources.graph_store import GraphStore

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame | None, DataFrame]]


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str, by: str) -> list[int]:
    """Numbers of the complete folders ``by=…`` at a path."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    found = [str(x.getPath()) for x in files.listStatus(folder)]
    whole = [f for f in found if f"/{by}=" in f and files.exists(_folder(spark, f"{f}/_SUCCESS")[1])]
    return sorted(int(f.rsplit("=", 1)[1]) for f in whole)


def run_steps(stream: DataFrame, path: str, step: Step) -> StreamingQuery:
    """step(batch, state) for each micro-batch gives its output and the state that it leaves; states before the last two go."""
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        before = [v for v in versions(spark, f"{path}/state", "batch") if v < number]
        state = spark.read.parquet(f"{path}/state/batch={before[-1]}") if before else None
        out, left = step(written(batch, "batch"), state)
        if out is not None:
            out.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        left.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        for old in before[:-1]:
            files, folder = _folder(spark, f"{path}/state/batch={old}")
            files.delete(folder, True)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def newest_state(spark: SparkSession, path: str) -> DataFrame:
    """The state that the last batch of a run left."""
    return spark.read.parquet(f"{path}/state/batch={versions(spark, f'{path}/state', 'batch')[-1]}")


def rolling_rates(stream: DataFrame, path: str, size: int = 50, block: int = 100_000) -> StreamingQuery:
    """(key, id, rows, rate) of rows (key, ts, id, fallbacks, relations) as they come, over the last ``size`` of their key.

    Rows go by batch, then by ts and id (without ties). The state is the last size - 1 rows of each key; a key's rows
    of one batch are cut into blocks that carry so many rows over, so no task holds them all.
    """

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = batch.select("key", "ts", "id", "fallbacks", "relations")
        both = new.withColumn("batch", F.lit(1)) if state is None else new.withColumn("batch", F.lit(1)).unionByName(state.withColumn("batch", F.lit(0)))
        rates = rolling_health(both.withColumnRenamed("key", "epoch"), size, block=block, order=["batch", "ts", "id"])
        newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("batch"), F.desc("ts"), F.desc("id")))
        left = both.withColumn("back", newest).where(F.col("back") < size).drop("back", "batch")
        return rates.where("batch = 1").select(F.col("epoch").alias("key"), "id", "rows", "rate"), left

    return run_steps(stream, path, step)


def bounded_buffer(stream: DataFrame, path: str, key: str, order: list[str], most: int = 10_000, keep: int = 5_000) -> StreamingQuery:
    """Rows of each key as a buffer: over ``most`` of them after a batch, the newest ``keep`` stay. The state is the buffer."""

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[None, DataFrame]:
        both = written(batch if state is None else batch.unionByName(state), "buffer")
        over = both.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col(key).alias("_of"))
        same = F.col(key).eqNullSafe(F.col("_of"))
        newest = F.row_number().over(Window.partitionBy(key).orderBy(*map(F.desc, order)))
        cut = both.join(over.hint("merge"), same, "left_semi").withColumn("_back", newest).where(F.col("_back") <= keep).drop("_back")
        return None, both.join(over.hint("merge"), same, "left_anti").unionByName(cut)

    return run_steps(stream, path, step)


def first_rows(stream: DataFrame, path: str, key: str, order: list[str]) -> StreamingQuery:
    """Deduplication that keeps the row: the first row of each key, of the first batch that holds it, by an order.

    Keys seen are a stored table of segments, so a batch writes its own keys only.
    """
    spark = stream.sparkSession
    store = first_seen_store(spark, path, key)

    def one(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(key).agg(F.min_by(F.struct(*(c for c in batch.columns if c != key)), F.struct(*order)).alias("row"))
        store.commit(number, {"seen": first.select(key, "row.*")})

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def first_seen_store(spark: SparkSession, path: str, key: str) -> GraphStore:
    """The table that first_rows keeps, as ``seen``."""

    def merge(states: DataFrame) -> DataFrame:
        others = [c for c in states.columns if c not in (key, "version")]
        return states.groupBy(key).agg(F.min_by(F.struct(*others), "version").alias("row")).select(key, "row.*")

    return GraphStore(spark, f"{path}/store", {"seen": merge})


def advance(rows: DataFrame, path: str, ts: str, key: str, until: Column) -> int | None:
    """One run of a cursor over rows that may still grow: writes the rows that are new up to an instant, as the next version.

    The cursor is a table: the greatest instant taken so far and the keys taken at it. Rows at that instant that came
    later are taken by the next run, those taken before are not taken again; until (now less the delay of late rows)
    keeps instants back that may still get rows. The output comes first, the cursor last: a run that failed is made
    again and overwrites its output. Returns the version, None if nothing was new. Keys at one instant are one run's
    rows at most, and meet by a join.
    """
    spark = rows.sparkSession
    known = versions(spark, f"{path}/cursor", "version")
    new = rows.where(F.col(ts).isNotNull() & F.col(key).isNotNull() & (F.col(ts) <= until))
    if known:
        cursor = spark.read.parquet(f"{path}/cursor/version={known[-1]}")
        at = F.broadcast(cursor.agg(F.max("_at").alias("_last")))
        taken = cursor.select(F.col("_key").alias("_taken"))
        later = new.crossJoin(at)
        tied = later.where(F.col(ts) == F.col("_last")).join(taken.hint("merge"), F.col(key) == F.col("_taken"), "left_anti")
        new = later.where(F.col(ts) > F.col("_last")).unionByName(tied).drop("_last")
    number = known[-1] + 1 if known else 0
    new.write.mode("overwrite").parquet(f"{path}/out/version={number}")
    out = spark.read.schema(new.schema).parquet(f"{path}/out/version={number}")
    last = out.agg(F.max(ts).alias("_at"))
    if last.first()[0] is None:
        return None
    ends = out.join(F.broadcast(last), F.col(ts) == F.col("_at")).select("_at", F.col(key).alias("_key"))
    if known:  # an instant that goes on keeps the keys taken before
        ends = ends.unionByName(cursor.join(F.broadcast(last.withColumnRenamed("_at", "_now")), F.col("_at") == F.col("_now"), "left_semi").select("_at", "_key"))
    ends.write.mode("overwrite").parquet(f"{path}/cursor/version={number}")
    return number


def taken(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the runs of a cursor have taken, each once, with the version that took them."""
    known = versions(spark, f"{path}/cursor", "version")
    parts = spark.read.option("basePath", f"{path}/out").parquet(*(f"{path}/out/version={v}" for v in known))
    return parts
