import datetime as dt

from pyspark.sql import functions as F

from factgraph.operators import edges
from factgraph.streaming import jobs as J
from factgraph.streaming import state as S


def files(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_ingest_merges_each_batch_once(spark, tmp_path):
    schema = "content string, source string, src string, rel_type string, dst string, confidence double, day string, episode_id string, snippet string"
    files(spark, tmp_path / "in", [("x", "Fax", "a", "USES", "b", 0.5, "2020-01-01", "e1", "s1")], schema)
    seen = []

    def merge(batch, number):
        merged = edges.upsert_edges(batch, ["day"])
        merged.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        seen.append(number)

    def run():
        stream = J.shape_jobs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        J.run_merge(stream, merge, f"{tmp_path}/checkpoint").awaitTermination()

    run()
    files(spark, tmp_path / "in", [("y", "email", "a", "USES", "b", 0.7, "2020-01-02", "e2", "s2")], schema)
    run()
    run()
    assert len(seen) == len(set(seen)) == 2
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("mention_count")).first()[0] == 2


def test_unseen_within_watermark(spark, tmp_path):
    schema = "ts timestamp, content_hash string"
    at = dt.datetime(2024, 1, 1)
    files(spark, tmp_path / "in", [(at, "a"), (at, "b"), (at + dt.timedelta(hours=1), "a")], schema)
    stream = J.unseen(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["content_hash"])
    q = stream.writeStream.format("memory").queryName("unseen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["content_hash"] for r in spark.table("unseen").collect()) == ["a", "b"]


def test_job_rules(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    started = dt.datetime(2024, 1, 1)
    rows = [(1, "processing", 0, started), (2, "processing", 2, started), (3, "processing", 0, dt.datetime(2024, 1, 1, 0, 9)), (4, "pending", 0, None)]
    got = J.recover(spark.createDataFrame(rows, "id int, status string, retry_count int, started_at timestamp"), now)
    assert sorted((r["id"], r["status"], r["retry_count"]) for r in got.collect()) == [(1, "pending", 1), (2, "dead", 3), (3, "processing", 0), (4, "pending", 0)]


def drained(query):
    query.awaitTermination()


def test_rolling_rates_keep_the_last_rows(spark, tmp_path):
    schema = "key long, ts timestamp, id long, fallbacks long, relations long"
    at = dt.datetime(2024, 1, 1)
    everything = [(0 if i % 5 else i % 2, at + dt.timedelta(seconds=i), i, i % 3, i % 4) for i in range(60)]
    for part in range(3):
        files(spark, tmp_path / "in", everything[part * 20 : part * 20 + 20], schema)
        drained(S.rolling_rates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), f"{tmp_path}/run", 7, block=4))
    got = {r["id"]: (r["rows"], r["rate"]) for r in spark.read.parquet(f"{tmp_path}/run/out").collect()}
    want, seen = {}, {}
    for key, _, i, fallbacks, relations in everything:
        frame = seen[key] = [*seen.get(key, []), (fallbacks, relations)][-7:]
        want[i] = (len(frame), round(sum(f for f, _ in frame) / max(1, sum(r for _, r in frame)), 6))
    assert got == want
    assert S.versions(spark, f"{tmp_path}/run/state", "batch") == [1, 2]


def test_buffer_is_cut_when_full(spark, tmp_path):
    schema = "k string, id long"
    held = []
    for part in range(4):
        new = [("a", part * 10 + i) for i in range(5)] + [(None, part)]
        files(spark, tmp_path / "in", new, schema)
        drained(S.bounded_buffer(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), f"{tmp_path}/run", "k", ["id"], 8, 4))
        held += new
        own = [r for r in held if r[0] == "a"]
        if len(own) > 8:
            held = sorted(own, key=lambda r: -r[1])[:4] + [r for r in held if r[0] is None]
        assert sorted(map(tuple, S.newest_state(spark, f"{tmp_path}/run").collect()), key=repr) == sorted(held, key=repr)


def test_dedupe_keeps_the_first_row(spark, tmp_path):
    schema = "h string, at long, v string"
    for part in ([("x", 2, "b"), ("x", 1, "a")], [("x", 0, "late"), ("y", 5, "c")]):
        files(spark, tmp_path / "in", part, schema)
        drained(S.first_rows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), f"{tmp_path}/run", "h", ["at"]))
    assert sorted(map(tuple, S.first_seen_store(spark, f"{tmp_path}/run", "h").table("seen").select("h", "at", "v").collect())) == [("x", 1, "a"), ("y", 5, "c")]


def test_cursor_takes_each_id_once(spark, tmp_path):
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    make = lambda rows: spark.createDataFrame(rows, "id long, at timestamp")
    until = lambda h: F.lit(hour(h)).cast("timestamp")
    path = str(tmp_path / "cursor")
    first = [(1, hour(1)), (2, hour(5)), (3, hour(5)), (4, hour(9)), (None, hour(2)), (9, None)]
    assert S.advance(make(first), path, "at", "id", until(6)) == 0
    late = [*first, (5, hour(5)), (6, hour(8))]  # one more at the boundary, one within the delay
    assert S.advance(make(late), path, "at", "id", until(6)) == 1
    assert S.advance(make(late), path, "at", "id", until(6)) is None
    make(late).write.parquet(f"{path}/out/version=7")  # a run that failed before its cursor
    assert S.advance(make(late), path, "at", "id", until(10)) == 2
    assert sorted((r["id"], r["version"]) for r in S.taken(spark, path).collect()) == [(1, 0), (2, 0), (3, 0), (4, 2), (5, 1), (6, 2)]
    assert S.advance(make(late), path, "at", "id", until(20)) is None


def test_a_span_of_many_files_is_one_batch(spark, tmp_path):
    """Spans of a log are written by as many tasks as there are, and come oldest first, a batch each."""
    from factgraph.plans import stream_queries
    from factgraph.plans.registry import Tables
    from factgraph.streaming import jobs

    rows = spark.range(40).selectExpr("id", "cast(date_add(date'2024-01-01', cast(id as int)) as timestamp) as ts").repartition(4)
    got, files = {}, 0
    for log in stream_queries._in_parts(Tables(spark, ""), rows, ("2024-01-11", "2024-01-21")):
        jobs.run_merge(log, lambda batch, n: got.update({n: sorted(r["id"] for r in batch.collect())}), str(tmp_path)).awaitTermination()
        files += 1
    assert got == {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 40))} and files == 3
