"""Batches into a stored graph: replays, supersession, episodes, the second pass and the speaker."""

import pytest
from pyspark.sql import functions as F

from factgraph.operators import edges as E
from factgraph.operators import ingest

M = "episode_id string, pos int, name string, entity_type string, confidence double, source string, day string"
R = "episode_id string, pos int, head string, tail string, label string, score double, source string, snippet string, day string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("day", F.to_date("day"))


@pytest.fixture
def store(spark, tmp_path):
    store = ingest.graph_store(spark, str(tmp_path / "g"))
    entities = spark.createDataFrame([("C1", "Alice Example", "Person", "Ally", 0.5, 2, "2020-01-01", "2020-02-01"), ("S1", "Acme Corporation", "Organization", "Acme", 0.6, 1, "2020-01-01", "2020-02-01")], "id string, name string, entity_type string, alias string, confidence double, mention_count long, first_day string, last_day string").withColumns({c: F.to_date(c) for c in ("first_day", "last_day")})
    edges = spark.createDataFrame([("C1", "WORKS_AT", "S1", 0.9, 3, "2020-01-01", "2020-02-01", None, None)], "src string, rel_type string, dst string, confidence double, mention_count long, valid_from string, last_day string, valid_to string, audit_status string").withColumns({c: F.to_date(c) for c in ("valid_from", "last_day", "valid_to")})
    store.commit(0, {"entities": E.entity_state(entities), "edges": E.edge_state(edges)})
    return store


def batch(spark):
    mentions = [("e1", 0, "Ally", "Person", 0.9, "session", "2021-05-01"), ("e1", 1, "Globex", "Organization", 0.8, "session", "2021-05-01"), ("e2", 0, "Nobody Known", "Person", 0.1, "session", "2021-05-01"), ("e2", 1, "Acme", "Organization", 0.9, "session", "2021-05-02")]
    relations = [("e1", 0, "Ally", "Globex", "works at", 0.9, "session", "s1", "2021-05-01"), ("e2", 0, "Nobody Known", "Acme", "works at", 0.1, "session", "s2", "2021-05-02")]
    return frame(spark, mentions, M), frame(spark, relations, R)


def facts(store):
    return {(r["src"], r["dst"]): (r["mention_count"], str(r["valid_from"]), str(r["valid_to"])) for r in store.table("edges").collect()}


def test_a_newer_fact_closes_the_one_before(spark, store):
    ingest.ingest_into(store, 0, *batch(spark))
    assert facts(store) == {("C1", "S1"): (3, "2020-01-01", "2021-05-01"), ("C1", "globex"): (1, "2021-05-01", "None")}
    assert {(r["id"], r["mention_count"]) for r in store.table("entities").collect()} == {("C1", 3), ("S1", 2), ("globex", 1)}
    assert {r["episode_id"]: (r["incomplete"], r["n_mentions"], r["n_relations"]) for r in store.table("episodes").collect()} == {"e1": (False, 2, 1), "e2": (False, 1, 0)}
    assert {r["id"] for r in store.table("vectors").collect()} == {"C1", "S1", "globex"} and all(len(r["embedding"]) == 64 for r in store.table("vectors").collect())
    assert facts(store) == facts(store) and ingest.incomplete_episodes(store).count() == 0


def test_a_replayed_batch_changes_nothing_and_a_failed_one_shows(spark, store, monkeypatch):
    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, "shape_batch", fails)
        with pytest.raises(RuntimeError):
            ingest.ingest_into(store, 0, *batch(spark))
    assert sorted(r[0] for r in ingest.incomplete_episodes(store).collect()) == ["e1", "e2"]
    assert facts(store) == {("C1", "S1"): (3, "2020-01-01", "None")}
    assert ingest.ingest_into(store, 0, *batch(spark)) is not None
    before = facts(store)
    assert ingest.ingest_into(store, 0, *batch(spark)) is None
    assert facts(store) == before and ingest.incomplete_episodes(store).count() == 0
    assert facts(store)["C1", "S1"][2] == "2021-05-01"


def test_speaker_and_second_pass(spark, store):
    mentions, relations = batch(spark)
    spoken = relations.withColumn("speaker", F.lit("Alice Example"))
    spoken = spoken.withColumn("head", F.when(F.col("episode_id") == "e1", "I").otherwise(F.col("head")))
    mentions = mentions.unionByName(frame(spark, [("e1", 5, "Alice Example", "Person", 1.0, "session", "2021-05-01"), ("e1", 6, "I", "Person", 1.0, "session", "2021-05-01")], M))
    got = ingest.shape_batch(mentions, spoken, store.table("entities"))
    assert [(r["src"], r["dst"]) for r in got.observed.collect()] == [("C1", "globex")]
    second = frame(spark, [("e1", 0, "Ally", "Globex", "employed by", 0.95, "session", "s9", "2021-05-01")], R)
    labels = spark.createDataFrame([("works at",)], "canonical string")
    got = ingest.shape_batch(batch(spark)[0], relations, store.table("entities"), second, labels)
    assert [(r["src"], r["rel_type"], r["dst"], r["snippet"]) for r in got.observed.collect()] == [("C1", "WORKS_AT", "globex", "s9")]


def test_no_rows(spark, store):
    ingest.ingest_into(store, 0, frame(spark, [], M), frame(spark, [], R))
    assert facts(store) == {("C1", "S1"): (3, "2020-01-01", "None")}


def test_a_batch_is_dealt_once_by_episode(spark, store, monkeypatch):
    """Both ends and the first of each triple come of one deal of the relations, which are read when they are gated alone."""
    plans, keep = {}, ingest.written
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ingest, "written", lambda df, name: plans.setdefault(name, plan(df)) and keep(df, name))
    try:
        mentions, relations = (keep(df, "batch") for df in batch(spark))
        got = ingest.shape_batch(mentions, relations, store.table("entities"))
        assert plans["gated"].count("Exchange hashpartitioning") == 2  # mentions, relations
        assert "SortMergeJoin" not in plans["mentions"]  # few names need no shuffle of mentions
        assert "Exchange" not in plan(got.observed)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [(r["src"], r["rel_type"], r["dst"]) for r in got.observed.collect()] == [("C1", "WORKS_AT", "globex")]
    assert [(r["episode_id"], r["no_head"], r["no_tail"]) for r in got.missing.collect()] == []


def test_embeddings_are_rounded_as_spark_rounds(spark):
    import numpy as np

    from factgraph.operators import retrieve

    values = [0.0078125, -0.0078125, 0.0, -1e-9, 0.1234565, 0.1234564999, 1.0, -0.5, 2.5e-6, 0.0000005, -0.0000005, *(k / 17**0.5 for k in range(-9, 9)), *(k / 128 for k in range(-128, 128, 5))]
    want = [r["x"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("x")).collect()]
    assert [repr(x) for x in retrieve._rounded(np.array(values)).tolist()] == [repr(x) for x in want]
