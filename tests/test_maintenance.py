"""Nights over a stored graph: what an audit, clean-up and accumulation change, replays, and what a failed night leaves."""

import pytest
from pyspark.sql import functions as F

from factgraph.functions import vocabulary as V
from factgraph.operators import edges as E
from factgraph.operators import maintenance

ENTITY = "id string, name string, entity_type string, alias string, confidence double, mention_count long, first_day string, last_day string"
OBSERVED = "src string, rel_type string, dst string, confidence double, snippet string, episode_id string, day string"


def dated(df, *columns):
    return df.withColumns({c: F.to_date(c) for c in columns})


@pytest.fixture
def store(spark, tmp_path):
    people = [(f"P{i}", f"Person {i}", "Person", f"p{i}", 0.5, 1, "2020-01-01", "2020-02-01") for i in range(8)]
    rows = [("P0", "KNOWS", "P1", 0.5, "a", "e1", "2020-01-01"), ("P0", "USES", "P2", 0.6, "b", "e1", "2020-01-01"), ("P0", "KNOWS", "P2", 0.4, "c", "e2", "2020-01-02"), ("P1", "USES", "P3", 0.5, "d", "e1", "2020-01-01"), ("P2", "KNOWS", "P3", 0.5, "e", "e2", "2020-01-01"), ("P4", "KNOWS", "P4", 0.5, "f", "e2", "2020-01-01"), ("P5", "MENTORS", "P0", 0.5, "g", "e1", "2020-01-01")]
    observed = dated(spark.createDataFrame(rows, OBSERVED), "day")
    store = maintenance.maintained_store(spark, str(tmp_path / "g"))
    vectors = spark.createDataFrame([("P0", [1.0]), ("nobody", [1.0])], "id string, embedding array<double>")
    store.commit(0, {"entities": E.entity_state(dated(spark.createDataFrame(people, ENTITY), "first_day", "last_day")), "edges": E.edge_rows(observed, ["day", "episode_id"]), "seen_in": E.edge_episodes(observed, ["day", "episode_id"]), "vectors": vectors})
    return store


def answers(said):
    """Responses that give each line of a prompt what is said of its edge, if anything."""

    def answer(prompts):
        spark = prompts.sparkSession
        out = []
        for batch, prompt in prompts.collect():
            items = []
            for line in prompt.split("\n"):
                for edge, (verdict, to) in said.items():
                    if edge in line:
                        items.append(f'{{"index": {line.split(".")[0]}, "verdict": "{verdict}", "suggested_type": "{to}"}}')
            out.append((batch, f"Sure: [{', '.join(items)}]"))
        return spark.createDataFrame(out, "batch_no int, raw string")

    return answer


SAID = {"P0 -[KNOWS]-> P1": ("verify", ""), "P0 -[USES]-> P2": ("reclassify", "knows"), "P1 -[USES]-> P3": ("delete", ""), "P2 -[KNOWS]-> P3": ("quarantine", ""), "P5 -[MENTORS]-> P0": ("reclassify", "no such type")}


def edges(store):
    return {(r["src"], r["rel_type"], r["dst"]): (r["mention_count"], r["audit_status"]) for r in store.table("edges").collect()}


def test_nights(spark, store, tmp_path):
    mentions = spark.createDataFrame([("e1", f"P{i}") for i in (0, 1, 2, 3, 6)] + [("e2", "P2"), ("e2", "P3"), ("e2", "P0"), ("e3", "P0"), ("e4", "P7")], "episode_id string, entity_id string").where("entity_id <> 'P7'")
    episodes = spark.createDataFrame([("e1", "text one", "2020-01-01"), ("e2", "text two", "2020-03-01"), ("e3", "late", "2020-04-30"), ("e4", " ", "2020-01-01")], "id string, content string, ts string").withColumn("ts", F.to_timestamp("ts"))
    named = spark.createDataFrame([("P6",)], "id string")
    rows = (str(tmp_path / "cursor"), episodes, named)
    # accumulation before any night: e1 alone
    assert maintenance.accumulate(store, 1, rows[0], episodes.where("id = 'e1'"), mentions, named, F.lit("2020-02-01").cast("timestamp"))
    first = {r["id"]: r for r in store.table("examples").collect()}
    triples = lambda rs: {(r["head"], r["label"], r["tail"]) for r in rs}
    assert set(first) == {"e1"} and triples(first["e1"]["relations"]) == {("Person 0", "KNOWS", "Person 1"), ("Person 0", "USES", "Person 2"), ("Person 1", "USES", "Person 3")}
    assert {e["name"] for e in first["e1"]["entities"]} == {"Person 0", "Person 1", "Person 2", "Person 3", "Person 6"}
    assert not maintenance.accumulate(store, 1, *rows[:2], mentions, named, F.lit("2021-01-01").cast("timestamp"))

    night = maintenance.nightly(store, 2, "2020-05-01", answers(SAID), V.RELATION_TYPES, mentions=mentions, training_rows=rows).collect()[0]
    assert edges(store) == {("P0", "KNOWS", "P1"): (1, "verified"), ("P0", "KNOWS", "P2"): (2, "verified"), ("P2", "KNOWS", "P3"): (1, "quarantined"), ("P5", "MENTORS", "P0"): (1, "quarantined")}
    assert {(r["rel_type"], r["dst"], r["episode_id"]) for r in store.table("seen_in").where("src = 'P0'").collect()} == {("KNOWS", "P1", "e1"), ("KNOWS", "P2", "e1"), ("KNOWS", "P2", "e2")}
    # P7 is at no edge and no episode; P4 has its loop when orphans are looked for, and is one the night after
    assert {r["id"] for r in store.table("entities").collect()} == {f"P{i}" for i in range(7)} == {r["id"] for r in store.table("vectors").collect()}
    want = {"orphans": 1, "self_loops": 1, "reviewed": 5, "verified": 1, "moved": 1, "quarantined": 2, "deleted": 1, "over_cap": 0, "refreshed": 6, "stray": 1, "examples_dropped": 0, "stripped": 2, "examples_added": 2, "new_types": [], "alarm": "none", "decision": "reindex_embeddings"}
    assert {k: night[k] for k in want} == want and night["edges"] == 7
    signals = {(r["src"], r["relation"], r["dst"], r["signal"], r["source"]) for r in store.table("signals").collect()}
    assert signals == {("P0", "KNOWS", "P1", "positive", "verify"), ("P0", "USES", "P2", "negative", "reclassify"), ("P0", "KNOWS", "P2", "positive", "reclassify"), ("P1", "USES", "P3", "negative", "delete"), ("P2", "KNOWS", "P3", "negative", "quarantine"), ("P5", "MENTORS", "P0", "negative", "quarantine")}
    got = {r["id"]: r for r in store.table("examples").collect()}
    assert triples(got["e1"]["relations"]) == {("Person 0", "KNOWS", "Person 1")}
    assert triples(got["e2"]["relations"]) == {("Person 0", "KNOWS", "Person 2")} and triples(got["e2"]["negatives"]) == {("Person 2", "KNOWS", "Person 3"), ("Person 0", "USES", "Person 2")}
    assert set(got) == {"e1", "e2", "e3"} and triples(got["e3"]["relations"]) == set()

    def never(_):
        raise RuntimeError("asked again")

    assert maintenance.nightly(store, 2, "2020-05-01", never, V.RELATION_TYPES).collect() == [night] and len(store.versions()) == 3
    with pytest.raises(RuntimeError):
        maintenance.nightly(store, 3, "2020-05-03", never, V.RELATION_TYPES, mentions=mentions, training_rows=rows)
    assert store.versions() == [0, 1, 2]
    again = maintenance.nightly(store, 3, "2020-05-03", answers({"P0 -[KNOWS]-> P1": ("delete", "")}), V.RELATION_TYPES, mentions=mentions, training_rows=rows).collect()[0]
    # the relation goes from the example that holds it, which had no other
    assert {k: again[k] for k in ("orphans", "deleted", "examples_dropped", "stripped", "examples_added", "alarm")} == {"orphans": 1, "deleted": 1, "examples_dropped": 1, "stripped": 1, "examples_added": 0, "alarm": "high"}
    assert {r["id"] for r in store.table("examples").collect()} == {"e2", "e3"} and "P4" not in {r["id"] for r in store.table("entities").collect()}
    assert edges(store).keys() == {("P0", "KNOWS", "P2"), ("P2", "KNOWS", "P3"), ("P5", "MENTORS", "P0")}


def test_nothing_is_said_and_nothing_is_there(spark, tmp_path):
    store = maintenance.maintained_store(spark, str(tmp_path / "g"))
    people = dated(spark.createDataFrame([("P0", "Person 0", "Person", "p", 0.5, 1, "2020-01-01", "2020-02-01")], ENTITY), "first_day", "last_day")
    none = dated(spark.createDataFrame([("P0", "KNOWS", "P0", 0.5, "s", "e", "2020-01-01")], OBSERVED), "day")
    store.commit(0, {"entities": E.entity_state(people), "edges": E.edge_rows(none, ["day", "episode_id"])})
    night = maintenance.nightly(store, 1, "2020-05-01", answers({}), V.RELATION_TYPES).collect()[0]
    assert (night["self_loops"], night["reviewed"], night["orphans"]) == (1, 0, 0) and store.table("edges").count() == 0
    night = maintenance.nightly(store, 2, "2020-05-02", answers({}), V.RELATION_TYPES).collect()[0]
    assert (night["self_loops"], night["orphans"], night["edges"]) == (0, 1, 0) and store.table("entities").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_oldest_audits_are_sent_to_the_edges(spark, monkeypatch):
    """The queue is the same whether the oldest audits are sent to the edges, which then are not moved, or all meet them."""
    status = F.when(F.col("id") % 5 == 0, "verified").when(F.col("id") % 7 == 0, "quarantined")
    edges = spark.range(200).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("KNOWS").alias("rel_type"), F.lit("b").alias("dst"), status.alias("audit_status"), F.lit(1).cast("long").alias("mention_count"), "id")
    audits = edges.where("id % 3 <> 1").select(*E.EDGE, F.when(F.col("id") != 3, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 50).cast("int"))).alias("last_audited")).unionByName(spark.createDataFrame([("gone", "KNOWS", "b", "2019-01-01")], "src string, rel_type string, dst string, last_audited string").withColumn("last_audited", F.to_date("last_audited")))
    plans, keep = {}, maintenance.written
    monkeypatch.setattr(maintenance, "written", lambda df, name: plans.__setitem__(name, _plan(df)) or keep(df, name))
    ask = lambda limit: [(r["src"], r["batch_no"], r["index"]) for r in maintenance.review(edges.drop("id"), audits, answers({"a": ("verify", "")}), limit).orderBy("batch_no", "index").collect()]
    got = {}
    for rows, limit in ((0, 20), (60, 20), (60, 150)):
        monkeypatch.setattr(maintenance, "SMALL_ROWS", rows)
        plans.clear()
        got[rows, limit] = ask(limit)
        sent = "longest_audited" in plans
        assert sent == (rows > 0) and (not sent or "SortMergeJoin" not in plans["longest_audited"])
        assert ("SortMergeJoin" in plans["queue"]) == (rows == 0 or limit == 150)
    assert got[0, 20] == got[60, 20] and got[60, 150][:20] == got[0, 20] and len(got[60, 150]) == 150
