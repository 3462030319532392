"""Questions to ranked facts on a small graph: exact before loose, vector fills gaps, only entities with facts."""

import pytest
from pyspark.sql import functions as F

from factgraph.operators import answer as A


@pytest.fixture(scope="module")
def graph(spark):
    entities = spark.createDataFrame([("a", "Alice Example", "Person", "Ally", "writer of books"), ("b", "Acme", "Organization", "Acme Inc", "builds rockets and engines"), ("c", "Carol", "Person", "Cal", "likes rockets"), ("d", "Dora Acme", "Person", "Do", "nothing")], "id string, name string, entity_type string, alias string, description string")
    edges = spark.createDataFrame([("a", "WORKS_AT", "b", 2, 0.8), ("a", "KNOWS", "c", 1, 0.3), ("b", "CREATED", "c", 3, 0.9), ("c", "USES", "b", 1, 0.2)], "src string, rel_type string, dst string, mention_count long, strength double")
    edges = edges.withColumns({"valid_from": F.to_date(F.lit("2020-01-01")), "valid_to": F.lit(None).cast("date"), "last_day": F.to_date(F.lit("2020-06-01")), "audit_status": F.lit(None).cast("string")})
    vectors = A.entity_vectors(entities).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return entities, edges, vectors


def run(spark, graph, questions, **kw):
    entities, edges, vectors = graph
    q = spark.createDataFrame(questions, "query_id long, q string")
    return A.answer(q, entities, edges, vectors, F.lit("2021-01-01").cast("date"), **kw)


def test_answers(spark, graph):
    rows = run(spark, graph, [(1, "What does Ally do"), (2, "exampl"), (3, "rockets and engines"), (4, None), (5, "Dora Acme")]).collect()
    got = {(r["query_id"], r["id"]): r for r in rows}
    assert got[1, "a"]["source"] == "graph_exact" and [f["target"] for f in got[1, "a"]["facts"]] == ["b", "c"]
    assert got[2, "a"]["source"] == "graph_fuzzy"
    assert got[3, "b"]["source"] in ("vector", "graph_fuzzy") and not any(q == 4 for q, _ in got)
    assert (5, "d") not in got  # no facts, so no result; the loose match comes in
    for q in (1, 2, 3, 5):
        ranks = sorted((r["rank"], -r["final"]) for r in rows if r["query_id"] == q)
        assert [n for n, _ in ranks] == list(range(1, len(ranks) + 1)) and ranks == sorted(ranks, key=lambda x: x[1])


def test_limit_and_log(spark, graph):
    assert run(spark, graph, [(1, "Ally and Acme and Carol")], limit=2).count() == 2
    log = {r["query_id"]: (r["source"], r["results"], r["graph_results"]) for r in A.retrieval_source(run(spark, graph, [(1, "Ally and Acme and Carol"), (2, "zzzz")])).collect()}
    assert log[1] == ("graph_exact", 3, 3)
    assert run(spark, graph, []).count() == 0
