"""Dense search against brute force: far vectors, ties, types, odd vectors, and tiles."""

import math

import numpy as np
import pytest

from factgraph.operators import retrieve as R


def brute(vectors, questions, k, metric):
    out = set()
    for qid, q, want in questions:
        found = []
        for vid, v, kind in vectors:
            if v is None or any(c is None for c in v) or q is None or (want is not None and kind != want):
                continue
            x, y = np.array([v], float), np.array([q], float)
            with np.errstate(all="ignore"):
                d = float(R._distances(x, y, metric)[0])
            if math.isfinite(d):
                found.append((d, vid))
        out |= {(qid, vid, n, round(math.exp(-d), 6)) for n, (d, vid) in enumerate(sorted(found)[:k], 1)}
    return out


def run(spark, vectors, questions, k, metric, **kw):
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, entity_type string").repartition(3)
    q = spark.createDataFrame(questions, "query_id long, q array<double>, want_type string")
    return {(r["query_id"], r["vec_id"], r["rank"], r["score"]) for r in R.dense_search(v, q, k, metric, **kw).collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_far_vectors_ties_and_tiles(spark, metric):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 8)) * 20
    vectors = [(i, (base[i % 190]).tolist(), "abc"[i % 3]) for i in range(200)]  # ten exact copies
    vectors += [(300, None, "a"), (301, [0.0] * 8, "a"), (302, [1.0, None, *[0.0] * 6], "a"), (303, [float("nan")] * 8, "a"), (304, [float("inf")] * 8, "a"), (305, [1e9] * 8, "b")]
    questions = [(i, base[i].tolist(), None if i % 2 else "a") for i in range(25)] + [(99, None, None)]
    want = brute(vectors, questions, 5, metric)
    assert run(spark, vectors, questions, 5, metric) == want
    assert run(spark, vectors, questions, 5, metric, query_block=7, vector_block=30) == want


def test_scores_that_round_to_nothing_still_rank_by_distance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16)) * 8
    x[0] = x[430] + 1e-3
    vectors = [(i, v.tolist(), None) for i, v in enumerate(x)]
    questions = [(7, (x[0] + 30).tolist(), None)]
    d = np.sqrt(((x - (x[0] + 30)) ** 2).sum(axis=1))
    got = sorted((r, v) for _, v, r, _ in run(spark, vectors, questions, 5, "euclidean"))
    assert [v for _, v in got] == np.lexsort((np.arange(500), d))[:5].tolist() and d.min() > 24


def test_no_rows(spark):
    assert run(spark, [], [(1, [1.0], None)], 3, "cosine") == set() == run(spark, [(1, [1.0], None)], [], 3, "cosine")
    assert run(spark, [], [(i, [1.0], None) for i in range(3)], 3, "cosine", query_block=1) == set()
