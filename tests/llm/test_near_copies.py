import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from factgraph.llm import near_copies as N

SCHEMA = "doc_id long, text string"


def plain_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 10 * len(a & b) >= 8 * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus():
    """Texts with copies of growing difference on both sides of the similarity, and chains of copies of copies."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(80, 300))]
        texts.append(base)
        for edits in range(1, 9):
            copy = list(base if rng.random() < 0.6 else texts[-1])
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rng.shuffle(texts)
    rows = [" ".join(t) for t in texts] + ["", None, " \n", "one", "One", "a b c", "a b c d e", "a b c d e f"]
    return {i * 2 + 1: t for i, t in enumerate(rows)}


def test_same_groups_as_brute_force(spark):
    texts = corpus()
    got = N.near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    assert {r["id"]: r["component_id"] for r in got} == plain_groups(texts)


def test_stage_drops_what_simhash_left(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame([*texts.items(), (None, texts[1])], SCHEMA)
    stage = dict(P.STAGES)["near_duplicates"]
    kept = sorted((r["doc_id"] or -1) for r in stage(spark, docs, str(tmp_path)).collect())
    assert kept == [-1, *sorted(set(plain_groups(texts).values()))]


def test_gray_order_index_links_before_the_bands_do(spark, monkeypatch):
    """Without any band, copies whose fingerprints are within two bits are dropped, and only those of the similarity."""
    rng = random.Random(11)
    words = [rng.choice([f"w{i}" for i in range(900)]) for _ in range(3000)]
    docs = spark.createDataFrame([(4, " ".join(words)), (6, " ".join([*words, "end"])), (8, " ".join(words[::-1])), (9, "a b c"), (10, "")], SCHEMA)
    apart = (N.fingerprint(N.shingle_set(" ".join(words))) ^ N.fingerprint(N.shingle_set(" ".join([*words, "end"])))).bit_count()
    assert apart <= 2
    monkeypatch.setattr(N, "groups", lambda live, sets, links: N.components(links))
    stage = dict(P.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [4, 8, 9, 10]


def test_fingerprints_alone_make_no_link(spark):
    reps = spark.createDataFrame([(1, 7), (2, 7), (3, 6), (4, -1)], "node long, fp long")
    pairs = N.fingerprint_pairs(reps).collect()
    assert {frozenset((r["a"], r["b"])) for r in pairs} == {frozenset((1, 2)), frozenset((1, 3))}
    sets = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, [1, 2])], "node long, hashes array<long>")
    assert [(r["u"], r["v"]) for r in N.similar(N.fingerprint_pairs(reps), sets).collect()] == [(3, 1)]


def test_bucket_of_different_sets_is_searched_to_the_end(spark):
    """No pair of a bucket is skipped, though its smallest sets are like none of the others."""
    sets = {n: {n * 100 + k for k in range(10)} for n in range(20)} | {30 + n: {5000 + k for k in range(n, n + 10)} for n in range(3)}
    live = spark.createDataFrame([(1, n) for n in sets], "key long, node long")
    table = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, hashes array<long>")
    got = N.groups(live, table, spark.createDataFrame([], "u long, v long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(31, 30), (32, 30)}


def test_empty_table_and_ids_with_two_texts(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (9, "A b c d"), (7, "z y"), (7, "a b c d"), (8, "z y"), (None, "a b c d")]
    got = {(r["id"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (8, 5)}


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pool = np.unique(rng.integers(1 << 63, size=400, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False)) for _ in range(2))
        x, y = (np.frombuffer(N.sketch(s), "<u2") for s in (a, b))
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b))
    # a sum of cells that overflowed rules nothing out
    big = np.arange(70_000, dtype=np.uint64)
    assert np.frombuffer(N.sketch(big), "<u2").max() == 65_535


def test_large_bucket_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "DEALT", 7)
    monkeypatch.setattr(N, "PIVOTS", 4)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    texts = {}
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts[i] = " ".join(copy)
    got = N.near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    assert {r["id"]: r["component_id"] for r in got} == plain_groups(texts)


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(120_000))
    rows = [(1, long, 5, "a"), (2, long + " and one more", 6, "b"), (3, "something else entirely said in other words", 7, "c"), (None, long, 8, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, bands string").withColumn("component_id", F.lit("x")).withColumn("rep", F.lit(1))
    out = N.near_dedup(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] or 0, r["bands"]) for r in out.collect()) == [(0, "d"), (1, "a"), (3, "c")]
