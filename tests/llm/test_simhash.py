import random

import numpy as np
import xxhash

from factgraph.llm import simhash as S

SCHEMA = "doc_id long, text string, id string, fp string"


def plain_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(ids, fps):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and bin(a ^ b).count("1") <= 2:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}É" for i in range(50)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append("\t".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    texts += ["", None, " \n", "one", "One", "one two", "a b c", "A B C", "x" * 200_000]
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(texts)]
    got = S.near_duplicates(spark.createDataFrame(rows + [(None, "one", None, None)], SCHEMA)).collect()
    fps = {r["id"]: r["fp"] & (2**64 - 1) for r in got if r["id"] is not None}
    assert fps == {i: plain_fp(t) for i, t, _, _ in rows}
    want = plain_components(list(fps), list(fps.values()))
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == want
    assert [r["component_id"] for r in got if r["id"] is None] == [None]


def forest(fps, node, **more):
    """Links of the tree by position, from fingerprints in any order."""
    order = np.lexsort((S.gray_rank(fps), node))
    child, root = S.tree_links(fps[order], node[order], **more)
    parent = {int(c): int(r) for c, r in zip(order[child], order[root])}
    return {i: next(iter(c)) for i, c in ((i, {parent.get(i, i)}) for i in range(len(fps)))}


def groups(of):
    found = {}
    for i, c in of.items():
        found.setdefault(c, set()).add(i)
    return sorted(map(sorted, found.values()))


def test_tree_of_several_upper_nodes():
    rng = np.random.default_rng(3)
    base = np.uint64(rng.integers(1 << 63))
    dense = np.unique(base ^ (rng.integers(0, 1 << 12, 900).astype(np.uint64) << np.uint64(5)))
    spread = np.unique(rng.integers(1 << 63, size=400).astype(np.uint64))
    spread = np.unique(np.r_[spread, spread[:100] ^ np.uint64(1 << 40), spread[50:90] ^ np.uint64(3)])
    fps = np.r_[dense, spread, dense[:2], dense[:1]]
    node = np.r_[np.zeros(len(dense)), np.full(len(spread), 1), [2, 2], [3]].astype(int)
    for fan_out in (2, 8):
        seen = []
        got = forest(fps, node, fan_out=fan_out, seen=seen)
        want = {}
        for k in range(4):
            at = np.flatnonzero(node == k)
            want |= {int(at[i]): int(at[r]) for i, r in plain_components(list(range(len(at))), [int(fps[i]) for i in at]).items()}
        assert groups(got) == groups(want)
        assert len(seen) > 3


def test_tree_prunes():
    fps = np.unique(np.random.default_rng(5).integers(1 << 63, size=20_000).astype(np.uint64))
    fps = np.unique(np.r_[fps, fps[:200] ^ np.uint64(5)])
    seen = []
    got = forest(fps, np.zeros(len(fps), int), seen=seen)
    assert sum(c != i for i, c in got.items()) >= 200
    assert sum(seen) < len(fps) ** 2 / 2 / 30  # a thirtieth of all pairs at most, over all levels


def test_tree_links_documents(spark):
    """On whole documents: the tree finds links, and components are those of brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = S.near_duplicates(docs).collect()
    fps = {r["id"]: r["fp"] & (2**64 - 1) for r in got}
    assert {r["id"]: r["component_id"] for r in got} == plain_components(list(fps), list(fps.values()))
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in {f: i for i, f in sorted(fps.items(), reverse=True)}.items()], "fp long, rep long")
    noisy = reps.union(reps.selectExpr("fp ^ 5", "rep + 1000000")).groupBy("fp").agg({"rep": "min"}).toDF("fp", "rep")
    assert S.links(noisy).count() >= reps.count() * 0.9
    # factored down to the last level, the same components
    deep = {tuple(r) for r in S.components(S.links(noisy, split=1)).collect()}
    assert deep == {tuple(r) for r in S.components(S.links(noisy)).collect()}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999)], "u long, v long")
    got = {r["node"]: r["component"] for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: 999}


def test_every_pair_within_two_bits_shares_an_upper_node():
    level = [0]
    while level[0].bit_count() < 64 - S.FREE:
        below = {m: S.masks(m) for m in level}
        for m, ms in below.items():
            free = [b for b in range(64) if not m >> b & 1]
            for a in free:
                for b in free:
                    assert any((1 << a | 1 << b) & x == 0 for x in ms)
        level = [x for ms in below.values() for x in ms]
        assert all(x.bit_count() > m.bit_count() for m, ms in below.items() for x in ms)


def test_repeated_rows_empty_table_and_dedup(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d", "", ""), (5, "a b c d", "", ""), (9, "A b c d", "", ""), (7, "z y", "", ""), (7, "a b c d", "", ""), (None, "a b c d", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (None, None)}
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 5, 5]
