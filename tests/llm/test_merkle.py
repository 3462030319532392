import random
import zlib

import pytest
from pyspark.sql import functions as F

from factgraph.llm import merkle as M

SCHEMA = "n_chars long, text string, hash string, doc_id long, source string, tree string, lang string, place int"


def levels(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([M.digest(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def folded(leaf, place, tree):
    """(root, proof) by the plain way: the run of each level with the leaf's own node put in."""
    beside = []
    for level in tree[:-1]:
        first = place - place % 8
        run = level[first : first + 8]
        beside += run[: place - first] + run[place - first + 1 :]
        run[place - first] = leaf
        leaf, place = M.digest(run), place // 8
    return leaf, beside


def leaf_of(i, source, lang, n, text):
    return M.digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text))


def plain(rows):
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for i, s, g, n, t in rows:
        tampered = low(t) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        groups.setdefault(g, []).append((i, leaf_of(i, s, g, n, t), leaf_of(i, s, g, n, tampered)))
    named = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    each = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for g in named}
    trees = {g: levels(r[1] for r in each[g]) for g in named}
    top = levels(trees[g][-1][0] for g in named)
    out = []
    for no, g in enumerate(named):
        for place, (i, leaf, claim) in enumerate(each[g]):
            sub, beside = folded(claim, place, trees[g])
            root, more = folded(sub, no, top)
            out.append((i, leaf, trees[g][-1][0], top[-1][0], M.digest(beside + more), root, root == top[-1][0]))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(n, t, "h", i, s, "t", g, 0) for i, s, g, n, t in rows], SCHEMA)


def run(spark, rows, **kw):
    return sorted(map(tuple, M.verify(frame(spark, rows), **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    rows = [(i, rng.choice(["web", None, ""]), rng.choice(["en"] * 6 + ["fr", "de", None, "", "日本"]), rng.choice([None, i]), rng.choice(["Some Text", "lower", "É", "", None]) and f"Text {i}") for i in range(-30, 620)]
    return [*rows, (None, None, "en", None, "ABC"), (5, "x", "en", 1, "Twice"), (5, "x", "en", 1, "Twice"), (9000, "s", "lone", 7, "A" * 300_000), *((10_000 + i, "s", f"l{i}", 1, "B") for i in range(12))]


def test_same_as_plain_trees(spark, rows):
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, depth=1) == plain(rows)  # more rounds, smaller blocks


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_at_the_edges(spark, n):
    rows = [(i, None, None, 0, "X") for i in range(n)]
    assert run(spark, rows, depth=1) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_multiproof_is_least_and_enough():
    rng = random.Random(3)
    for n in (1, 2, 8, 9, 65, 600):
        tree = levels(str(i) for i in range(n))
        for _ in range(20):
            places = rng.sample(range(n), rng.randint(1, min(n, 9)))
            need = M.missing(places, n)
            nodes = {(level, p): tree[level][p] for level, p in need}
            nodes |= {(0, p): tree[0][p] for p in places}
            assert M.derive(nodes, places, n) == tree[-1][0]
            # a node that the leaves lead to is never asked for, and none is asked for twice
            led = {(level, p // 8**level) for p in places for level in range(len(tree))}
            assert not led & set(need) and len(set(need)) == len(need)
            for p in places:
                assert M.fold(tree[0][p], M.siblings(nodes, p, n)) == tree[-1][0]


def test_proofs_of_some_leaves(spark, rows):
    manifest = M.documents_manifest(frame(spark, rows))
    some = manifest.leaves.where("place % 7 = 3").withColumn("leaf", F.col("hash"))
    got = {(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in M.prove(manifest, some, F.col("hash"), ["doc_id", "leaf"]).collect()}
    assert got and got <= {p[:5] for p in plain(rows)} and len(got) == some.count()
    assert [r["hash"] for r in manifest.root.collect()] == [plain(rows)[0][3]]
