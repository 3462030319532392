import hashlib
import random

import numpy as np
import pytest

from factgraph.llm import version_sketch as S

SCHEMA = "text string, doc_id long, id string, part int"


def jaccard(a, b):
    x, y = set(S.digests(a).tolist()), set(S.digests(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def plain(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        v = S.edited(t, after)
        out.append((i, len(t), hashlib.sha256(v.encode()).hexdigest(), S.fingerprint([S.digests(t)])[0], S.fingerprint([S.digests(v)])[0], round(jaccard(t, v), 12), round(jaccard(t, after), 12)))
    return sorted(out, key=repr)


def run(spark, rows, parts=3, chars=S.SLICE):
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], SCHEMA).repartition(parts)
    return sorted(((r["id"], r["n_chars"], r["edited_sha256"], bytes(r["fp"]), bytes(r["efp"]), round(r["near_edited"], 12), round(r["near_next"], 12)) for r in S.versions(docs, chars=chars).collect()), key=repr)


@pytest.fixture
def texts():
    rng = random.Random(4)
    words = ["äpfel", "zug", "日本", "x", "lorem", "ipsum", "🙂"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + rng.choice([". ", ", ", "! ", "\n", "。"])
    return ["".join(sentence() for _ in range(rng.choice([0, 1, 3, 30, 400]))) for _ in range(90)]


def test_same_as_sets(spark, texts):
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, "One. Two. " * 4000), (1004, "One. Two. " * 4000)]
    assert run(spark, rows) == plain(rows)


def test_slices_and_tasks_change_nothing(spark, texts):
    rows = list(enumerate(texts))
    whole = run(spark, rows, 1)
    assert run(spark, rows, 7, 200) == whole == plain(rows)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, "alone, here.")]) == plain([(5, "alone, here.")])
    got = run(spark, [(None, "b. c."), (2, "b. c."), (2, "b. c."), (None, None)])
    assert len(got) == 4 and len({g[3] for g in got if g[1]}) == 1


def test_peeling_gives_the_digests_that_differ(texts):
    rng = random.Random(1)
    for size in (0, 1, 5, 300):
        a = [np.array([rng.getrandbits(64) for _ in range(size + 20)], np.uint64) for _ in range(30)]
        b = [np.concatenate([x[size:], np.array([rng.getrandbits(64) for _ in range(size // 2)], np.uint64)]) for x in a]
        keys, row, side = S.differences(a, b)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            assert set(keys[(row == i) & (side == 1)].tolist()) == set(x.tolist()) - set(y.tolist())
            assert set(keys[(row == i) & (side == -1)].tolist()) == set(y.tolist()) - set(x.tolist())


def test_fingerprints_subtract():
    base = "One. Two. Three. Four. Five. Six."
    a, b = (S.fingerprint([S.digests(t)])[0] for t in (base, base.replace("Two.", "Zwei.")))
    only_a, only_b = S.subtract(a, b)
    assert only_a == [S.digests("Two.")[0]] and only_b == [S.digests("Zwei.")[0]]
    assert S.subtract(a, a) == ([], [])
    far = S.fingerprint([S.digests(" ".join(f"w{i}." for i in range(500)))])[0]
    assert S.subtract(a, far) is None


def test_repeats_are_told_apart():
    assert len(set(S.digests("a. a. a.").tolist())) == 3
    assert S.likeness([S.digests("a. a. a.")], [S.digests("a.")])[0] == pytest.approx(1 / 3)


def test_compare(spark):
    pairs = spark.createDataFrame([(1, "a. b.", "b. c.", 0), (2, None, None, 0), (None, "a.", "", 0)], "k long, x string, y string, likeness int")
    got = {r["id"]: (len(r["only_a"]), len(r["only_b"]), r["likeness"]) for r in S.compare(pairs, "k", "x", "y").collect()}
    assert got == {1: (1, 1, pytest.approx(1 / 3)), 2: (0, 0, 1.0), None: (1, 0, 0.0)}
