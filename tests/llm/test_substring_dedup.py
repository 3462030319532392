import random

import pytest

from factgraph.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, h string, kept string"


def plain(rows, window=13):
    where = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                where[key] = min(i, where.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and where[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    return sorted((tuple(r) for r in S.dedup_substrings(spark.createDataFrame(rows, SCHEMA), **more).collect()), key=repr)


def test_same_as_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    passages = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.randint(5, 60))] for k in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.6 else [f"x{rng.randrange(9)}" for _ in range(rng.randint(1, 20))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), "a", "b"))
    rows += [(200, rows[3][1], "", ""), (201, rows[3][1].replace(" ", "\n"), "", ""), (202, None, "", ""), (203, "", "", ""), (204, "é " * 13, "", ""), (205, "é " * 14, "", ""), (None, rows[3][1], "", ""), (3, rows[3][1], "", ""), (206, "one " * 30_000, "", "")]
    assert run(spark, rows) == plain(rows)
    monkeypatch.setattr(S, "_HELD", 40)  # what is held is passed on after every few documents
    assert run(spark, rows) == plain(rows)


def test_empty_table_and_bad_cover(spark):
    assert run(spark, []) == []
    short = [(1, "a b", "", ""), (2, "a b", "", ""), (3, None, "", "")]
    assert run(spark, short) == plain(short)
    with pytest.raises(ValueError):
        S.dedup_substrings(spark.createDataFrame([], SCHEMA), cover=(0, 1))
