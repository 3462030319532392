import random

from factgraph.llm import line_dedup as L

SCHEMA = "doc_id long, text string, id string, kept string"


def plain(rows):
    where = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(L.line_key(x)) >= 10:
                where.setdefault(L.line_key(x), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(where.get(L.line_key(x), ())) < 2 or i <= min(where[L.line_key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows):
    return sorted(((r["id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in L.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    pool = [f"Line Number {i} É" for i in range(30)] + ["short", "", "  ", "exactly10!", "\tline number 3 É \r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))), "a", "b") for i in range(60)]
    rows += [(60, None, "a", "b"), (61, "", "a", "b"), (61, "Line Number 1 É", "", ""), (None, "Line Number 1 É", "", ""), (62, "\n" * 50_000 + "LINE NUMBER 2 É", "", "")]
    assert run(spark, rows) == plain(rows)


def test_empty_table_and_carried_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "the same line\nown", "x", "k1"), (2, "The Same Line ", "y", None)], SCHEMA)
    got = {r["id"]: (r["c0"], r["c1"], r["kept"]) for r in L.dedup_lines(docs, carry=["id", "kept"]).collect()}
    assert got == {1: ("x", "k1", "the same line\nown"), 2: ("y", None, "")}
