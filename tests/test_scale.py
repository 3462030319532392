"""Operators that must not list hubs, hot keys or frequent terms: same rows as brute force, rows in between counted."""

import datetime
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from factgraph.functions.places import carried, dealt_like, met_by_part, scoped, written, written_by
from factgraph.operators import audit, edges, retrieve, shape, traverse


def hub(n):
    """Two hubs whose neighbours differ, joined by one edge, and pairs of leaves of both."""
    return [("h1", "R", f"a{i}", 0.5) for i in range(n)] + [("h2", "R", f"b{i}", 0.5) for i in range(n)] + [("h1", "R", "h2", 0.5)]


def test_third_hop_lists_no_hub(spark, monkeypatch):
    seen = {}
    plain = traverse._joined_by_edge
    for n in (100, 400):
        rows = []

        def counted(wanted, step, degree, rows=rows):
            sized = lambda c: degree.select(F.col("x").alias(c), F.col("degree").alias(f"d_{c}"))
            rows.append(wanted.join(sized("via"), "via").join(sized("end"), "end").agg(F.sum(F.least("d_via", "d_end"))).first()[0] or 0)
            return plain(wanted, step, degree)

        monkeypatch.setattr(traverse, "_joined_by_edge", counted)
        e = spark.createDataFrame(hub(n), "src string, rel_type string, dst string, strength double")
        pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(n)] + [("a0", "h2"), ("a1", "zz")], "a string, b string")
        got = {(r["a"], r["b"]): r["hops"] for r in traverse.path_lengths(e, pairs, 3).collect()}
        assert got == {**{(f"a{i}", f"b{i}"): 3 for i in range(n)}, ("a0", "h2"): 2, ("a1", "zz"): None}
        seen[n] = sum(rows)
    assert seen[400] <= 4 * seen[100] <= 16 * 100


def test_two_hops_through_hubs(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(30)]
    found = {(rng.choice(names), rng.choice("RS"), rng.choice(names)): round(rng.choice([0.1, 0.2, 0.3, 0.4]), 6) for _ in range(260)} | {("hub", "R", n): 0.4 for n in names} | {(n, "S", "hub"): 0.4 for n in names[:9]}
    rows = [(*k, v) for k, v in found.items() if k[0] != k[2]]
    near = {(a, b, r, s) for a, r, b, s in rows} | {(b, a, r, s) for a, r, b, s in rows}
    want = set()
    for start in ("hub", "n1", "n2"):
        paths = {(start, c, r2, b, round((s1 + s2) / 2, 7)) for a, b, _, s1 in near if a == start for x, c, r2, s2 in near if x == b and c != start}
        best = sorted(paths, key=lambda p: (-p[4], p[1], p[2], p[3]))[:4]
        want |= {(*p, n) for n, p in enumerate(best, 1)}
    e = spark.createDataFrame(rows, "src string, rel_type string, dst string, strength double")
    ids = spark.createDataFrame([("hub",), ("n1",), ("n2",)], "id string")
    assert {(r["id"], r["target"], r["rel_type"], r["via"], r["strength"], r["rank"]) for r in traverse.two_hop(e, ids, 4).collect()} == want


def test_two_hops_move_only_edges_that_can_be_best(spark, monkeypatch):
    """Many weak edges at every middle entity, few strong ones; a start with too few paths keeps all, and the rows are the same."""
    rng, moved, plain = random.Random(8), [], traverse.written

    def counted(df, name):
        out = plain(df, name)
        if name == "second":
            moved.append(out.count())
        return out

    monkeypatch.setattr(traverse, "written", counted)
    rows = {(f"m{i}", "IN", f"s{i % 2}"): 0.5 for i in range(40)} | {(f"m{i}", "R", f"t{j}"): round(rng.random() / 10, 6) for i in range(40) for j in range(50)}
    rows |= {(f"m{i}", "R", f"best{i % 7}"): 0.9 for i in range(40)}
    for starts, at_most in ((["s0", "s1"], 100), (["s0", "s1", "lone"], None)):
        graph = {**rows, ("lone", "R", "m0"): 0.01, ("lone", "R", "alone"): 0.5} if "lone" in starts else rows
        near = [x for (a, r, b), s in graph.items() for x in ((a, b, r, s), (b, a, r, s))]
        want = set()
        for start in starts:
            firsts = {(b, s) for a, b, _, s in near if a == start}
            paths = {(start, c, r, b, round((s1 + s2) / 2, 7)) for b, s1 in firsts for x, c, r, s2 in near if x == b and c != start}
            want |= {(*p, n) for n, p in enumerate(sorted(paths, key=lambda p: (-p[4], p[1], p[2], p[3]))[:60 if at_most is None else 10], 1)}
        e = spark.createDataFrame([(*k, v) for k, v in graph.items()], "src string, rel_type string, dst string, strength double")
        ids = spark.createDataFrame([(s,) for s in starts], "id string")
        got = traverse.two_hop(e, ids, 60 if at_most is None else 10).collect()
        assert {(r["id"], r["target"], r["rel_type"], r["via"], r["strength"], r["rank"]) for r in got} == want
        assert at_most is None or moved[-1] <= at_most
    assert moved[-1] >= 2000


def test_facts_at_many_days(spark):
    rng = random.Random(6)
    day = lambda: rng.choice([None, datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(40)), datetime.date(1, 1, 1), datetime.date(9999, 12, 31)])
    rows = [(i, "abc"[i % 3], day(), day()) for i in range(300)]
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(0, 45, 2)] + [datetime.date(9999, 12, 31), None]
    e = spark.createDataFrame(rows, "id long, kind string, valid_from date, valid_to date")
    t = spark.createDataFrame([(d,) for d in days], "t date")
    want = sorted((i, d) for i, _, a, z in rows for d in days if d and (a is None or a <= d) and (z is None or z > d))
    found = traverse.facts_at(e, t)
    assert sorted((r["id"], r["t"]) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {}
    for i, d in want:
        counts[d, rows[i][1]] = counts.get((d, rows[i][1]), 0) + 1
    assert {(r["t"], r["kind"]): r["n"] for r in traverse.counts_at(e, t, ["kind"]).collect()} == counts


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_ranked_text_search_in_two_phases(spark, share):
    rng = random.Random(8)
    words = ["the", "of", "and"] * 12 + ["in", "to"] * 4 + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(900, None), (901, "the the the")]
    asked = [(0, "the of and"), (1, "w1 w2 the w3"), (2, "w5"), (3, "nothing here"), (4, ""), (5, "w7 w8 w9 of and in to"), (6, None)]
    tokens = {i: re.findall("[a-z0-9_]+", (t or "").lower()) for i, t in docs}
    n, average = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {w: sum(w in ts for ts in tokens.values()) for w in {x for ts in tokens.values() for x in ts}}
    want = set()
    for q, text in asked:
        terms = set(re.findall("[a-z0-9_]+", (text or "").lower()))
        scores = {}
        for i, ts in tokens.items():
            parts = [math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * ts.count(w) * 2.2 / (ts.count(w) + 1.2 * (0.25 + 0.75 * len(ts) / average)) for w in terms if w in ts]
            if parts:
                scores[i] = round(sum(parts), 6)
        want |= {(q, i, r, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    got = retrieve.bm25(spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(asked, "query_id long, q string"), 5, frequent=share)
    assert {(r["query_id"], r["id"], r["rank"], r["score"]) for r in got.collect()} == want


def test_running_values_over_parts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + ["b", None]), i, rng.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    got = {r["at"]: (r["so_far"], r["previous"]) for r in carried(df, ["k"], [F.asc("at")], total="v", last="v").collect()}
    want, sums, last = {}, {}, {}
    for k, at, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[at] = (sums[k], last.get(k))
        last[k] = v
    assert got == want


def test_capped_deletes_of_a_hot_run(spark):
    rng = random.Random(10)
    rows = [(i, "hot" if i % 3 else "x", rng.choice(["verify", "delete", "delete", None])) for i in range(200)]
    got = {r["id"]: r["applied"] for r in audit.capped_deletes(spark.createDataFrame(rows, "id long, run string, verdict string"), "run", ["id"]).collect()}
    left, want = {}, {}
    for run in ("hot", "x"):
        left[run] = min(15, max(3, math.floor(sum(r[1] == run for r in rows) * 0.05)))
    for i, run, verdict in rows:
        if verdict == "delete":
            want[i], left[run] = left[run] > 0, left[run] - 1
        else:
            want[i] = True
    assert got == want


def test_supersession_of_a_hot_key(spark):
    rng = random.Random(12)
    start = datetime.date(2000, 1, 1)
    rows = [("hot", "R", f"d{i}", start + datetime.timedelta(rng.randrange(9000))) for i in range(300)] + [(None, "R", "x", start), (None, "R", "y", start + datetime.timedelta(31)), ("one", "R", "z", start)]
    got = sorted(((r["src"], r["segment"], r["opened"], r["facts"], r["current"], r["closed"], r["status"]) for r in edges.supersede(spark.createDataFrame(rows, "src string, rel_type string, dst string, valid_from date"), ["src", "rel_type"]).collect()), key=repr)
    want = []
    for key in {r[0] for r in rows}:
        parts = []
        for d, dst in sorted((r[3], r[2]) for r in rows if r[0] == key):
            if not parts or (d - parts[-1][-1][0]).days > 30:
                parts.append([])
            parts[-1].append((d, dst))
        ends = [p[0][0] for p in parts[1:]] + [None]
        want += [(key, n, p[0][0], len(p), p[-1][1], z, "historical" if z else "current") for n, (p, z) in enumerate(zip(parts, ends, strict=True), 1)]
    assert got == sorted(want, key=repr)


def test_tables_of_a_scope_go_with_it(spark):
    outer = written(spark.range(3), "outer")
    with scoped(spark):
        inner = written(spark.range(5), "inner")
        with scoped(spark):
            deep = written(spark.range(7), "deep")
            assert deep.count() == 7
        assert inner.count() == 5 and not os.path.exists(deep.inputFiles()[0].removeprefix("file://")) if deep.inputFiles() else True
        files = inner.inputFiles()
    assert outer.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_short_names_are_found_in_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "Al met Bo and X near it"), (1, 1, "alone"), (2, 0, "bo"), (2, 1, "")], "episode_id long, chunk_no int, chunk string")
    names = spark.createDataFrame([(1, "Al"), (1, "BO"), (1, "x"), (1, "Near It"), (1, "zz"), (2, "Bo"), (2, "")], "episode_id long, name string")
    got = {(r["episode_id"], r["chunk_no"]): r["names"] for r in shape.assign_chunks(chunks, names).collect()}
    assert got == {(1, 0): ["Al", "BO", "Near It", "x"]}


def test_third_hop_looks_around_a_shared_end_once(spark, monkeypatch):
    """Pairs that share an end, with hubs that none of them meets at: none is asked about neighbour by neighbour."""
    asked = []
    plain = traverse._joined_by_edge
    monkeypatch.setattr(traverse, "HUBS", 1)
    monkeypatch.setattr(traverse, "_joined_by_edge", lambda wanted, *rest: (asked.append(wanted.count()), plain(wanted, *rest))[1])
    edges = [("hub", f"h{i}") for i in range(80)] + [("e", "m"), ("m", "n")]
    edges += [(f"s{i}", f"v{i}_{j}") for i in range(30) for j in range(5)] + [(f"s{i}", "n") for i in range(0, 30, 2)]
    pairs = spark.createDataFrame([(f"s{i}", "e") for i in range(30)], "a string, b string")
    got = {r["a"]: r["hops"] for r in traverse.path_lengths(spark.createDataFrame(edges, "src string, dst string"), pairs, 3).collect()}
    assert got == {f"s{i}": None if i % 2 else 3 for i in range(30)}
    assert sum(asked) == 0


def test_neighbouring_words_split_a_text_once(spark):
    """Pairs of words are made of arrays side by side: no lambda splits the text at each of its words."""
    import __spark_entry__

    found = __spark_entry__.queries()["f2_merge_mentions"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(concat_ws( , " in plan and "lambdafunction(concat_ws( , split(" not in plan


def test_mentions_of_long_texts_as_of_short_ones(spark, monkeypatch):
    texts = [(1, "Ann Lee met Annabel Lee in Leeds; ann lee left"), (2, "aaaa aaa aa ab ba aab")]
    episodes = spark.createDataFrame(texts, "episode_id long, content string")
    said = [(e, i, text[i : i + n]) for e, text in texts for n in (2, 5, 13) for i in range(0, len(text) - n, 3)]
    mentions = spark.createDataFrame([(e, p * 20 + len(n), n) for e, p, n in said], "episode_id long, pos int, name string")
    short = sorted(map(tuple, shape.merge_mentions(mentions, episodes).collect()))
    low = [x.lower() for _, x in texts]
    for text in low:
        find = shape._finder(text)
        assert all(find(text[i:j]) == text.find(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)) and find("zz") == find("leeds, ann lee") == -1
    assert short and all(name.lower() in low[e - 1] for e, _, name in short)


def test_chunks_and_names_meet_without_a_row_a_piece(spark):
    chunks = spark.createDataFrame([(1, i, "ann met bob" if i % 2 else "ann left") for i in range(1100)] + [(2, 0, None), (2, 1, "Ann Bob")], "episode_id long, chunk_no int, chunk string")
    names = spark.createDataFrame([(1, "Ann"), (1, "bob"), (1, "o"), (2, "BOB"), (2, "ann"), (2, None), (3, "ann")], "episode_id long, name string")
    found = shape.assign_chunks(chunks, names)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["episode_id"], r["chunk_no"]): r["names"] for r in found.collect()}
    assert got == {(1, i): ["Ann", "bob", "o"] for i in range(1, 1100, 2)} | {(2, 1): ["BOB", "ann"]}


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_few_days_are_looked_through_without_blocks(spark):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    spans = [(i, None if i % 5 == 0 else day(i), None if i % 7 == 0 else day(i + i % 9 - 2)) for i in range(60)]
    edges = spark.createDataFrame(spans, "id int, valid_from date, valid_to date")
    asked = [(day(k), k) for k in (0, 3, 3, 17, 59, 90)] + [(day(3), 3), (None, 1)]
    got = traverse.facts_at(edges, spark.createDataFrame(asked, "t date, tag int"))
    want = [(i, t, tag) for i, a, b in spans for t, tag in asked if t and (a is None or a <= t) and (b is None or b > t)]
    assert sorted((r["id"], r["t"], r["tag"]) for r in got.collect()) == sorted(want)
    assert got.columns == ["id", "valid_from", "valid_to", "t", "tag"] and "_block" not in _plan(got)


def test_few_days_and_many_give_the_same(spark, monkeypatch):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    edges = spark.createDataFrame([(i, None if i % 5 == 0 else day(i), None if i % 7 == 0 else day(i + 4)) for i in range(40)], "id int, valid_from date, valid_to date")
    asked = spark.createDataFrame([(day(k * 3),) for k in range(15)], "t date")
    few = sorted(map(repr, traverse.facts_at(edges, asked).collect()))
    monkeypatch.setattr(traverse, "FEW_DAYS", 3)
    assert few == sorted(map(repr, traverse.facts_at(edges, asked).collect()))


def test_hash_embedding_groups_no_places(spark):
    from factgraph.operators import retrieve

    rows = [(1, "a b"), (2, "x " * 70_000), (1, "c"), (3, None), (4, " - "), (5, "c A b")]
    found = retrieve.hash_embedding(spark.createDataFrame(rows, "id long, text string"))
    plan = _plan(found)
    assert "Generate" not in plan and plan.count("Exchange") + plan.count("REPARTITION") <= 2
    got = {r["id"]: r["embedding"] for r in found.collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[5] and abs(sum(x * x for x in got[2]) - 1) < 1e-4


def test_flattening_output_of_documents_needs_no_shuffle(spark, tmp_path):
    from factgraph.plans import catalog

    spark.createDataFrame([(1, "a b c d e"), (2, None), (1, ""), (3, "x  y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["f1_flatten_output"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    kinds = ("Person", "Place", "Gadget", "Event")
    want = [(i, kinds[k % 4], w, k * 0.3) for i, text in ((1, "a b c d e"), (1, ""), (3, "x  y")) for k, w in enumerate(text.split(" "))]
    assert sorted(map(tuple, found.select("episode_id", "entity_type", "text", "score").collect())) == sorted(want)


def test_few_ends_do_not_move_the_edges(spark, monkeypatch):
    """Neighbours of a few entities are read without a shuffle of all edges, in path lengths, ranking and facts."""
    from factgraph.operators import answer

    links = spark.createDataFrame([("a", "KNOWS", "b"), ("b", "KNOWS", "c"), ("c", "USES", "d"), ("d", "USES", "e")], "src string, rel_type string, dst string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "d")], "a string, b string")
    plans, keep = {}, traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name: plans.setdefault(name, _plan(df)) and keep(df, name))
    assert {(r["a"], r["b"], r["hops"]) for r in traverse.path_lengths(links, pairs, 2).collect()} == {("a", "c", 2), ("a", "d", None)}
    assert "BroadcastHashJoin" in plans["steps"] and "SortMergeJoin" not in plans["steps"]
    day = F.lit("2024-01-01").cast("date")
    full = links.select("*", F.lit(2).cast("long").alias("mention_count"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), day.alias("last_day"))
    facts = answer.facts_of(spark.createDataFrame([("a",), ("a",)], "id string"), full, day)
    assert "SortMergeJoin" not in _plan(facts) and [(r["id"], len(r["facts"])) for r in facts.collect()] == [("a", 1)]


def test_batches_write_only_what_prompts_need(spark, monkeypatch):
    from factgraph.functions import places
    from factgraph.plans import curation_queries

    seen, keep = [], places.written
    monkeypatch.setattr(places, "written", lambda df, name: seen.append(set(df.columns)) or keep(df, name))
    edges = spark.createDataFrame([("a", "KNOWS", f"b{i:02}", i, 0.5, "x") for i in range(30)], "src string, rel_type string, dst string, mention_count long, confidence double, audit_status string")
    got = curation_queries.batched(type("T", (), {"edges": edges})())
    assert got.where("batch_no = 1").count() == 5
    assert seen == [{"src", "rel_type", "dst", "mention_count", "part"}]


def test_numbers_move_rows_twice_at_most(spark):
    """Dealt by ranges and then numbered within parts; offsets are a row a part, so no join moves the rows again."""
    from factgraph.functions.places import numbered

    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i) for i in range(300)], "g int, i int")
    found = numbered(rows, ["g"], [F.desc("i")])
    assert "SortMergeJoin" not in _plan(found)
    of = {g: sorted((i for i in range(300) if (None if i % 3 == 0 else i % 3) == g), reverse=True) for g in (None, 1, 2)}
    assert {(r["g"], r["i"], r["rn"]) for r in found.collect()} == {(g, i, k + 1) for g, all_ in of.items() for k, i in enumerate(all_)}
    assert found.schema["rn"].dataType.typeName() == "long"


#: Texts of documents, some odd ones among them.
ODD_TEXTS = ["Ann met Bob\nann left\nbob Ann x", None, "", "one", "É é É\nÉ x é", "a aa  a\naa b a", "x \n y", "Ab ab AB abc\nab"]


def _odd_documents(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("doc_id", "episode_id")


def test_chunks_of_whole_documents_move_no_more_than_texts(spark, tmp_path):
    """j25 moves texts as they are, once, and finds in the row of a document what the general form finds of chunks and names."""
    from factgraph.plans import catalog

    docs = _odd_documents(spark, tmp_path)
    held = catalog.queries()["j25_chunk_entities"](spark, str(tmp_path))
    assert _plan(held).count("Exchange") <= 1 and "Generate" not in _plan(held)
    chunks = docs.select("episode_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "chunk"))
    want = shape.assign_chunks(chunks, docs.select("episode_id", F.explode(F.split("text", " ")).alias("name")))
    assert sorted(map(tuple, held.collect())) == sorted((r[0], r[1], "|".join(r[2])) for r in want.collect()) != []


def test_mentions_of_whole_documents_move_no_more_than_texts(spark, tmp_path):
    """f2 moves texts as they are, once, and merges in the row of a document what the general form merges of mentions."""
    from factgraph.plans import catalog

    docs = _odd_documents(spark, tmp_path)
    merged = catalog.queries()["f2_merge_mentions"](spark, str(tmp_path))
    assert _plan(merged).count("Exchange") <= 1 and "Generate" not in _plan(merged)
    said = []
    for i, words in ((i, x.split(" ")) for i, x in enumerate(ODD_TEXTS) if x is not None):
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
        said += [(i, pos, name) for pos, name in enumerate(words + pairs) if len(name.strip(" ")) >= 2]
    want = shape.merge_mentions(spark.createDataFrame(said, "episode_id long, pos int, name string"), docs.where("text is not null").withColumnRenamed("text", "content"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect())) != []


def test_neighbours_are_counted_with_one_deal_of_the_edges(spark):
    """Edges are read once for both ways; hubs, loops, edges both ways, without strength or an end count as before."""
    links = [("hub", "USES", f"x{i}", i / 7) for i in range(50)] + [(f"x{i}", "USES", "hub", 1.0) for i in range(0, 50, 2)]
    links += [("hub", "KNOWS", "x1", None), ("hub", "KNOWS", "hub", 0.5), (None, "KNOWS", "x1", 0.3), ("x2", "KNOWS", None, 0.3), ("y", "KNOWS", None, None)]
    e = spark.createDataFrame(links, "src string, rel_type string, dst string, strength double")
    ids = spark.createDataFrame([("hub",), ("x1",), ("x2",), ("y",), ("z",)], "id string")
    found = traverse.neighbourhood(e, ids)
    assert "Union" not in _plan(found) and _plan(found).count("ExistingRDD") == 2
    near = traverse.both_ways(e).groupBy("id").agg(F.countDistinct("other").alias("neighbors"), (F.sum(F.round(F.col("strength") * 1_000_000).cast("bigint")) / F.count("*") / 1_000_000).alias("avg_strength"))
    want = ids.join(near, "id", "left").fillna({"neighbors": 0, "avg_strength": 0.0})
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {r["id"]: r["neighbors"] for r in found.collect()} == {"hub": 51, "x1": 1, "x2": 1, "y": 0, "z": 0}


def test_steps_are_dealt_once_and_read_where_they_are(spark):
    """What asks for neighbours comes to them, by the entity alone or with the neighbour too: steps are not shuffled again."""
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(conf, None)
    step = written_by(spark.createDataFrame([(f"x{i % 9}", f"y{i % 5}") for i in range(200)], "x string, y string"), "x", "steps")
    asked = written(spark.createDataFrame([("x1", "y1"), ("x1", "zz"), ("x8", "y4"), ("q", "y1")], "a string, at string"), "asked")
    assert step.count() == 45
    with met_by_part(spark):
        met = dealt_like(asked, "a").join(step.hint("merge"), (F.col("a") == F.col("x")) & (F.col("at") == F.col("y")), "left_semi")
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(map(tuple, met.collect())) == [("x1", "y1"), ("x8", "y4")]
    near = dealt_like(asked, "a").join(step.hint("merge"), F.col("a") == F.col("x"))
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and near.count() == 15
    assert spark.conf.get(conf, None) in (before, "true")


def test_names_of_settled_types_make_no_keys(spark, monkeypatch):
    """Once all mentions of a type are settled, its names take no part in the steps for the others."""
    types, plain = [], shape._by_letters
    monkeypatch.setattr(shape, "_by_letters", lambda left, known, changes: (types.append({r[0] for r in known.select("entity_type").distinct().collect()}), plain(left, known, changes))[1])
    entities = spark.createDataFrame([("C1", "Customer#000000001", "Person"), ("C2", "Customer#000000002", "Person"), ("S1", "Supplier#000000001", "Organization")], "id string, name string, entity_type string")
    said = spark.createDataFrame([(1, "Customer#x000000001", "Person"), (2, "new vendor s12345", "Organization")], "k long, mention string, entity_type string")
    got = {r["k"]: r["id"] for r in shape.fuzzy_match(said, entities).collect()}
    assert got == {1: "C1"} and types and all(t == {"Organization"} for t in types)
