"""Small literal cases of single operators."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.operators import audit, decisions, edges, ingest, metrics, retrieve, shape, training, traverse
from factgraph.sources import logs


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(
    ("head", "relation", "tail", "source", "confidence", "decision"),
    [
        ("Technology", "REPORTS_TO", "Person", "session", 0.92, "quarantine"),
        ("Technology", "REPORTS_TO", "Person", "session", 0.60, "skip"),
        ("Person", "WORKS_AT", "Organization", "contacts_json", 0.5, "allow"),
        ("Person", "MEMBER_OF", "Concept", "contacts_json", 0.5, "allow"),
        ("Person", "MENTORED_BY", "Person", "contacts_json", 0.5, "allow"),
        ("Concept", "MANAGES", "Person", "contacts_json", 0.5, "quarantine"),
    ],
)
def test_gate(spark, head, relation, tail, source, confidence, decision):
    df = spark.createDataFrame([(head, relation, tail, source, confidence)], "head_type string, rel_type string, tail_type string, source string, confidence double")
    assert shape.gate(df).first()["decision"] == decision


def test_contact_prior_lowers(spark):
    df = spark.createDataFrame([("Person", "REPORTS_TO", "Person", s, 0.5) for s in ("contacts_json", "session")], "head_type string, rel_type string, tail_type string, source string, confidence double")
    score = {r["source"]: r["gate_score"] for r in shape.gate(df).collect()}
    assert score["contacts_json"] < score["session"]


def test_speaker_filter(spark):
    df = spark.createDataFrame(
        [("I", "Acme", "WORKS_AT", "Alice Example", "Organization"), ("Luke", "Google", "WORKS_AT", "Alice Example", "Person"), ("Kellogg", "Google", "WORKS_AT", "Alice Example", "Organization"), ("Acme", "Alice", "WORKS_AT", "Alice Example", "Organization"), ("Kellogg", "Google", "USES", "Alice Example", "Organization"), ("Kellogg", "Google", "WORKS_AT", None, "Organization")],
        "head string, tail string, rel_type string, speaker string, head_type string",
    )
    assert rows(shape.speaker_filter(df), "head", "tail", "rel_type") == [("Alice Example", "Acme", "WORKS_AT"), ("Alice Example", "Acme", "WORKS_AT"), ("Kellogg", "Google", "USES"), ("Kellogg", "Google", "WORKS_AT"), ("Luke", "Google", "WORKS_AT")]


def test_labels_and_constraints(spark):
    df = spark.createDataFrame([("Alice", "Acme", "employed by", "person", "organization"), ("Acme", "Alice", "works for", "organization", "person"), ("Alice", "X", "Founder  OF", "person", "gadget"), ("a", "b", "no such", "person", "person")], "head string, tail string, label string, head_type string, tail_type string")
    configured = spark.createDataFrame([("works at",), ("founded",)], "canonical string")
    found = shape.type_constraints(shape.canonical_labels(df, configured, shape.synonym_table(spark)))
    assert rows(found, "head", "canonical", "tail") == [("Alice", "founded", "X"), ("Alice", "works at", "Acme")]


def test_best_undirected(spark):
    df = spark.createDataFrame([("e", "Alice", "parent of", "Bob", 0.38, 0), ("e", "Bob", "parent of", "Alice", 0.31, 1)], "episode_id string, head string, label string, tail string, score double, pos int")
    assert rows(shape.best_directed(df), "head", "tail", "score") == [("Alice", "Bob", 0.38)]


def test_merge_and_rerank(spark):
    schema = "query_id int, entity string, score double"
    merged = retrieve.merge_results(spark.createDataFrame([(1, "Bob", 0.6)], schema), spark.createDataFrame([(1, "bob", 0.45), (1, "Carol", 0.58)], schema))
    assert rows(merged, "entity", "score", "source") == [("Bob", 0.6, "combined"), ("Carol", 0.58, "vector")]
    ready = spark.createDataFrame([(1, "Alice", 0.2, 1, 0.2, None, [], "Alice career background"), (1, "Carol", 0.9, 0, 0.0, None, [], "Alice career background"), (2, "Bob", 0.6, 3, 0.75, 1, ["WORKS_AT", "KNOWS", "USES"], "who is a friend at work with it"), (2, "Zed", 0.6, 3, 0.75, 2, [], "x")], "query_id int, entity string, score double, neighbors int, avg_strength double, hops int, rel_types array<string>, q string")
    got = {(r["query_id"], r["entity"]): (r["rank"], r["final"]) for r in retrieve.rerank(ready).collect()}
    assert got[1, "Alice"][0] == 1 and got[2, "Bob"][0] == 1
    base = 0.6 * (1 + __import__("math").log(4) * 0.1 + 0.75 * 0.2)
    assert abs(got[2, "Bob"][1] - (base + 0.30 + 0.10)) < 1e-6 and abs(got[2, "Zed"][1] - (base + 0.15)) < 1e-6


def test_hash_embedding(spark):
    import hashlib

    got = retrieve.hash_embedding(spark.createDataFrame([("a", "Alice met Alice"), ("b", "x")], "id string, text string"), 16).collect()
    for r, text in ((next(x for x in got if x["id"] == "a"), "alice met alice"), (next(x for x in got if x["id"] == "b"), "x")):
        want = [0.0] * 16
        for token in text.split():
            digest = hashlib.sha256(token.encode()).digest()
            for k in range(8):
                word = digest[4 * k : 4 * k + 4]
                want[int.from_bytes(word, "little") % 16] += 1.0 if word[0] % 2 == 0 else -1.0
        size = sum(x * x for x in want) ** 0.5
        assert all(abs(a - b / size) < 1e-5 for a, b in zip(r["embedding"], want, strict=True))


def test_fuzzy_match_loses_nothing(spark):
    rng = random.Random(5)
    names = [(f"e{i}", "Person", "".join(rng.choice("abcd ") for _ in range(rng.randint(4, 16))).strip() or "abcd") for i in range(60)]
    mentions = []
    for k in range(60):
        name = list(rng.choice(names)[2])
        if rng.random() < 0.7:
            name[rng.randrange(len(name))] = rng.choice("abcdé")
        mentions.append((k, "".join(name), "Person"))
    got = {r["k"]: (r["ratio"], r["id"]) for r in shape.fuzzy_match(spark.createDataFrame(mentions, "k long, mention string, entity_type string"), spark.createDataFrame([(*n, "x") for n in names], "id string, entity_type string, name string, alias string")).collect()}
    want = {}
    for k, m, _ in mentions:
        m = m.strip().lower()
        need = 0.95 if len(m) < 8 else 0.90 if len(m) < 12 else 0.85
        best = max((difflib.SequenceMatcher(None, m, n.strip().lower()).ratio(), i) for i, _, n in names)
        if best[0] >= need:
            want[k] = best[0]
    assert {k: r for k, (r, _) in got.items()} == want


def test_mentions_that_no_name_fits_in_length_make_no_keys(spark, monkeypatch):
    """Names of nobody, far longer than any known, leave before keys are made; the longest and shortest that fit stay."""
    asked, plain = [], shape._by_variants

    def counted(left, known):
        asked.extend(r["mention"] for r in left.select("mention").collect())
        return plain(left, known)

    monkeypatch.setattr(shape, "_by_variants", counted)
    monkeypatch.setattr(shape, "_by_letters", lambda *_: pytest.fail("no mention is left"))
    name = "abcdefghijklmnopq"  # 17 letters; a ratio of 0.85 allows 13 to 23
    said = [name + "x", name[:-1], *(f"{i:036}" for i in range(20)), "abc"]
    found = shape.fuzzy_match(spark.createDataFrame(list(enumerate(said)), "k long, mention string").withColumn("entity_type", F.lit("Person")), spark.createDataFrame([("p", "Person", name), ("o", "Other", "0" * 36)], "id string, entity_type string, name string"))
    assert {(r["k"], r["id"], round(r["ratio"], 6)) for r in found.collect()} == {(0, "p", round(34 / 35, 6)), (1, "p", round(32 / 33, 6))}
    assert sorted(asked) == sorted(said[:2])


def test_a_name_of_many_entities_is_met_once(spark, monkeypatch):
    pairs, plain = [], shape._by_variants
    monkeypatch.setattr(shape, "_by_variants", lambda left, known: (lambda met: (pairs.append(met.count()), met)[1])(plain(left, known)))
    known = spark.createDataFrame([(f"p{i:02}", "Person", "Alexandra Brown") for i in range(50)], "id string, entity_type string, name string")
    said = spark.createDataFrame([(1, "Alexandra Browne", "Person")], "k long, mention string, entity_type string")
    assert [(r["k"], r["id"]) for r in shape.fuzzy_match(said, known).collect()] == [(1, "p00")] and pairs == [1]


def test_fuzzy_match_of_names_alike(spark):
    """Names that share most letters, so that ties and near misses abound; every mention against every name."""
    rng = random.Random(11)
    names = [(f"e{i:03}", "Person", f"customer#{rng.randrange(10**9):09}") for i in range(70)] + [("zz", "Place", "customer#000000001")]
    mentions = [(k, (n := rng.choice(names)[2])[: (at := rng.randrange(len(n)))] + rng.choice(["x", "", "7q", "0"]) + n[at + rng.randrange(3) :], "Person") for k in range(70)]
    got = {r["k"]: (r["ratio"], r["id"]) for r in shape.fuzzy_match(spark.createDataFrame(mentions, "k long, mention string, entity_type string"), spark.createDataFrame([(*n, "x") for n in names], "id string, entity_type string, name string, alias string")).collect()}
    want = {}
    for k, m, _ in mentions:
        best = min((-difflib.SequenceMatcher(None, m, n).ratio(), i) for i, kind, n in names if kind == "Person")
        if -best[0] >= (0.95 if len(m) < 8 else 0.90 if len(m) < 12 else 0.85):
            want[k] = (-best[0], best[1])
    assert got == want and len(want) > 50


def test_mentions_that_overlap(spark):
    """Against the rule by pairwise comparison with the mentions kept so far."""
    rng = random.Random(6)
    words = ["ann", "anna", "bo", "bob", "lee", "an"]
    episodes = [(i, " ".join(rng.choice(words).title() for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(30, "")]
    mentions, want = [], []
    for i, text in episodes:
        parts = text.split(" ")
        found = [w for w in parts if w] + [f"{a} {b}" for a, b in zip(parts, parts[1:])] + ["nowhere", "ANN"]
        kept = []
        for pos, name in enumerate(found):
            mentions.append((i, pos, name))
            start = text.lower().find(name.lower())
            for other, begin in kept:
                a, b = other.lower(), name.lower()
                if a == b or (begin >= 0 and start >= 0 and begin < start + len(b) and start < begin + len(a) and (a in b or b in a)):
                    break
            else:
                kept.append((name, start))
                want.append((i, pos, name))
    got = shape.merge_mentions(spark.createDataFrame(mentions, "episode_id long, pos int, name string"), spark.createDataFrame(episodes, "episode_id long, content string"))
    assert rows(got) == sorted(want, key=repr)


def test_chunks_of_names(spark):
    chunks = spark.createDataFrame([(1, 0, "Anna met bob at Acme"), (1, 1, "ANNABEL only"), (1, 2, ""), (2, 0, "anna bob"), (3, 0, None)], "episode_id long, chunk_no int, chunk string")
    names = spark.createDataFrame([(1, "anna"), (1, "Bob"), (1, "Annabel"), (1, "cm"), (2, "anna"), (3, "anna"), (1, "anna"), (1, None)], "episode_id long, name string")
    assert rows(shape.assign_chunks(chunks, names)) == [(1, 0, ["Bob", "anna", "cm"]), (1, 1, ["Annabel", "anna"])]


def test_supersession_intervals_do_not_overlap(spark):
    df = spark.createDataFrame([("a", "WORKS_AT", "x", "2020-01-01"), ("a", "WORKS_AT", "x", "2020-01-20"), ("a", "WORKS_AT", "y", "2021-05-01"), ("b", "WORKS_AT", "x", "2020-01-01")], "src string, rel_type string, dst string, valid_from string").withColumn("valid_from", F.to_date("valid_from"))
    got = [(r["src"], str(r["opened"]), str(r["closed"]), r["status"], r["facts"]) for r in edges.supersede(df, ["src", "rel_type"]).orderBy("src", "opened").collect()]
    assert got == [("a", "2020-01-01", "2021-05-01", "historical", 2), ("a", "2021-05-01", "None", "current", 1), ("b", "2020-01-01", "None", "current", 1)]


def test_edge_upsert_is_idempotent_in_order(spark):
    data = [("a", "USES", "b", 0.1 * i, f"2020-01-0{i}", f"e{i % 3}", f"s{i}") for i in range(1, 6)]
    schema = "src string, rel_type string, dst string, confidence double, day string, episode_id string, snippet string"
    for shuffled in (data, data[::-1]):
        df = spark.createDataFrame(shuffled, schema)
        r = edges.upsert_edges(df, ["day"]).first()
        assert r["snippets"] == ["s3", "s4", "s5"] and r["n_episodes"] == 3 and r["mention_count"] == 5 and r["confidence"] == 0.5
        assert [x["episode_id"] for x in edges.edge_episodes(df, ["day"]).orderBy("first_at").collect()] == ["e1", "e2", "e0"]


def test_edge_upsert_into_a_stored_graph(spark):
    schema = "src string, rel_type string, dst string, confidence double, mention_count long, valid_from string, last_day string, valid_to string, audit_status string, snippets array<string>"
    base = spark.createDataFrame([("a", "USES", "b", 0.9, 4, None, "2019-12-01", "2019-12-31", "verified", ["x", "y"]), ("a", "USES", "c", 0.4, 1, "2019-01-01", "2019-02-01", "2019-03-01", None, [])], schema)
    new = spark.createDataFrame([("a", "USES", "b", 0.5, "2020-01-02", "e1", "s1"), ("a", "USES", "b", 0.6, "2020-01-03", "e1", "s2"), ("d", "USES", "b", 0.7, "2020-01-04", "e2", "s3")], "src string, rel_type string, dst string, confidence double, day string, episode_id string, snippet string")
    got = {(r["src"], r["dst"]): r for r in edges.upsert_edges(new, ["day"], base).collect()}
    again, left, fresh = got["a", "b"], got["a", "c"], got["d", "b"]
    assert (again["confidence"], again["mention_count"], again["valid_from"], again["valid_to"], again["audit_status"], again["snippets"], again["n_episodes"]) == (0.9, 6, "2020-01-02", None, "verified", ["y", "s1", "s2"], 1)
    assert (left["mention_count"], left["valid_to"], left["valid_from"], left["n_episodes"]) == (1, "2019-03-01", "2019-01-01", 0)
    assert (fresh["mention_count"], fresh["snippets"], fresh["valid_from"]) == (1, ["s3"], "2020-01-04")
    # the batch again over its own result only adds counts
    twice = edges.upsert_edges(new, ["day"], edges.upsert_edges(new, ["day"], base)).where("src = 'a' and dst = 'b'").first()
    assert twice["mention_count"] == 8 and twice["snippets"] == ["s2", "s1", "s2"]


def test_edge_upsert_deals_edges_once(spark):
    """Against brute force; one shuffle, and only of stored edges whose type the batch has."""
    rng = random.Random(3)
    pick = lambda xs, n: [rng.choice(xs) for _ in range(n)]
    keys = [(a, r, b) for a in "abc" for r in ("R", "S", "T") for b in "xy"]
    new = [(*k, round(rng.random(), 3), f"2020-01-{rng.randrange(10, 30)}", f"e{rng.randrange(6)}", i, f"s{i}") for i, k in enumerate(pick([k for k in keys if k[1] != "T"][:9], 80))]
    old = [(*k, 0.5, n + 1, None if n % 4 == 0 else "2019-01-01", "2019-05-01", "2019-06-01", "verified", ["p", "q", "r", "s"][: n % 5], [None, "e1", "old", "old"][: n % 5]) for n, k in enumerate(keys[3:])]
    more = [(*k, e) for k in keys for e in pick(["e1", "e2", "before"], 2)]
    batch = spark.createDataFrame(new, "src string, rel_type string, dst string, confidence double, day string, episode_id string, pos int, snippet string")
    base = spark.createDataFrame(old, "src string, rel_type string, dst string, confidence double, mention_count long, valid_from string, last_day string, valid_to string, audit_status string, snippets array<string>, episodes array<string>")
    rows = spark.createDataFrame(more, "src string, rel_type string, dst string, episode_id string")
    for episodes in ([], more):
        after = edges.upsert_edges(batch, ["day", "episode_id", "pos"], base, base_episodes=rows if episodes else None)
        want = {}
        for k in {r[:3] for r in new} | {r[:3] for r in old}:
            mine = sorted((r for r in new if r[:3] == k), key=lambda r: r[4:7])
            was = next((r for r in old if r[:3] == k), None)
            said = ((was[9] if was else []) + [r[7] for r in mine])[-3:]
            in_ = {r[5] for r in mine} | set(was[10] if was else []) | {m[3] for m in episodes if m[:3] == k}
            want[k] = (max([r[3] for r in mine] + ([was[3]] if was else [])), len(mine) + (was[4] if was else 0), (was and was[5]) or (mine[0][4] if mine else None), max([r[4] for r in mine] + ([was[6]] if was else [])), was[7] if was and not mine else None, was[8] if was else None, said, len(in_))
        assert {tuple(r)[:3]: tuple(r)[3:] for r in after.collect()} == want
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert plan[: plan.find("== Initial Plan ==")].count("Exchange hashpartitioning") == 1, plan


def test_mention_reopens_an_entity(spark):
    base = spark.createDataFrame([("a", "A", "Person", "aa", 0.5, 1, "2020-01-01", "2020-02-01", "2020-03-01"), ("b", "B", "Person", "bb", 0.5, 1, "2020-01-01", "2020-02-01", "2020-03-01")], "id string, name string, entity_type string, alias string, confidence double, mention_count long, first_day string, last_day string, valid_to string").withColumns({c: F.to_date(c) for c in ("first_day", "last_day", "valid_to")})
    delta = spark.createDataFrame([("a", "Ay", "Person", 0.7, "2020-05-01")], "id string, name string, entity_type string, confidence double, day string").withColumn("day", F.to_date("day"))
    assert {r["id"]: (str(r["valid_to"]), str(r["last_day"])) for r in edges.upsert_entities(base, delta).collect()} == {"a": ("None", "2020-05-01"), "b": ("2020-03-01", "2020-02-01")}


def test_path_lengths(spark):
    e = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d")], "src string, rel_type string, dst string")
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), ("a", "d"), ("a", "z")], "a string, b string")
    assert rows(traverse.path_lengths(e, p, 2)) == sorted([("a", "a", 0), ("a", "b", 1), ("c", "a", 2), ("a", "d", None), ("a", "z", None)], key=repr)


def test_path_lengths_against_search(spark):
    """Random graphs with a hub, all pairs, one to six hops."""
    rng = random.Random(4)
    names = [f"n{i}" for i in range(24)]
    links = {(rng.choice(names), rng.choice(names)) for _ in range(22)} | {("hub", n) for n in names[:6]}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def hops(a, b, most):
        front, seen = {a}, {a}
        for n in range(most + 1):
            if b in front:
                return n
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front

    e = spark.createDataFrame([(a, "R", b) for a, b in links], "src string, rel_type string, dst string")
    pairs = [(a, b) for a in (*names[::2], "hub", "zz") for b in (*names, "hub")]
    for most in (1, 3, 6):
        got = {(r["a"], r["b"]): r["hops"] for r in traverse.path_lengths(e, spark.createDataFrame(pairs, "a string, b string"), most).collect()}
        assert got == {(a, b): hops(a, b, most) for a, b in pairs}


def test_numbers_and_frames_of_large_groups(spark):
    from factgraph.functions.places import numbered

    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.randrange(50), i) for i in range(400)] + [(None, 1, 900), (None, 0, 901)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(5)
    got = {r["id"]: r["rn"] for r in numbered(df, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {i: n for n, (_, i) in enumerate(sorted((-v, i) for x, v, i in data if x == g), 1)}
    assert got == want
    log = spark.createDataFrame([(i % 2, i // 3, i, i % 4, i % 5) for i in range(300)], "epoch int, ts int, id int, fallbacks int, relations int").repartition(6)
    for block in (7, 1000):
        seen = {(r["id"]): (r["rn"], r["rows"], r["rate"]) for r in metrics.rolling_health(log, 5, block=block).collect()}
        for epoch in (0, 1):
            ids = list(range(epoch, 300, 2))
            for n, i in enumerate(ids):
                frame = ids[max(0, n - 4) : n + 1]
                rate = round(sum(x % 4 for x in frame) / max(1, sum(x % 5 for x in frame)), 6)
                assert seen[i][:2] == (n + 1, len(frame)) and abs(seen[i][2] - rate) < 1e-9


@pytest.mark.parametrize(
    ("change", "allow", "decision"),
    [({}, False, "healthy"), ({"completeness": 0.99}, False, "optimize"), ({"stuck": 3}, False, "refresh_embeddings"), ({"vector_entities": 700}, False, "reindex_embeddings"), ({"vector_entities": 300, "error_rate": 0.45}, False, "reindex_embeddings"), ({"vector_entities": 300, "error_rate": 0.45}, True, "rebuild_vectors")],
)
def test_infra_health(spark, change, allow, decision):
    base = {"graph_entities": 1000, "vector_entities": 1000, "completeness": 1.0, "pending": 0, "stuck": 0, "dead": 0, "error_rate": 0.0, "avg_ms": 90.0, "p95_ms": 120.0} | change
    got = metrics.infra_decision(spark.createDataFrame([tuple(base.values())], list(base)), allow).first()
    assert got["decision"] == decision and got["reasons"]


def test_rebalance(spark):
    data = [(i, 0, "WORKS_AT") for i in range(250)] + [(250 + i, 0, "CLASSMATE_OF") for i in range(5)]
    df = spark.createDataFrame(data, "row_no int, pos int, label string")
    capped = training.cap_label(df, "WORKS_AT", 100, 1.0)
    assert max(r["row_no"] for r in capped.where("label = 'WORKS_AT'").collect()) == 99
    counts = dict(rows(training.upsample(capped.select(F.col("row_no").cast("string").alias("id"), "label"), 30).groupBy("label").count()))
    assert counts == {"WORKS_AT": 100, "CLASSMATE_OF": 30}


def test_holdout_size(spark):
    for n, want in ((1, 1), (2, 1), (10, 2), (100, 20)):
        assert training.holdout(spark.range(n).withColumn("id", F.col("id").cast("string"))).where("held_out").count() == want


def test_verdicts_broken_and_cut_off(spark):
    raws = ['[{"index": 1, "verdict": "Verify"}, {"index": 9, "verdict": "delete"}]', '```json\n[{"index": 2, "verdict": "reclassify", "suggested_type": "works at"}]\n```', 'x [ "index": 1, "verdict": "delete"}, "index": 2, "verdict": "verify"}]', '[{"index": 1, "verdict": "quarantine"}, {"index": 2, "verd', "nothing", None]
    df = spark.createDataFrame([(i, r, 3) for i, r in enumerate(raws)], "batch_id int, raw string, batch_len int")
    assert rows(audit.parse_verdicts(df), "batch_id", "index", "verdict", "suggested_type") == [(0, 1, "verify", ""), (1, 2, "reclassify", "WORKS_AT"), (2, 1, "delete", ""), (2, 2, "verify", ""), (3, 1, "quarantine", "")]


def test_decision_prefilter(spark):
    df = spark.createDataFrame([("Let's go with the blue one instead of red, all agreed.", "chat"), ("Let’s go with the blue one instead of red, all agreed.", "promo_mail"), ("short", "chat"), (None, "chat"), ("Buy now and click here to get this limited time offer", "chat"), ("nothing was said here at all today", "chat")], "content string, source string")
    assert [r["reason"] for r in decisions.prefilter(df, ("promo",)).collect()] == ["matched", "blocked_source", "too_short", "empty_content", "promo_noise", "insufficient_signal"]


def test_contact_sentences(spark):
    df = spark.createDataFrame([("Ann Lee is a contact of Bob Ray. Employer: Acme Inc. Location: Oslo. Relationship: EMBA cohort.",), ("Ann Lee is a contact of Bob Ray. Relationship: met once.",), ("no contact",), (None,)], "content string")
    assert sorted(r["sentence"] for r in training.contact_sentences(df).collect()) == ["Ann Lee and Bob Ray are EMBA cohort", "Ann Lee is a contact of Bob Ray", "Ann Lee is located in Oslo", "Ann Lee works at Acme Inc"]


def test_chunks(spark):
    line = "Statement by {}: " + "words " * 30
    text = "Intro text. \n" + "\n".join(line.format(f"P{i}") for i in range(7))
    df = spark.createDataFrame([("a", text), ("b", "short"), ("c", " "), ("d", "long " * 100)], "id string, content string")
    got = {}
    for r in shape.chunk_messages(df).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert len(got["a"]) == 3 and got["a"][0].startswith("Intro text.") and got["a"][2].startswith("Statement by P5") and got["b"] == ["short"] and "c" not in got and len(got["d"]) == 1
    assert shape.chunk_messages(df, keep_head=False).where("id = 'a' and chunk_no = 0").first()["chunk"].startswith("Statement by P0")


def test_column_functions(spark):
    r = one(
        spark,
        ids=F.array(C.safe_id(F.lit(" A b/C-1 ")), C.safe_id(F.lit("")), C.safe_id(F.lit(None).cast("string"))),
        clamped=F.array(C.clamp(F.lit("0.7")), C.clamp(F.lit("x")), C.clamp(F.lit("9"))),
        names=C.distinct_ignoring_case(F.array(F.lit("Bob"), F.lit(" bob "), F.lit(""), F.lit("Al"))),
        p95=C.floor_percentile(F.array(*[F.lit(float(x)) for x in range(20)]), 95),
        none=C.floor_percentile(F.array().cast("array<double>"), 95),
        vector=C.fitted(F.array(F.lit(1.0).cast("float")), 3),
    )
    assert r["ids"] == ["a_b_c-1", "unknown", "unknown"] and r["clamped"] == [0.7, 0.0, 1.0] and r["names"] == ["Bob", "Al"] and r["p95"] == 19.0 and r["none"] is None and r["vector"] == [1.0, 0.0, 0.0]


def test_logs_and_archive(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-06-01", 3)], "date string, n int").withColumn("date", F.to_date("date"))
    logs.append_jsonl(df, f"{tmp_path}/log")
    (tmp_path / "log" / "date=2024-01-01" / "more.json").write_text('{"n": 9}\n\n{broken\n')
    back = logs.read_jsonl(spark, f"{tmp_path}/log", "n int, date date", "2024-01-01")
    assert rows(back, "n") == [(1,), (9,)]
    cutoff = F.lit("2024-03-01").cast("date")
    assert logs.archive(spark, df, f"{tmp_path}/archive", cutoff).count() == 2
    assert logs.archive(spark, df, f"{tmp_path}/archive", cutoff).count() == 0
    assert spark.read.json(f"{tmp_path}/archive").count() == 2
    for v in range(3):
        logs.save_snapshot(df.withColumn("v", F.lit(v)), f"{tmp_path}/state", v)
    assert logs.keep_versions(spark.read.parquet(f"{tmp_path}/state"), 2).select("version").distinct().count() == 2


def test_percentiles_sort_no_group_whole(spark):
    rng = random.Random(5)
    values = {"a": [rng.random() for _ in range(3000)], "b": [rng.choice([1.0, 2.0, 3.0]) for _ in range(500)], "c": [7.0], None: [4.0, 5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    got = metrics.percentiles(df, "v", ["k"], (0, 50, 95, 100))
    pick = lambda vs, p: sorted(vs)[min(len(vs) * p // 100, len(vs) - 1)]
    assert {tuple(r) for r in got.collect()} == {(k, *(pick(vs, p) for p in (0, 50, 95, 100))) for k, vs in values.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "windowspecdefinition" in line and "value#" in line]
    assert sorts and all("cell#" in line for line in sorts)


def test_floor_percentile_query_gathers_no_array(spark):
    from factgraph.plans import catalog

    plan = catalog.queries()["h9_floor_percentile"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_ingest_of_a_batch(spark):
    date = lambda df, *cs: df.withColumns({c: F.to_date(c) for c in cs})
    entities = date(spark.createDataFrame([("C1", "Alice Example", "Person", "Ally", 0.5, 2, "2020-01-01", "2020-02-01", "2020-06-01"), ("S1", "Acme Corporation", "Organization", "Acme", 0.6, 1, "2020-01-01", "2020-02-01", None)], "id string, name string, entity_type string, alias string, confidence double, mention_count long, first_day string, last_day string, valid_to string"), "first_day", "last_day", "valid_to")
    stored = date(spark.createDataFrame([("C1", "WORKS_AT", "S1", 0.4, 2, "2019-01-01", "2020-01-01", "2020-06-01", None, ["old"])], "src string, rel_type string, dst string, confidence double, mention_count long, valid_from string, last_day string, valid_to string, audit_status string, snippets array<string>"), "valid_from", "last_day", "valid_to")
    mentions = date(spark.createDataFrame([("e1", 0, "ally", "Person", 0.7), ("e1", 1, "Acme Corporatoin", "Organization", 0.8), ("e2", 0, "Bob New", "Person", 0.9), ("e2", 1, "ACME", "Organization", 0.3), ("e2", 2, "bob new", "Concept", 0.2), ("e2", 3, "x", "Person", 0.9)], "episode_id string, pos int, name string, entity_type string, confidence double").withColumn("day", F.lit("2021-03-01")), "day")
    relations = date(spark.createDataFrame([("e1", 0, "Ally", "Acme Corporatoin", "works at", 0.9, "session", "s1"), ("e2", 0, "Bob New", "acme", "works at", 0.6, "session", "s2"), ("e2", 1, "Bob New", "Nobody", "knows", 0.6, "session", "s3"), ("e1", 1, "Acme Corporatoin", "ally", "reports to", 0.3, "contacts_json", "s4")], "episode_id string, pos int, head string, tail string, label string, score double, source string, snippet string").withColumn("day", F.lit("2021-03-01")), "day")
    got = ingest.ingest_batch(mentions, relations, entities, stored)
    assert rows(got.mentions, "episode_id", "pos", "id", "how") == [("e1", 0, "C1", "name"), ("e1", 1, "S1", "fuzzy"), ("e2", 0, "bob_new", "new"), ("e2", 1, "S1", "name"), ("e2", 2, "bob_new", "new")]
    after = {r["id"]: r for r in got.entities.collect()}
    assert {i: (r["mention_count"], r["entity_type"], r["valid_to"]) for i, r in after.items()} == {"C1": (3, "Person", None), "S1": (3, "Organization", None), "bob_new": (2, "Person", None)}
    assert after["C1"]["confidence"] == 0.7 and after["C1"]["name"] == "Alice Example" and str(after["C1"]["last_day"]) == "2021-03-01"
    facts = {(r["src"], r["rel_type"], r["dst"]): r for r in got.edges.collect()}
    assert set(facts) == {("C1", "WORKS_AT", "S1"), ("bob_new", "WORKS_AT", "S1")}
    old = facts["C1", "WORKS_AT", "S1"]
    assert (old["mention_count"], old["confidence"], old["valid_to"], str(old["valid_from"]), old["snippets"]) == (3, 0.9, None, "2019-01-01", ["old", "s1"])
    assert rows(got.missing, "episode_id", "tail", "no_head", "no_tail") == [("e2", "Nobody", False, True)]


def test_fuzzy_match_of_new_names_makes_few_pairs(spark):
    """Names of one pattern that no known one is near: pairs that meet are in proportion to names, not to their product."""
    counts = {}
    for size in (400, 1600):
        rng = random.Random(size)
        known = spark.createDataFrame([(f"e{i}", "Person", f"customer#{i:09}") for i in range(size)], "id string, entity_type string, name string").withColumn("len", F.length("name")).withColumn("letters", shape._numbered_letters(F.col("name")))
        new = spark.createDataFrame([(i, "Person", f"vendor {rng.choice(['ltd', 'co', 'inc'])} #77{rng.randrange(10**7):07}") for i in range(size // 2)], "k long, entity_type string, mention string").withColumn("m_len", F.length("mention")).withColumn("letters", shape._numbered_letters(F.col("mention")))
        ranks = spark.createDataFrame([({},)], "ranks map<string,int>")
        met = shape._by_letters(shape._by_rarity(new, ranks), shape._by_rarity(known, ranks), None)
        counts[size] = met.count()
    assert counts[1600] <= 1600 and counts[400] <= 400
