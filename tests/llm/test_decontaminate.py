import random
import time
import unicodedata
import warnings

import pyarrow as pa

from factgraph.llm import decontaminate as D

SCHEMA = "doc_id long, text string, row string, item_id string"


def plain_edits(segment, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain_form(text):
    """By itself: compatible forms, no signs of zero width, lower case, letters and digits with single spaces between."""
    text = unicodedata.normalize("NFKC", text or "") if not (text or "").isascii() else text or ""
    text = "".join(c for c in text if unicodedata.category(c) != "Cf" or c.isascii()).lower()
    return " ".join("".join(c if c.isalnum() else " " for c in text).split())


def plain(items, text):
    """{item number: segments within their budget} by whole alignments of every segment."""
    raw, out = plain_form(text), {}
    for k, (_, item) in enumerate(items):
        item, n = plain_form(item), 0
        size = min(60, len(item))
        if size < 12:
            continue
        budget = min(size * 5 // 100, (size - 12) // 12)
        for s in {*range(0, len(item) - size + 1, 20), len(item) - size}:
            n += plain_edits(item[s : s + size], raw) <= budget
        if n:
            out[k] = n
    return out


def corpus():
    rng = random.Random(8)
    words = ["alpha", "beta", "gam", "delta", "eps", "zeta", "eta", "theta", "io", "kappa", "lam", "mu"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((40, 30, 16, 12, 5, 3, 1))]
    texts = []
    for _ in range(40):
        item = rng.choice(items)[1].split()
        a = rng.randrange(max(1, len(item) - 10))
        part = list(" ".join(item[a : a + rng.randint(8, 40)]).upper())
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(part))
            part[at : at + rng.randint(0, 1)] = rng.choice(["", "x", ", ", "Q"])
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + "!\n" + "".join(part) + " " + " ".join(rng.choice(words) for _ in range(5)))
    return items, texts


def test_same_as_brute_force(monkeypatch):
    monkeypatch.setattr(D, "_PART", 100)
    monkeypatch.setattr(D, "_HITS", 60)
    items, texts = corpus()
    index = D.Index(items)
    assert [index.any(t) for t in texts] == [bool(plain(items, t)) for t in texts]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = [{k: n for k, n, *_ in index.matches(t)} for t in texts]
    assert got == [plain(items, t) for t in texts]
    assert sum(map(len, got)) > 15


def test_banded_alignment():
    rng = random.Random(9)
    for _ in range(300):
        segment = "".join(rng.choice("aé") for _ in range(rng.randint(1, 14)))
        region = "".join(rng.choice("aé") for _ in range(rng.randint(0, 20)))
        want = plain_edits(segment, region)
        for budget in (0, 1, 2, 3):
            assert D.banded(segment, region, budget)[0] == min(want, budget + 1), (segment, region, budget)


def test_report_blocks_and_edges(spark, monkeypatch):
    items, texts = corpus()
    rows = [(i, t, "r", "z") for i, t in enumerate(texts)] + [(100, None, "", ""), (101, "", "", ""), (None, items[0][1], "", ""), (102, items[0][1] + " x" * 300_000, "", ""), (103, "nothing of the kind in here at all", "", ""), (103, "nothing of the kind in here at all", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items] + [(None, "null id", "x"), (50, None, "x")], "item_id long, text string, doc_id string")
    one = sorted(map(tuple, D.find(docs, benchmark).collect()), key=repr)
    monkeypatch.setattr(D, "BLOCK_GRAMS", 250)
    assert sorted(map(tuple, D.find(docs, benchmark).collect()), key=repr) == one
    want = {(i, k) for i, t, *_ in rows for k in plain(items, t if i != 102 else items[0][1])}
    assert {(r[0], r[1]) for r in one} == want
    kept = D.decontaminate(docs, benchmark)
    bad = {i for i, _ in want}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, *_ in rows if i not in bad)


def test_empty_tables(spark):
    docs, benchmark = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.find(docs, benchmark).count() == 0 and D.decontaminate(docs, benchmark).count() == 0
    assert D.find(docs, spark.createDataFrame([(1, "some benchmark text of a length")], "item_id long, text string")).count() == 0


def test_typographic_signs():
    item = "The quick, brown fox doesn't jump - not once - over the lazy dog (\"said the author\"), as anyone will see."
    signs = "«…» The quick, brown fox doesn’t jump – not\u00a0once — over the lazy dog (“said the au\u00adthor”), as\u2009anyone will see… And more."
    accents = "Él está aquí, con la niña pequeña; jamás volverá a la montaña, según dijo el capitán general."
    index = D.Index([(1, item), (2, accents)])
    for text, n in ((signs, 0), (item.upper(), 0), (unicodedata.normalize("NFD", accents), 1), ("x " + accents.replace(";", " ·"), 1)):
        assert [(m[0], m[3]) for m in index.matches(text)] == [(n, 0)], text
        assert {n: index.count[n]} == plain([(1, item), (2, accents)], text)


def test_repetitive_text_against_repetitive_item(monkeypatch):
    monkeypatch.setattr(D, "_HITS", 1 << 16)
    rng = random.Random(3)
    item = "again and " * 800
    odd = " ".join(rng.choice(("agaim", "again", "and")) for _ in range(3000))
    index = D.Index([(1, item), (2, "aaaaaaaaaaaa" * 100)])
    assert len(index.segments) < 20
    sizes = []
    bands = D.Index._bands
    monkeypatch.setattr(D.Index, "_bands", lambda self, p, *a: sizes.append(len(p)) or bands(self, p, *a))
    for text in ("again and " * 40_000, "a" * 400_000, odd):
        begin = time.process_time()
        got = index.matches(text)
        assert time.process_time() - begin < 30
        if text is not odd:
            assert [(m[0], m[1] == m[2], m[3]) for m in got] == [(0 if text[1] == "g" else 1, True, 0)]
    assert max(sizes) < 1 << 14
    assert {k: n for k, n, *_ in index.matches(odd[:2000])} == plain([(1, item), (2, "aaaaaaaaaaaa" * 100)], odd[:2000])


def test_index_is_made_once_a_worker(spark):
    """Many tasks, few workers: each says which worker it ran in and how many indexes that worker has made."""
    index_of = D._sent(spark, [(1, "one two three four five six seven eight nine ten")])

    def look(batches):
        import os

        for batch in batches:
            index_of()
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([D.made], pa.int64())], ["pid", "made"])

    before = {r["pid"]: r["made"] for r in spark.range(16).repartition(4).mapInArrow(look_made, "pid long, made long").collect()}
    got = spark.range(64).repartition(32).mapInArrow(look, "pid long, made long").collect()
    assert len(got) >= 20
    most = {}
    for r in got:
        most[r["pid"]] = max(most.get(r["pid"], 0), r["made"])
    assert all(n - before.get(pid, 0) <= 1 for pid, n in most.items())


def look_made(batches):
    import os

    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([D.made], pa.int64())], ["pid", "made"])


def test_blocks_are_bounded_by_their_grams(spark, monkeypatch):
    benchmark = spark.createDataFrame([(i, f"item {i} " + "abc def " * 40) for i in range(20)], "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_GRAMS", 5000)
    n = D.n_blocks(benchmark)
    assert n > 2 and sorted(i for b in D.blocks(benchmark, "item_id", "text", n) for i, _ in b) == list(range(20))
