import numpy as np
from pyspark.sql import functions as F

from factgraph.llm import language as L

SCHEMA = "doc_id long, text string, lang string, id string, score string"


def plain_bundle(text, dim=64, n=3, seed=7):
    letters = L.Binder(dim, n, seed).letter
    low = [c if c.isalpha() else " " for c in text.lower()]
    clean = " " + " ".join("".join(low).split()) + " "
    total = np.zeros(dim)
    for i in range(len(clean) - n + 1):
        v = np.ones(dim)
        for p, c in enumerate(clean[i : i + n]):
            v *= np.roll(letters(ord(c)), n - 1 - p)
        total += v
    return total


def test_bundle_is_the_sum_over_all_ngrams(monkeypatch):
    monkeypatch.setattr(L, "_KEEP", 40)
    binder = L.Binder(64)
    for text in ("Hello, wörld 42! ÉÉ", "a", "日本 語", "the quick brown fox jumps over the lazy dog " * 20):
        assert np.allclose(binder.bundle(text), plain_bundle(text))
    assert binder.bundle(None) is None and binder.bundle("") is None and binder.bundle("12 -- 7") is None


def test_learns_and_handles_edges(spark):
    rows = []
    for i in range(60):
        rows.append((i, " ".join(["the", "and", "thing", "with", f"heath{i}"] * 5), "en", "x", "y"))
        rows.append((100 + i, " ".join(["der", "und", "schön", "nicht", f"ung{i}"] * 5), "de", "x", "y"))
    rows += [(300, None, "en", "", ""), (301, "123 !!", "de", "", ""), (302, "und der schön", None, "", ""), (302, "und der schön", None, "", ""), (None, "the and with", None, "", ""), (303, "the thing " * 100_000, None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    prototypes = L.learn(docs, F.col("doc_id") % 2 == 0, sample=20)
    assert sorted(prototypes) == ["de", "en"]
    got = L.predict(docs, prototypes).collect()
    assert len(got) == len(rows)
    by = {r["id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(by[i][0] == "en" and by[100 + i][0] == "de" for i in range(60))
    assert by[300] == by[301] == ("und", 0.0) and by[302][0] == "de" and by[None][0] == "en" and by[303][0] == "en"
    assert all(0 <= s <= 1 for _, s in by.values())
    empty = spark.createDataFrame([], SCHEMA)
    assert L.learn(empty, F.lit(True)) == {} and L.predict(empty, prototypes).count() == 0
    assert {r["lang_pred"] for r in L.predict(docs, {}).collect()} == {"und"}


def test_long_text_is_one_text(monkeypatch):
    text = "The quick, brown fox—jumps 12 over ÉÉ the lazy dog. " * 9
    for part in (1, 2, 3, 7, 50):
        monkeypatch.setattr(L, "_PART", part)
        assert np.allclose(L.Binder(64).bundle(text), plain_bundle(text))
        assert L.Binder(64).bundle("42 .. " * 20) is None


def test_learning_and_prediction_against_plain_sums(spark):
    """Prototypes are unit sums of unit bundles, predictions the greatest cosine, all by plain loops."""
    words = {"en": ["the", "and", "thing", "with", "heath"], "de": ["der", "und", "schön", "nicht", "ung"], "fr": ["le", "été", "que", "nous", "eau"]}
    rows = [(i, " ".join(words[lang][(i * k) % 5] for k in range(1, 9)) + f" {lang}x", lang, "", "") for i, lang in enumerate(list(words) * 8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    unit = lambda v: v / np.linalg.norm(v)
    plain = {lang: unit(sum(unit(plain_bundle(t)) for i, t, x, *_ in rows if x == lang and i % 4 != 1)) for lang in words}
    got = L.learn(docs, F.col("doc_id") % 4 != 1, dim=64)
    assert sorted(got) == sorted(plain) and all(np.allclose(got[x], plain[x]) for x in plain)
    for r in L.predict(docs, got, dim=64).collect():
        cosine = {x: float(plain[x] @ unit(plain_bundle(rows[r["id"]][1]))) for x in plain}
        best = max(cosine.values())
        assert abs(cosine[r["lang_pred"]] - best) < 1e-9 and abs(r["score"] - max(0, best)) < 1e-6


def test_an_id_with_two_languages_teaches_each_its_own(spark):
    rows = [(i, text, lang) for i in range(4) for lang, text in (("a", "aba baba abab"), ("b", "xyz zyx xxyz"))]
    schema = "doc_id long, text string, lang string"
    same = L.learn(spark.createDataFrame(rows, schema), F.lit(True))
    apart = L.learn(spark.createDataFrame([(2 * i + (lang == "b"), text, lang) for i, text, lang in rows], schema), F.lit(True))
    assert abs(float(same["a"] @ same["b"]) - float(apart["a"] @ apart["b"])) < 1e-9
    assert L.learn(spark.createDataFrame([], schema), F.lit(True)) == {} and set(L.learn(spark.createDataFrame([(None, "ab", "a"), (1, "cd", "c"), (1, "cd", "c")], schema), F.lit(True))) == {"c"}
