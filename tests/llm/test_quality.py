import random

import numpy as np
from pyspark.sql import functions as F

from factgraph.llm import quality as Q

SCHEMA = "doc_id long, text string, row string, score string"


def corpus():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) + "."
        if i % 4 == 0:
            text = text.replace(" ", "### ") if i % 8 else " ".join(["same"] * 60)
        rows.append((i, text, "r", "s"))
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    return rows, labels


def test_learns_from_train_rows_only_and_scores_all(spark):
    rows, labels = corpus()
    edges = [(900, None, "", ""), (901, "", "", ""), (901, "", "", ""), (None, "a word", "", ""), (902, "word " * 50_000, "", "")]
    docs = spark.createDataFrame(rows + edges, SCHEMA)
    marked = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    wrong = marked.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    model, same = Q.learn(docs, marked, Q.train_rows()), Q.learn(docs, wrong, Q.train_rows())
    assert np.array_equal(model.weights, same.weights)
    got = {r["id"]: r["score"] for r in Q.score(docs, model).collect()}
    right = [(got[i] >= 0.7) == bool(q) for i, q, _ in labels]
    assert sum(right) / len(right) > 0.97 and all(0 <= s <= 1 for s in got.values())
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}


def test_cut_is_the_quantile_of_bad_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(Q.FEATURES)))
    good = x[:, 0] + 0.5 * rng.normal(size=500) > -0.5
    model = Q.fit(x, good)
    assert (model.score(x) < 0.7).sum() == (~good).sum()
    assert ((model.score(x) >= 0.7) == good).mean() > 0.85


def test_one_class_and_empty(spark):
    x = np.ones((3, len(Q.FEATURES)))
    assert (Q.fit(x, np.ones(3, bool)).score(x) >= 0.7).all() and (Q.fit(x, np.zeros(3, bool)).score(x) < 0.7).all()
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.learn(docs, labels, Q.train_rows())
    assert Q.score(docs, model).count() == 0 and len(Q.features("x")) == len(Q.FEATURES)


def plain_features(text):
    """Each feature by itself, by plain loops over bytes, words and lines."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(Q.FEATURES)
    share = lambda good: sum(map(good, raw)) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    upper, lower = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122 or b >= 128)
    cut = [min(40, len(w)) for w in words] or [0]
    mean = sum(cut) / len(cut)
    lines = raw.split(b"\n")
    top = max((words.count(w) for w in set(words)), default=0)
    plain = b"#$%&*@^~=+<>|_\\/!"
    stops = share(lambda b: b in b".,;:'\"-()?")
    spaces = share(lambda b: b in b" \t\n\x0b\x0c\r")
    digits, marks, pipes = share(lambda b: 48 <= b <= 57), share(lambda b: b == 33), share(lambda b: b == 124)
    odd = 1 - upper - lower - spaces - digits - marks - pipes - stops
    return [
        np.log(1 + len(words)), upper + lower, upper / max(1e-9, upper + lower), digits, spaces, odd, sum(w[-1] in plain for w in words) / n, marks, pipes,
        sum(w.isupper() for w in words) / n, len(set(words)) / n**0.8, sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n, top / n, mean / 10,
        (sum((c - mean) ** 2 for c in cut) / len(cut)) ** 0.5 / 10, np.log(1 + len(words) / len(lines)), sum(len(x) < 20 for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines), sum(b == 46 for b in raw) / n, stops, sum(len(w) > 25 for w in (words or [b""])) / max(1, len(words)),
    ]


def test_features_against_plain_loops():
    rng = random.Random(3)
    texts = ["", None, " ", "a", "AB cd\n\ncd cd!", "x" * 60 + " |# 12,34\tÉté ... A-B\nA-B", "\n\n", "word. " * 50]
    texts += ["".join(rng.choice("abcXYZ0189 .,!|#\n\té") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    for t in texts:
        assert np.allclose(Q.features(t), plain_features(t), atol=1e-9), t


def test_weights_minimise_the_pair_loss():
    """The logistic loss over the same pairs, by plain sums: no small step in any direction lowers it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, len(Q.FEATURES)))
    good = x[:, 1] - x[:, 4] + rng.normal(size=200) > 0
    model = Q.fit(x, good, pairs=400, seed=5)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    draw = np.random.default_rng(5)
    winners, losers = draw.choice(np.flatnonzero(good), 400), draw.choice(np.flatnonzero(~good), 400)

    def loss(w):
        margins = [float((z[a] - z[b]) @ w) for a, b in zip(winners, losers)]
        return sum(np.log1p(np.exp(-m)) for m in margins) / 400 + Q.RIDGE / 2 * float(w @ w)

    least = loss(model.weights)
    for i in range(len(Q.FEATURES)):
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) >= least


def test_ties_at_the_cut_stay_together():
    bad = np.zeros(4, bool)
    for good, up in ((np.array([1, 1, 1, 0, 0, 0, 0, 1], bool), False), (np.array([1, 1, 1, 1, 0, 1, 1, 0], bool), True)):
        raw = np.array([9, 8, 7, 5, 5, 5, 1, 5.0])
        cut = Q.quantile_cut(raw, good)
        assert cut not in raw and ((raw == 5) > (raw > cut)).any() != up
    raw = np.ones(8)
    assert Q.quantile_cut(raw, np.r_[bad, ~bad]) < 1 and Q.quantile_cut(raw, np.r_[bad, bad[:1], ~bad[:3]]) > 1


def test_repeated_rows_of_a_sampled_id_count_once(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + rows[:50] * 5, SCHEMA)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = Q.learn(spark.createDataFrame(rows, SCHEMA), marked, Q.train_rows())
    assert np.array_equal(once.weights, Q.learn(docs, marked, Q.train_rows()).weights)
