import random

import corpus_pipeline as P
from factgraph.llm import bpe, decontaminate, quality


def corpus(spark, folder):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    item = " ".join(rng.choice(words) for _ in range(30))
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 20))) + "." for _ in range(4))
        if i % 4 == 0:
            text = text.replace(" ", "### ")
        if i % 10 == 1:
            text += "\nA line that many documents share."
        if i in (33, 43):
            text += "\n" + item
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    rows += [(500, rows[5][1].replace("\n", "  \n "), "en", "s", 1), (501, rows[6][1] + " x", None, None, None)]
    rows += [(502, None, "en", "s", 0), (503, "", "en", "s", 0), (None, rows[7][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_stages_one_by_one(spark, tmp_path):
    item = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {i for i in range(160) if i % 4}
    assert good - set(steps["quality"]) == set() and not any(i % 4 == 0 for i in steps["quality"] if i is not None and i < 160)
    shared = [i for i in sorted(x for x in steps["lines"] if x is not None) if "many documents share" in steps["lines"][i]["text"]]
    assert shared == [1] and all(r["n_chars"] == len(r["text"]) for r in steps["lines"].values())
    assert steps["lines"][500]["text"] == "" and set(steps["near_duplicates"]) >= good
    clean = {i for i, r in steps["near_duplicates"].items() if decontaminate.normalised(item) not in decontaminate.normalised(r["text"])}
    assert set(steps["decontamination"]) == clean and 33 not in clean
    known = bpe.vocabulary(bpe.default_path())
    assert {i: known.encode(r["text"]) for i, r in steps["decontamination"].items()} == {i: r["ids"] for i, r in steps["tokens"].items()}
    assert quality.THRESHOLD == 0.7


def test_run_gives_the_same_as_its_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(map(repr, P.run(spark, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))


def test_run_of_odd_tables(spark, tmp_path):
    """Empty tables; then a very long text, more columns with clashing names, repeated rows and nulls in every column."""
    fields = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, row string, kept string"
    for name, schema in (("documents", fields), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/{name}.parquet")
        if name != "documents":
            spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/odd/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/empty").count() == 0
    long = " ".join(f"w{i % 7919}x{i % 31}" for i in range(150_000))
    rows = [(1, long, "en", "s", len(long)), (2, "a short text of its own", "en", "s", 23), (2, "a short text of its own", "en", "s", 23), (3, None, None, None, None), (None, None, None, None, None), (4, "a short text of its own", "de", "t", 1)]
    spark.createDataFrame([(*r, "x", 0.5, None, "k") for r in rows], fields).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in P.run(spark, f"{tmp_path}/odd").collect())
    known = bpe.vocabulary(bpe.default_path())
    short = len(known.encode("a short text of its own"))
    # 4 is left empty by the line stage and is then a copy of 3, also empty
    assert got == sorted([(1, len(known.encode(long))), (2, short), (2, short), (3, 0), (-1, 0)])
