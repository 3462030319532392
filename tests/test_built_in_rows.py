"""Entities built in the row of their episode: the rows of the general operators, with no shuffle."""

import random

from pyspark.sql import functions as F

from factgraph.operators import shape
from factgraph.plans import catalog


def rows_of(df):
    return sorted((r["episode_id"], r["name"], r["entity_type"], r["confidence"]) for r in df.collect())


def test_rows_are_those_of_the_general_operators(spark):
    rng = random.Random(4)
    words = ["Ann", "ann ", " ANN", "a  nn", "x", "", None, "Bo", "bo", "Straße", "it"]
    episodes = [(e, [(rng.choice(words), rng.choice(["Person", "Gadget", None]), rng.choice([-0.5, 0.25, 0.5, 3.0])) for _ in range(rng.randrange(30))], rng.choice(["Ann", "it", "Zoe  Z", "", "  ", None])) for e in range(60)]
    episodes += [(60, None, "Ann"), (61, [], "Bo"), (62, None, None)]
    lists = spark.createDataFrame(episodes, "episode_id long, items array<struct<text:string,entity_type:string,score:double>>, speaker string")
    mentions = lists.select("episode_id", F.posexplode("items").alias("pos", "m")).select("episode_id", "pos", "m.*")
    plain = shape.build_entities(mentions)
    assert rows_of(shape.built_in_rows(lists)) == rows_of(plain)
    assert rows_of(shape.built_in_rows(lists, speaker="speaker")) == rows_of(shape.add_speaker(plain, lists.select("episode_id", "speaker")))


def test_queries_shuffle_nothing(spark):
    for name in ("f3_n1_build_entities", "f4_add_speaker"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
