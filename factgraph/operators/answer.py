"""From questions to ranked facts in one flow: names, exact and loose matches, dense search, merging, graph-aware ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions.places import written
from factgraph.functions.sizes import containing, small
from factgraph.operators import retrieve, traverse

#: Names of a question that are looked up, entities that a loose name may bring, and facts of a result of either side.
NAMES, LOOSE, GRAPH_FACTS, VECTOR_FACTS = 5, 5, 10, 5
#: Score of a result that no search has scored.
UNSCORED = 0.5


def facts_of(ids: DataFrame, edges: DataFrame, as_of: Column, top: int = GRAPH_FACTS) -> DataFrame:
    """(id, facts) of ids that have facts at a day: the strongest, as (rel_type, target, strength), at most ``top``."""
    own = edges.join(small(ids.select(F.col("id").alias("src")).distinct()), "src", "left_semi")  # only their edges are ranked
    best = traverse.current_facts(own, as_of, top=top)
    fact = F.struct("rank", "rel_type", F.col("dst").alias("target"), "strength")
    listed = F.transform(F.array_sort(F.collect_list(fact)), lambda f: F.struct(f["rel_type"].alias("rel_type"), f["target"].alias("target"), f["strength"].alias("strength")))
    return best.groupBy(F.col("src").alias("id")).agg(listed.alias("facts"))


def entity_vectors(entities: DataFrame, dim: int = 64) -> DataFrame:
    """(id, embedding) of what an entity is called, its type and the beginning of its description."""
    text = F.concat_ws(" ", "name", "entity_type", F.substring("description", 1, 200))
    return retrieve.hash_embedding(entities.select("id", text.alias("text")), dim)


def graph_branch(questions: DataFrame, entities: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """(query_id, id, place, source, facts): entities that a question names, by name or alias; where none of them has facts, those whose name contains the earliest name that brings some."""
    names = written(retrieve.question_names(questions).where(F.col("pos") < NAMES), "names")
    exact = names.join(traverse.names_of(entities).hint("merge"), C.normal_name(F.col("name")) == F.col("key")).groupBy("query_id", "id").agg(F.min("pos").alias("place"))
    exact = written(exact, "exact")
    exact = written(exact.join(facts_of(exact, edges, as_of).hint("merge"), "id").withColumn("source", F.lit("graph_exact")), "exact_facts")
    rest = names.join(exact.select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    rest = written(rest.withColumn("asked", F.concat_ws(":", F.col("query_id").cast("string"), F.col("pos").cast("string"))), "rest")
    named = entities.select("id", F.col("name").alias("entity"))
    met = containing(named, [F.col("entity")], rest, F.col("name"), "asked").select("query_id", "pos", "id", "entity").distinct()
    first = F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("entity", "id"))
    loose = written(met.withColumn("n", first).where(F.col("n") <= LOOSE), "loose")
    loose = loose.join(facts_of(loose, edges, as_of).hint("merge"), "id")
    least = F.min("pos").over(Window.partitionBy("query_id"))  # at most NAMES times LOOSE rows a question
    loose = loose.withColumn("least", least).where("pos = least").select("query_id", "id", F.col("n").alias("place"), F.lit("graph_fuzzy").alias("source"), "facts")
    return exact.select("query_id", "id", "place", "source", "facts").unionByName(loose)


def vector_branch(questions: DataFrame, vectors: DataFrame, edges: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """(query_id, id, place, source, facts, score): the entities most like a question that have facts.

    vectors: (id, embedding), of the same embedding as the question's text.
    """
    numbered = vectors.select("id", "embedding").withColumn("vec_id", F.xxhash64("id"))
    asked = retrieve.hash_embedding(questions.select(F.col("query_id").alias("id"), F.col("q").alias("text"))).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    near = retrieve.dense_search(numbered, asked, k).join(numbered.select("vec_id", "id").hint("merge"), "vec_id")
    near = written(near.select("query_id", "id", "rank", "score"), "near")
    found = near.join(facts_of(near, edges, as_of).hint("merge"), "id")
    return found.select("query_id", "id", F.col("rank").alias("place"), F.lit("vector").alias("source"), F.slice("facts", 1, VECTOR_FACTS).alias("facts"), "score")


def answer(questions: DataFrame, entities: DataFrame, edges: DataFrame, vectors: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    """(query_id, rank, id, entity, source, score, final, facts) of questions (query_id, q): the facts that answer them.

    Graph results come first and vector results fill the gaps, an entity once, ``limit`` of them; these are ranked by
    what the graph says of them. edges need strength. Questions without results give no rows; null questions neither.
    """
    questions = questions.where("q is not null")
    both = graph_branch(questions, entities, edges, as_of).withColumn("score", F.lit(UNSCORED)).withColumn("side", F.lit(0))
    both = both.unionByName(vector_branch(questions, vectors, edges, as_of).withColumn("side", F.lit(1)))
    once = both.groupBy("query_id", "id").agg(F.min_by(F.struct("side", "place", "source", "facts", "score"), F.struct("side", "place")).alias("r"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("r.side", "r.place", "id"))
    kept = once.withColumn("n", order).where(F.col("n") <= limit).select("query_id", "id", "r.source", "r.facts", "r.score")
    named = kept.join(entities.select("id", F.col("name").alias("entity")).hint("merge"), "id")
    rel_types = F.array_distinct(F.transform("facts", lambda f: f["rel_type"]))
    ready = written(named.withColumn("rel_types", rel_types), "found")
    ranked = retrieve.graph_rerank(ready.select("query_id", "id", "entity", "score", "rel_types"), questions, entities, edges)
    return ranked.select("query_id", "id", "entity", "score", "final", "rank").join(ready.select("query_id", "id", "source", "facts").hint("merge"), ["query_id", "id"])


def retrieval_source(answers: DataFrame) -> DataFrame:
    """(query_id, source, results, graph_results, names): what a log says of each question."""
    graph = F.count_if(F.col("source") != "vector")
    label = F.when((graph > 0) & (graph < F.count("*")), "combined").otherwise(F.min("source"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda r: r["entity"]), "|")
    return answers.groupBy("query_id").agg(label.alias("source"), F.count("*").alias("results"), graph.alias("graph_results"), names.alias("names"))
