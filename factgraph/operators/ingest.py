"""Ingest of a batch as one flow: resolution, entity upsert, relation shaping, gate and edge upsert into a stored graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions.places import written
from factgraph.functions.sizes import small
from factgraph.operators import edges as E
from factgraph.operators import retrieve, shape, traverse
from factgraph.sources.graph_store import GraphStore


class Ingested(NamedTuple):
    """Tables after a batch: entities, edges, mentions with the id they stand for, relations with an end that no mention names."""

    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame
    missing: DataFrame


def resolve_batch(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions (episode_id, pos, name, entity_type, …) with id and how they were resolved: name, fuzzy or new.

    All mentions are resolved against the stored entities: by name or alias, else by the most similar name of their
    type. What is left becomes an entity for each normalised name, of the type of its first mention (by episode_id and
    pos). Blocked names go.
    """
    rows = mentions.where(~C.blocked_name(F.col("name"))).withColumn("key", C.normal_name(F.col("name")))
    asked = written(rows.groupBy("key").agg(F.min(F.struct("episode_id", "pos", "entity_type")).alias("first")).select("key", "first.entity_type"), "asked")
    exact = asked.join(traverse.names_of(entities).select("key", "id").hint("merge"), "key", "left")
    rest = written(exact.where("id is null").select(F.xxhash64("key").alias("k"), "key", "entity_type"), "rest")
    near = shape.fuzzy_match(rest.select("k", F.col("key").alias("mention"), "entity_type"), entities).select("k", F.col("id").alias("near"))
    others = rest.join(near.hint("merge"), "k", "left").select("key", F.coalesce("near", C.safe_id(F.col("key"))).alias("id"), F.when(F.col("near").isNotNull(), "fuzzy").otherwise("new").alias("how"), F.when(F.col("near").isNull(), F.col("entity_type")).alias("kind"))
    known = exact.where("id is not null").select("key", "id", F.lit("name").alias("how"), F.lit(None).cast("string").alias("kind"))
    joined = rows.join(small(written(known.unionByName(others), "resolved")), "key")  # few names need no shuffle of mentions
    return joined.withColumn("entity_type", F.coalesce("kind", "entity_type")).drop("key", "kind")


class Shaped(NamedTuple):
    """What a batch says: mentions with their ids, observations of edges, all gated relations, relations with an end that no mention names."""

    mentions: DataFrame
    observed: DataFrame
    gated: DataFrame
    missing: DataFrame


def _sure(rows: DataFrame, score: str) -> DataFrame:
    """Rows whose score reaches the least confidence of their source, if they have one."""
    return rows.where(F.col(score) >= C.min_confidence(C.normal_source(F.col("source")))) if "source" in rows.columns else rows


def shape_batch(mentions: DataFrame, relations: DataFrame, entities: DataFrame, second: DataFrame | None = None, labels: DataFrame | None = None) -> Shaped:
    """Mentions and relations between names of a batch, resolved against stored entities, filtered, shaped and gated.

    Mentions and relations under the least confidence of their source go. With a speaker, relations that are anchored
    in the speaker are turned to or dropped. Second-pass relations (of labels, a catalogue) get canonical labels, keep
    to the types that their label allows, and the best of a pair takes the place of the first pass's. What is allowed
    by the gate is observed, each end by its entity.

    Mentions and relations are dealt once, by episode, which serves both ends and the triples of an episode; the names
    of an episode are those of one document and meet its relations as one map.
    """
    found = written(resolve_batch(_sure(mentions, "confidence"), entities), "mentions")
    ends = found.repartition("episode_id").groupBy("episode_id", C.normal_name(F.col("name")).alias("key")).agg(F.min(F.struct("pos", "id", "entity_type")).alias("e"))
    ends = ends.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "e"))).alias("ends"))  # one document's names

    def ended(rows: DataFrame) -> DataFrame:
        end = lambda side: F.try_element_at("ends", C.normal_name(F.col(side)))
        met = rows.join(ends.hint("merge"), "episode_id", "left").withColumns({f"{side}_end": end(side) for side in ("head", "tail")}).drop("ends")
        return met.select("*", *(F.col(f"{side}_end")[c].alias(f"{side}_{as_}") for side in ("head", "tail") for c, as_ in (("id", "id"), ("entity_type", "type")))).drop("head_end", "tail_end")

    rows = _sure(relations, "score")
    if second is not None:
        typed = ended(_sure(second, "score"))
        canonical = shape.type_constraints(shape.canonical_labels(typed, labels, shape.synonym_table(second.sparkSession)))
        best = shape.best_directed(canonical.withColumn("label", F.col("canonical")).select(*rows.columns))
        rows = shape.override(rows, best).select(*rows.columns)
    if "speaker" in rows.columns:
        spoken = ended(rows).withColumn("rel_type", C.normal_relation(F.col("label")))
        rows = shape.speaker_filter(spoken).select(*(c for c in relations.columns))
    both = ended(rows)
    whole = F.col("head_id").isNotNull() & F.col("tail_id").isNotNull()
    missing = both.where(~whole).select("episode_id", "head", "label", "tail", F.col("head_id").isNull().alias("no_head"), F.col("tail_id").isNull().alias("no_tail"))
    gated = written(shape.build_relations(both.where(whole).withColumn("head", F.col("head_id")).withColumn("tail", F.col("tail_id"))), "gated")
    observed = gated.where("decision = 'allow'").select(F.col("head").alias("src"), "rel_type", F.col("tail").alias("dst"), "confidence", "snippet", "episode_id", "pos", "day")
    return Shaped(found, observed, gated, missing)


def ingest_batch(mentions: DataFrame, relations: DataFrame, entities: DataFrame, edges: DataFrame) -> Ingested:
    """The graph after a batch of mentions (episode_id, pos, name, entity_type, confidence, day[, source]) and relations between names.

    relations: (episode_id, pos, head, tail, label, score, source, snippet, day[, speaker]). Relations whose ends are
    mentioned in their episode are shaped and gated; those that are allowed merge into the edges.
    """
    batch = shape_batch(mentions, relations, entities)
    after = E.upsert_entities(entities, batch.mentions.select("id", "name", "entity_type", "confidence", "day"))
    return Ingested(after, E.upsert_edges(batch.observed, ["day", "episode_id", "pos"], edges), batch.mentions, batch.missing)


#: Relations of which a source has one at a time.
SINGLE = ("WORKS_AT", "LOCATED_IN")


def newest(states: DataFrame, key: str) -> DataFrame:
    """Rows of the newest version of each key."""
    others = [c for c in states.columns if c not in (key, "version")]
    return states.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("row")).select(key, "row.*")


def graph_store(spark: SparkSession, path: str, **kw) -> GraphStore:
    """The stored graph that ``ingest_into`` writes: entities, edges, their episodes, vectors, and the state of episodes."""
    merges = {"entities": E.merge_entities, "edges": E.merge_edges, "seen_in": E.merge_episodes, "vectors": lambda s: newest(s, "id"), "episodes": lambda s: newest(s, "episode_id")}
    keys = {"entities": ["id"], "edges": E.EDGE, "seen_in": [*E.EDGE, "episode_id"], "vectors": ["id"], "episodes": ["episode_id"]}
    return GraphStore(spark, path, merges, keys=keys, **kw)


def ingest_into(store: GraphStore, number: int, mentions: DataFrame, relations: DataFrame, single: tuple[str, ...] = SINGLE, second: DataFrame | None = None, labels: DataFrame | None = None) -> Shaped | None:
    """One batch into a stored graph, in two versions: its episodes as incomplete, then all that it says and they as complete.

    A batch that was done is left alone; one that failed in between shows its episodes as incomplete until it is played
    again. What is written is the batch's own: entities and edges that it touches, new episodes of edges, vectors of
    the entities it mentions, and the ends of single-valued facts that its newer ones supersede.
    """
    opened, closed = 2 * number + 1, 2 * number + 2  # version 0 is what was there before
    if closed in store.versions():
        return None
    state = written(mentions.select("episode_id").union(relations.select("episode_id")).distinct(), "state")
    store.commit(opened, {"episodes": state.select("episode_id", F.lit(True).alias("incomplete"), F.lit(None).cast("long").alias("n_mentions"), F.lit(None).cast("long").alias("n_relations"))})
    batch = shape_batch(mentions, relations, store.table("entities"), second, labels)
    observed = written(batch.observed, "observed")
    order = ["day", "episode_id", "pos"]
    rows, entities = written(E.edge_rows(observed, order), "edges"), written(E.entity_rows(batch.mentions.select("id", "name", "entity_type", "confidence", "day")), "entities")
    deltas = {"entities": entities, "seen_in": E.edge_episodes(observed, order)}
    known = store.table("edges")
    touched = rows.where(F.col("rel_type").isin(*single)).select("src", "rel_type").distinct()
    facts = rows.withColumn("version", F.lit(1)) if known is None else rows.withColumn("version", F.lit(1)).unionByName(known.withColumn("version", F.lit(0)))
    facts = written(E.merge_edges(facts.join(touched.hint("merge"), ["src", "rel_type"], "left_semi")), "facts")
    ends = E.closures(facts.where("valid_to is null"))
    # a fact that ends is a state that adds nothing but its end
    ended = facts.join(ends.hint("merge"), E.EDGE).select(*E.EDGE, "confidence", F.lit(0).cast("long").alias("mention_count"), "valid_from", "last_day", F.col("closed").alias("valid_to"), "audit_status", F.array().cast("array<string>").alias("snippets"))
    # only single-valued facts can have ended: the batch's other edges are as they are and need not meet anything
    may_end = F.coalesce(F.col("rel_type").isin(*single), F.lit(False))
    own = E.merge_edges(rows.where(may_end).withColumn("version", F.lit(0)).unionByName(ended.withColumn("version", F.lit(1))))
    deltas["edges"] = own.unionByName(rows.where(~may_end).select(*own.columns))
    text = F.concat_ws(" ", "name", "entity_type")
    deltas["vectors"] = retrieve.hash_embedding(entities.select("id", text.alias("text")))
    said = lambda df, m, r: df.select("episode_id", F.lit(m).cast("long").alias("m"), F.lit(r).cast("long").alias("r"))
    final = said(state, 0, 0).union(said(batch.mentions, 1, 0)).union(said(observed, 0, 1)).groupBy("episode_id").agg(F.sum("m").alias("n_mentions"), F.sum("r").alias("n_relations"))
    deltas["episodes"] = final.select("episode_id", F.lit(False).alias("incomplete"), "n_mentions", "n_relations")
    store.commit(closed, deltas)
    return batch


def incomplete_episodes(store: GraphStore) -> DataFrame:
    """Episodes that a batch has begun and not finished."""
    return store.table("episodes").where("incomplete").select("episode_id")
