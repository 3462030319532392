"""Nightly maintenance of a stored graph and the training examples that grow with it, a version a night.

A night reads the graph once a step and writes only what it changes: keys that go, edges that an audit marks or moves,
vectors that are missing, examples that are new or lose a relation. All of it is one commit, so readers see a night
whole or not at all, and a night that is played again changes nothing. Strength is a function of count, last day and
type (``edges.decay_edges``), so decay writes no rows: the night reports it as of its day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.functions.places import written
from factgraph.functions.sizes import SMALL_ROWS, small
from factgraph.operators import audit as A
from factgraph.operators import edges as E
from factgraph.operators import ingest, metrics, retrieve, training
from factgraph.sources.graph_store import GraphStore
from factgraph.streaming import state

#: From prompts (batch_no, prompt) to responses (batch_no, raw).
Answer = Callable[[DataFrame], DataFrame]
RELATIONS = "array<struct<head:string,label:string,tail:string>>"


def maintained_store(spark: SparkSession, path: str, **kw) -> GraphStore:
    """The stored graph of ``ingest.graph_store`` with the tables of its nights: audits, signals, examples, taken, nights."""
    store = ingest.graph_store(spark, path, **kw)
    edge = lambda s: s.groupBy(*E.EDGE).agg(F.max_by("last_audited", "version").alias("last_audited"))
    keys = {"signals": "id", "examples": "id", "taken": "run", "nights": "night"}
    store.keys |= {"audits": E.EDGE} | {name: [key] for name, key in keys.items()}
    store.merges |= {"audits": edge} | {name: (lambda s, key=key: ingest.newest(s, key)) for name, key in keys.items()}
    return store


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(*E.EDGE)


def _longest_audited(edges: DataFrame, audits: DataFrame, limit: int) -> DataFrame | None:
    """The audited edges among which the ``limit`` most urgent are, with last_audited; None if that is not certain.

    Few of the oldest audits, of whole days, are sent to the edges. Every other edge is audited later or never: once
    ``limit`` of the edges found were never looked at (the first priority), none of the others comes before them.
    """
    days = audits.where("last_audited is not null").groupBy("last_audited").agg(F.count("*").alias("n"))
    until = days.withColumn("n", F.sum("n").over(Window.orderBy("last_audited"))).where(F.col("n") <= SMALL_ROWS).agg(F.max("last_audited")).first()[0]
    if until is None:
        return None
    oldest = audits.where(F.col("last_audited") <= F.lit(until)).select(*E.EDGE, "last_audited")
    found = written(edges.join(F.broadcast(oldest), E.EDGE), "longest_audited")  # SMALL_ROWS audits at most
    return found if found.where(F.coalesce("audit_status", F.lit("unverified")) == "unverified").limit(limit).count() == limit else None


def review(edges: DataFrame, audits: DataFrame | None, answer: Answer, limit: int = 500) -> DataFrame:
    """(edge columns, batch_no, index, verdict, suggested_type, note, applied) of the edges that most need an audit.

    At most ``limit`` edges are asked about, in batches. Of several verdicts on one edge the first in the order of
    their kinds counts (delete, quarantine, reclassify, verify); deletes beyond the cap of a run are not applied.
    """
    last = edges.withColumn("last_audited", F.lit(None).cast("date")) if audits is None else _longest_audited(edges, audits, limit)
    if last is None:
        last = edges.join(audits.hint("merge"), E.EDGE, "left")
    late = F.coalesce("last_audited", F.lit("9999-12-31").cast("date"))  # never audited: last, as in the queue
    queue = written(A.work_queue(last, limit).withColumn("run", F.lit(1)).withColumn("late", late), "queue")
    batched = written(A.batches(queue, "run", ["priority", "late", *E.EDGE]), "batched")
    lengths = batched.groupBy("batch_no").agg(F.count("*").alias("batch_len"))
    responses = answer(A.prompts(batched, "run").select("batch_no", "prompt")).select("batch_no", "raw")
    said = A.parse_verdicts(responses.join(small(lengths), "batch_no").withColumnRenamed("batch_no", "batch_id"))
    first = said.groupBy(F.col("batch_id").alias("batch_no"), "index").agg(F.min(F.struct("verdict", "suggested_type", "note")).alias("v")).select("batch_no", "index", "v.*")
    verdicts = batched.join(small(first), ["batch_no", "index"]).drop("late", "last_audited", "priority")
    return written(A.capped_deletes(written(verdicts, "verdicts"), "run", ["batch_no", "index"]), "reviewed").drop("run")


def apply_review(edges: DataFrame, reviewed: DataFrame, known_types: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, gone, outcome) of applied verdicts; outcome is reviewed with ``done``: verified, moved, quarantined, deleted or none.

    Verified and quarantined edges get a state that adds nothing but the mark. A reclassified edge is taken out and
    merges, with its counts, into the edge of the new type, open if either is; an unknown type, or its own, quarantines.
    """
    moves = (F.col("verdict") == "reclassify") & F.col("suggested_type").isin(*known_types) & (F.col("suggested_type") != F.col("rel_type"))
    done = F.when(~F.col("applied"), "none").when(F.col("verdict") == "verify", "verified").when(F.col("verdict") == "delete", "deleted").when(moves, "moved").otherwise("quarantined")
    outcome = written(reviewed.withColumn("done", done), "outcome")
    marks = outcome.where("done in ('verified', 'quarantined')").withColumn("audit_status", F.col("done")).withColumn("mention_count", F.lit(0).cast("long")).withColumn("snippets", F.array().cast("array<string>"))
    moved = outcome.where("done = 'moved'").withColumn("rel_type", F.col("suggested_type")).withColumn("audit_status", F.lit("verified"))
    to = small(moved.select(*E.EDGE).distinct())
    at = written(edges.join(to, E.EDGE, "left_semi").select(*E.EDGE, F.struct("valid_to").alias("target")), "targets")  # a struct: an open edge differs from none
    moved = moved.join(small(at), E.EDGE, "left").withColumn("valid_to", F.when(F.col("target").isNull(), F.col("valid_to")).when(F.col("target.valid_to").isNotNull() & F.col("valid_to").isNotNull(), F.greatest("target.valid_to", "valid_to")))
    columns = [*E.EDGE, "confidence", "mention_count", "valid_from", "last_day", "valid_to", "audit_status", "snippets"]
    place = (F.col("batch_no") * A.BATCH + F.col("index")).cast("int").alias("version")
    states = E.merge_edges(marks.select(*columns, F.lit(0).alias("version")).unionByName(moved.select(*columns, place)))
    return written(states, "states"), _keys(outcome.where("done in ('moved', 'deleted')")), outcome


def _moved_episodes(seen: DataFrame, outcome: DataFrame) -> DataFrame:
    to = outcome.where("done = 'moved'").select(*E.EDGE, "suggested_type")
    rows = seen.join(small(to), E.EDGE).withColumn("rel_type", F.col("suggested_type"))
    return rows.groupBy(*E.EDGE, "episode_id").agg(F.min("first_at").alias("first_at"))


def strip_examples(examples: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed, gone ids, stripped): examples that hold a rejected relation (head, label, tail names), without it.

    An example that loses all its relations goes; examples that hold none are not read twice nor written.
    """
    bad = rejected.select("head", "label", "tail").distinct()
    each = examples.select("id", F.explode("relations").alias("r")).select("id", "r.*")
    touched = written(each.join(small(bad), ["head", "label", "tail"], "left_semi").select("id").distinct(), "touched")
    old = written(examples.join(small(touched), "id", "left_semi"), "old")
    left = written(training.without_stale(old.select("id", "relations"), bad).select("id", F.col("relations").alias("kept"), "stripped"), "left")
    kept = F.transform("kept", lambda r: F.struct(r["head"].alias("head"), r["label"].alias("label"), r["tail"].alias("tail")))
    changed = old.join(left.hint("merge"), "id").withColumn("relations", kept).select(*examples.columns)
    return changed, touched.join(left.select("id").hint("merge"), "id", "left_anti"), old.select(F.sum(F.size("relations")).alias("n")).crossJoin(F.broadcast(left.agg(F.sum(F.size("kept")).alias("m")))).select((F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("stripped"))


def build_examples(episodes: DataFrame, mentions: DataFrame, entities: DataFrame, edges: DataFrame, seen: DataFrame | None, named: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Training examples (id, text, entities, relations, negatives) of episodes (id, content).

    Entities of an episode (mentions: episode_id, entity_id) count if they are mentioned twice, at an edge, or named
    (id); an episode without one gives no example. Relations are those seen in this very episode between two of them:
    quarantined ones are negatives, and so are negative signals (src, relation, dst) between two of them.
    """
    ids = episodes.select(F.col("id").alias("episode_id"))
    chosen = training.select_entities(entities, edges, named).select(F.col("id").alias("entity_id"), "name", "entity_type")
    said = mentions.select("episode_id", "entity_id").distinct().join(ids.hint("merge"), "episode_id", "left_semi").join(chosen.hint("merge"), "entity_id")
    said = written(said, "said")
    end = lambda side: said.select("episode_id", F.col("entity_id").alias(side), F.col("name").alias(f"{side}_name"))
    observed = edges.limit(0).select(F.lit("").alias("episode_id"), *E.EDGE, "audit_status") if seen is None else seen.select(*E.EDGE, "episode_id").join(ids.hint("merge"), "episode_id", "left_semi").join(edges.select(*E.EDGE, "audit_status").hint("merge"), E.EDGE)
    ends = lambda rows: rows.join(end("src").hint("merge"), ["episode_id", "src"]).join(end("dst").hint("merge"), ["episode_id", "dst"])
    bad = F.coalesce(F.col("audit_status").isin("quarantined", "deleted"), F.lit(False))
    rows = ends(observed).select("episode_id", F.col("src_name").alias("head"), F.col("rel_type").alias("label"), F.col("dst_name").alias("tail"), bad.alias("bad"))
    if signals is not None:
        negative = signals.where("signal = 'negative'").select("src", F.col("relation").alias("label"), "dst").distinct()
        met = negative.join(end("src").hint("merge"), "src").join(end("dst").hint("merge"), ["episode_id", "dst"])
        rows = rows.unionByName(met.select("episode_id", F.col("src_name").alias("head"), "label", F.col("dst_name").alias("tail"), F.lit(True).alias("bad")))
    triple = F.struct("head", "label", "tail")
    # an episode is one document's worth of rows
    related = rows.distinct().groupBy("episode_id").agg(F.array_sort(F.collect_list(F.when(~F.col("bad"), triple))).alias("relations"), F.array_sort(F.collect_list(F.when(F.col("bad"), triple))).alias("negatives"))
    named_ = said.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("name", "entity_type"))).alias("entities"))
    joined = episodes.select(F.col("id").alias("episode_id"), F.col("content").alias("text")).join(named_.hint("merge"), "episode_id").join(related.hint("merge"), "episode_id", "left")
    none = F.array().cast(RELATIONS)
    return joined.select(F.col("episode_id").alias("id"), "text", "entities", F.coalesce("relations", none).alias("relations"), F.coalesce("negatives", none).alias("negatives"))


def take_episodes(store: GraphStore, cursor: str, episodes: DataFrame, until: Column, ts: str = "ts", key: str = "id") -> tuple[DataFrame, DataFrame] | None:
    """(episodes that no version of the store has taken, runs that took them), after moving a cursor on; None if there are none.

    The cursor (``state.advance``) keeps its runs; those that the store has are marked in its table ``taken``, so what a
    failed night had taken is taken by the next one.
    """
    spark = store.spark
    state.advance(episodes.where(F.trim("content") != ""), cursor, ts, key, until)
    known = store.table("taken")
    done = set() if known is None else {r[0] for r in known.select("run").collect()}  # one row a night
    runs = [v for v in state.versions(spark, f"{cursor}/cursor", "version") if v not in done]
    if not runs:
        return None
    rows = spark.read.schema(episodes.schema).parquet(*(f"{cursor}/out/version={v}" for v in runs))
    return rows, spark.createDataFrame([(v, len(runs)) for v in runs], "run long, runs int")


def accumulate(store: GraphStore, number: int, cursor: str, episodes: DataFrame, mentions: DataFrame, named: DataFrame, until: Column) -> bool:
    """Examples of the episodes (id, content, ts) that are new up to an instant, as a version of the store; False if it is there."""
    if number in store.versions():
        return False
    taken = take_episodes(store, cursor, episodes, until)
    if taken is None:
        return store.commit(number, {})
    made = build_examples(taken[0], mentions, store.table("entities"), store.table("edges"), store.table("seen_in"), named, store.table("signals"))
    return store.commit(number, {"examples": made, "taken": taken[1]})


def nightly(
    store: GraphStore, number: int, as_of: str, answer: Answer, known_types: tuple[str, ...], limit: int = 500,
    mentions: DataFrame | None = None, queue: DataFrame | None = None, training_rows: tuple[str, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One night as version ``number``: the report row. A night that is there already gives its row and does nothing.

    In order: health and its decision, decay, orphans (entities at no edge and, with mentions, at no episode), self-loops,
    audit and what follows from its verdicts, vectors that are missing or of nobody, relations that examples lose, and
    with training_rows (cursor path, episodes, named ids; needs mentions) examples of the episodes a day old or older.
    queue is one row of (error_rate, p95_ms, avg_ms, stuck, pending, dead). Relation types new since the night before
    and the change of their number are reported.
    """
    spark, day = store.spark, F.lit(as_of).cast("date")
    if number in store.versions():
        return store.table("nights").where(F.col("night") == number)
    entities, edges, vectors, seen = store.table("entities"), store.table("edges"), store.table("vectors"), store.table("seen_in")
    vectors = entities.limit(0).select("id", F.array().cast("array<double>").alias("embedding")) if vectors is None else vectors
    at = spark.createDataFrame([], "episode_id string, entity_id string") if mentions is None else mentions.select("episode_id", "entity_id")

    strength = E.decay_edges(edges, day).agg(F.count("*").alias("edges"), F.round(F.avg("strength"), 6).alias("mean_strength"), F.array_sort(F.collect_set("rel_type")).alias("types"))
    lone = written(E.orphans(entities, edges, at).select("id"), "lone")
    loops = written(_keys(edges.where("src = dst")), "loops")
    left = edges.where("src <> dst")

    reviewed = review(left, store.table("audits"), answer, limit)
    states, out, outcome = apply_review(left, reviewed, known_types)
    gone_edges = written(out.unionByName(loops), "gone_edges")
    stamped = outcome.where("done in ('verified', 'quarantined', 'moved')").select("src", F.when(F.col("done") == "moved", F.col("suggested_type")).otherwise(F.col("rel_type")).alias("rel_type"), "dst").distinct()
    run = F.concat_ws(":", F.lit(number), "batch_no", "index")
    usable = outcome.withColumn("id", run).withColumn("suggested_type", F.when(F.col("done") == "moved", F.col("suggested_type")).otherwise(""))
    signals = A.signals(usable).join(small(usable.select("id", "src", "dst")), "id").select(F.concat_ws(":", "id", "signal").alias("id"), "src", "dst", "relation", "signal", "source", day.alias("day"))
    signals = written(signals, "signals")

    kept = entities.join(lone.hint("merge"), "id", "left_anti")
    bare = written(kept.join(vectors.select("id").hint("merge"), "id", "left_anti").select("id", F.concat_ws(" ", "name", "entity_type").alias("text")), "bare")
    stray = written(E.except_ids(vectors, kept, "id"), "stray")

    deltas = {"edges": states, "audits": stamped.withColumn("last_audited", day), "signals": signals, "vectors": retrieve.hash_embedding(bare)}
    gone = {"entities": lone, "edges": gone_edges, "vectors": stray}
    if seen is not None:
        deltas["seen_in"], gone["seen_in"] = _moved_episodes(seen, outcome), gone_edges
    examples, stripped, dropped = store.table("examples"), None, None
    changed = []
    if examples is not None:
        name = lambda side: entities.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
        bad = written(outcome.where("done in ('quarantined', 'deleted', 'moved')").select(*E.EDGE), "bad")
        rejected = name("dst").join(small(name("src").join(small(bad), "src")), "dst").select(F.col("src_name").alias("head"), F.col("rel_type").alias("label"), F.col("dst_name").alias("tail"))
        fixed, dropped, stripped = strip_examples(examples, written(rejected, "rejected"))
        changed, dropped, stripped = [fixed], written(dropped, "dropped"), written(stripped, "stripped")
        gone["examples"] = dropped
    added = 0
    if training_rows is not None:
        cursor, episodes, named = training_rows
        taken = take_episodes(store, cursor, episodes, F.date_sub(day, 1).cast("timestamp"))
        if taken is not None:
            moved_out = left.join(small(gone_edges), E.EDGE, "left_anti")
            after = E.merge_edges(moved_out.withColumn("version", F.lit(0)).unionByName(states.withColumn("version", F.lit(1))))
            where = None if seen is None else seen.join(small(gone_edges), E.EDGE, "left_anti").unionByName(deltas["seen_in"])
            past = store.table("signals")
            made = written(build_examples(taken[0], at, kept, after, where, named, signals if past is None else past.unionByName(signals)), "made")
            added = made.count()
            changed, deltas["taken"] = [*changed, made], taken[1]
    if changed:
        deltas["examples"] = changed[0] if len(changed) == 1 else changed[1].unionByName(changed[0].join(changed[1].select("id").hint("merge"), "id", "left_anti"))

    report = _report(store, number, day, strength, outcome, lone, loops, bare, stray, dropped, stripped, added, queue, vectors, entities)
    deltas["nights"] = report
    store.commit(number, deltas, gone)
    return store.table("nights").where(F.col("night") == number)


def _report(store, number, day, strength, outcome, lone, loops, bare, stray, dropped, stripped, added, queue, vectors, entities) -> DataFrame:
    """One row of one-row aggregates."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    done = outcome.agg(F.count("*").alias("reviewed"), *(F.count_if(F.col("done") == d).alias(d) for d in ("verified", "moved", "quarantined", "deleted")), F.count_if(~F.col("applied")).alias("over_cap"))
    idle = dict.fromkeys(("error_rate", "p95_ms", "avg_ms"), 0.0) | dict.fromkeys(("stuck", "pending", "dead"), 0)
    state_of = store.spark.createDataFrame([tuple(idle.values())], "error_rate double, p95_ms double, avg_ms double, stuck int, pending int, dead int") if queue is None else queue
    parts = [count(entities, "graph_entities"), count(vectors, "vector_entities"), done, count(lone, "orphans"), count(loops, "self_loops"), count(bare, "refreshed"), count(stray, "stray")]
    parts += [count(lone.limit(0) if dropped is None else dropped, "examples_dropped"), *([] if stripped is None else [stripped])]
    row = strength
    for part in [*parts, state_of]:
        row = row.crossJoin(F.broadcast(part))  # one row each
    if stripped is None:
        row = row.withColumn("stripped", F.lit(0))
    row = row.withColumn("completeness", F.when(F.col("graph_entities") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("vector_entities") / F.col("graph_entities"))))
    row = written(metrics.infra_decision(row).withColumns({"night": F.lit(number).cast("long"), "day": day, "examples_added": F.lit(added).cast("long"), "stripped": F.col("stripped").cast("long")}), "row")
    days = row.select("night", "day", "types")
    before = store.table("nights")
    if before is not None:
        days = days.unionByName(before.select("night", "day", "types").orderBy(F.desc("night")).limit(1))
    change = metrics.drift(days.withColumnRenamed("day", "on").withColumnRenamed("night", "day")).select(F.col("day").alias("night"), "new_types", "change", "alarm")
    return row.join(F.broadcast(change), "night").select("night", "day", "edges", "mean_strength", "types", "new_types", "change", "alarm", "graph_entities", "vector_entities", "decision", "reasons", "orphans", "self_loops", "reviewed", "verified", "moved", "quarantined", "deleted", "over_cap", "refreshed", "stray", "examples_dropped", "stripped", "examples_added")
