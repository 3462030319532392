"""Decisions: finding them in text, reading their payloads, keeping and joining them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import vocabulary as V


def prefilter(episodes: DataFrame, blocked_sources: tuple[str, ...] = ()) -> DataFrame:
    """Adds score, reason and passed: strong signs 2 points, weak ones 1; two are needed."""
    text = F.trim(F.coalesce("content", F.lit("")))
    source = F.lower(F.coalesce("source", F.lit("")))
    blocked = F.lit(False)
    for b in blocked_sources:
        blocked = blocked | source.contains(b)
    noise = sum((F.lower(text).contains(m).cast("int") for m in V.PROMOTION), F.lit(0))
    points = sum((F.when(text.rlike("(?iU)" + p), 2).otherwise(0) for p in V.DECISION_STRONG), F.lit(0)) + sum((F.when(text.rlike("(?iU)" + p), 1).otherwise(0) for p in V.DECISION_WEAK), F.lit(0))
    early = F.when(text == "", "empty_content").when(blocked, "blocked_source").when(F.length(text) < V.DECISION_MIN_CHARS, "too_short").when(noise >= 2, "promo_noise")
    score = F.when(early.isNotNull(), 0).otherwise(points)
    reason = F.coalesce(early, F.when(points < V.DECISION_MIN_SCORE, "insufficient_signal").otherwise("matched"))
    return episodes.withColumn("score", score).withColumn("reason", reason).withColumn("passed", F.col("reason") == "matched")


def parse_payloads(responses: DataFrame, min_confidence: float = 0.6, alternatives: int = 6, inputs: int = 8) -> DataFrame:
    """(id, decision, decided_by, alternatives, inputs, confidence, error, accepted) of responses (id, raw, speaker)."""
    schema = "is_decision string, decision string, reasoning string, alternatives array<string>, inputs array<string>, outcome string, decided_by string, confidence string, _corrupt_record string"
    body = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    rows = responses.withColumn("d", F.from_json(body, schema, {"columnNameOfCorruptRecord": "_corrupt_record"})).withColumn("body", body)
    yes = F.lower(F.trim(F.coalesce("d.is_decision", F.lit("")))).isin("1", "true", "yes", "y", "on")
    told = F.trim(F.coalesce("d.decision", F.lit("")))
    error = F.when(F.trim(F.coalesce("raw", F.lit(""))) == "", "empty_response").when((F.col("body") == "") | F.col("d").isNull() | F.col("d._corrupt_record").isNotNull(), "invalid_json").when(~yes, "").when(told == "", "missing_decision").otherwise("")
    clean = lambda c, n: F.slice(F.transform(C.distinct_ignoring_case(F.coalesce(c, F.array().cast("array<string>"))), lambda x: F.substring(x, 1, 240)), 1, n)
    by = F.coalesce(F.nullif(F.trim("d.decided_by"), F.lit("")), F.nullif(F.trim("speaker"), F.lit("")), F.lit("Unknown"))
    confidence = C.clamp(F.col("d.confidence"))
    return rows.select("id", F.substring(told, 1, 400).alias("decision"), F.substring(by, 1, 120).alias("decided_by"), clean(F.col("d.alternatives"), alternatives).alias("alternatives"), clean(F.col("d.inputs"), inputs).alias("inputs"), confidence.alias("confidence"), error.alias("error"), (yes & (told != "") & (confidence >= min_confidence)).alias("accepted"))


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Latest version of each decision by id (version, …)."""
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))
    return base.unionByName(delta).withColumn("rank", newest).where("rank = 1").drop("rank")


def missing_people(decisions: DataFrame, known: DataFrame) -> DataFrame:
    """Deciders that no entity (key) stands for, as Person rows."""
    names = decisions.select(F.trim("decided_by").alias("name")).where("name <> ''").distinct()
    return names.join(known.select("key").hint("merge"), C.normal_name(F.col("name")) == F.col("key"), "left_anti").withColumn("entity_type", F.lit("Person"))


def search(decisions: DataFrame, id: str | None = None, text: str | None = None, decided_by: str | None = None) -> DataFrame:
    """Decisions by any of id, text in three columns, decider; filters that are not given are not there."""
    out = decisions
    if id is not None:
        out = out.where(F.col("id") == id)
    if text is not None:
        out = out.where(F.lower("decision").contains(text.lower()) | F.lower("reasoning").contains(text.lower()) | F.lower("outcome").contains(text.lower()))
    if decided_by is not None:
        out = out.where(F.lower("decided_by") == decided_by.lower())
    return out


def view(decisions: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Decisions with decider, related entities, predecessor and source episode from links (decision_id, kind, target_id)."""
    named = links.join(entities.select(F.col("id").alias("target_id"), "name"), "target_id", "left")
    first = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col(c)))
    told = named.groupBy(F.col("decision_id").alias("id")).agg(first("DECIDED_BY", "name").alias("decider"), F.array_sort(F.collect_set(F.when(F.col("kind") == "RELATES_TO", F.col("name")))).alias("related"), first("PRECEDED_BY", "target_id").alias("preceded_by"), first("SOURCED_FROM", "target_id").alias("episode"))
    return decisions.join(told, "id", "left")


def dangling(links: DataFrame, decisions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Links to a predecessor or source episode that does not exist."""
    known = decisions.select(F.lit("PRECEDED_BY").alias("kind"), F.col("id").alias("target_id")).union(episodes.select(F.lit("SOURCED_FROM"), "id")).distinct()
    return links.where("kind in ('PRECEDED_BY', 'SOURCED_FROM')").join(known, ["kind", "target_id"], "left_anti")
