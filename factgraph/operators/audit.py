"""Audit work queues, batches, verdicts and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions.places import numbered

VERDICTS = ("verify", "reclassify", "quarantine", "delete")
BATCH, DELETE_SHARE, DELETE_LOW, DELETE_HIGH = 25, 0.05, 3, 15


def work_queue(edges: DataFrame, limit: int = 500) -> DataFrame:
    """Edges to audit: unaudited first, then flagged, then the longest-verified (never audited last). A top-k report."""
    status = F.coalesce("audit_status", F.lit("unverified"))
    priority = F.when(status == "unverified", 0).when(status.isin("flagged", "quarantined"), 1).otherwise(2)
    return edges.withColumn("priority", priority).orderBy("priority", F.asc_nulls_last("last_audited"), "src", "rel_type", "dst").limit(limit)


def batches(rows: DataFrame, by: str, order: list[str], size: int = BATCH) -> DataFrame:
    """Adds batch_no and index (from 1) within batches of an audit run of any length; the order must have no ties."""
    rows = numbered(rows, [by], [F.col(c) for c in order], "place").withColumn("place", F.col("place") - 1)
    return rows.withColumn("batch_no", F.floor(F.col("place") / size).cast("int")).withColumn("index", (F.col("place") % size + 1).cast("int")).drop("place")


def prompts(batched: DataFrame, by: str) -> DataFrame:
    """One text for each batch: a numbered line for each edge."""
    line = F.format_string("%d. %s -[%s]-> %s (mentions: %d)", "index", "src", "rel_type", "dst", "mention_count")
    rows = batched.groupBy(by, "batch_no").agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("rows"))
    return rows.select(by, "batch_no", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("prompt"))


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """(batch_id, index, verdict, suggested_type, note) of responses (batch_id, raw, batch_len).

    The array in the text is read as it is; if that fails, dropped opening braces are put back; if that fails too
    (cut off, broken), every whole object in it counts. Unknown verdicts and indexes out of range are dropped.
    """
    schema = "array<struct<index:int,verdict:string,suggested_type:string,note:string>>"
    body = F.regexp_extract("raw", r"(?s)\[.*\]", 0)
    fixed = F.regexp_replace(body, r'(?<=[,\[])\s*"index"', ' {"index"')
    objects = F.regexp_extract_all(F.regexp_extract("raw", r"(?s)\[.*", 0), F.lit(r"\{[^{}]*\}"), F.lit(0))
    salvaged = F.filter(F.transform(objects, lambda o: F.from_json(o, "index int, verdict string, suggested_type string, note string")), lambda o: o["verdict"].isNotNull())
    good = lambda text: F.filter(F.from_json(text, schema), lambda o: o["verdict"].isNotNull())
    first, second = good(body), good(fixed)
    found = F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).when(F.coalesce(F.size(second), F.lit(0)) > 0, second).otherwise(salvaged)
    rows = responses.select("batch_id", "batch_len", F.explode(found).alias("v"))
    verdict = C.normal_name(F.col("v.verdict"))
    kept = rows.where(F.col("v.index").between(1, F.col("batch_len")) & verdict.isin(*VERDICTS))
    return kept.select("batch_id", F.col("v.index").alias("index"), verdict.alias("verdict"), C.normal_relation(F.coalesce("v.suggested_type", F.lit(""))).alias("suggested_type"), F.trim(F.coalesce("v.note", F.lit(""))).alias("note"))


def delete_cap(scanned: Column) -> Column:
    """5 per cent of the rows scanned, 3 at least and 15 at most."""
    return F.least(F.lit(DELETE_HIGH), F.greatest(F.lit(DELETE_LOW), F.floor(scanned * DELETE_SHARE).cast("int")))


def capped_deletes(verdicts: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds applied: every verdict but the deletes of a run beyond its cap, in order (without ties).

    The deletes of a run are few after its cap, but a run may hold any share of the rows: deletes are numbered over
    range-partitioned parts, the rest never meet by run, and the cap comes from a count by run.
    """
    cap = verdicts.groupBy(F.col(by).alias("of")).agg(delete_cap(F.count("*")).alias("cap"))
    deletes = numbered(verdicts.where("verdict = 'delete'"), [by], [F.col(c) for c in order], "place")
    limited = deletes.join(cap.hint("merge"), F.col(by).eqNullSafe(F.col("of"))).withColumn("applied", F.col("place") <= F.col("cap"))
    others = verdicts.where("verdict is null or verdict <> 'delete'").withColumn("applied", F.lit(True))
    return others.unionByName(limited.select(*others.columns))


def signals(verdicts: DataFrame) -> DataFrame:
    """Training signals of applied verdicts: verify is positive, the others negative, reclassify also positive for the new type; without one it quarantines."""
    valid = F.coalesce(F.length("suggested_type") > 0, F.lit(False))
    row = lambda sign, source, relation: F.struct(F.lit(sign).alias("signal"), F.lit(source).alias("source"), relation.alias("relation"))
    own = F.col("rel_type")
    out = (
        F.when(F.col("verdict") == "verify", F.array(row("positive", "verify", own)))
        .when((F.col("verdict") == "reclassify") & valid, F.array(row("negative", "reclassify", own), row("positive", "reclassify", F.col("suggested_type"))))
        .when(F.col("verdict") == "delete", F.array(row("negative", "delete", own)))
        .otherwise(F.array(row("negative", "quarantine", own)))
    )
    return verdicts.where("applied").select("*", F.explode(out).alias("s")).select("id", "s.signal", "s.source", F.col("s.relation").alias("relation"))


def outcome_totals(verdicts: DataFrame, by: str) -> DataFrame:
    return verdicts.groupBy(by).agg(F.count("*").alias("scanned"), *(F.count_if((F.col("verdict") == v) & F.col("applied")).alias(v) for v in VERDICTS))


def gate(verdicts: DataFrame, by: str) -> DataFrame:
    """Whether a run is good enough: 60 per cent verified at least and 15 deleted at most."""
    totals = verdicts.groupBy(by).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("verdict") == "verify") / F.count("*"), 4).alias("verify_ratio"), F.round(F.count_if(F.col("verdict") == "delete") / F.count("*"), 4).alias("delete_ratio"))
    return totals.withColumn("passed", (F.col("verify_ratio") >= 0.6) & (F.col("delete_ratio") <= 0.15))


def feedback_rows(verdicts: DataFrame) -> DataFrame:
    """Feedback with its id, a hash of what it is about, and a text where no snippet is there."""
    base = F.concat_ws("|", "src", "rel_type", "dst", "verdict")
    text = F.coalesce("snippet", F.concat_ws(" ", "src", F.lower(F.replace("rel_type", F.lit("_"), F.lit(" "))), "dst"))
    return verdicts.select(F.substring(F.sha2(base, 256), 1, 24).alias("feedback_id"), "verdict", text.alias("text"))


def ready_for_audit(episodes: DataFrame, before: Column) -> DataFrame:
    """Episodes (content, day) old enough and not empty."""
    return episodes.where((F.col("day") < before) & (F.col("content") != ""))
