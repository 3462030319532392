"""Curation of labelled training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import vocabulary as V
from factgraph.functions.places import numbered
from factgraph.functions.sizes import small


def validate_silver(relations: DataFrame, employers: DataFrame | None = None, owners: tuple[str, ...] = ()) -> DataFrame:
    """Adds valid and reason: concept heads, the owner's employer for others, concepts in hierarchies."""
    head, tail, label = C.normal_name(F.col("head")), C.normal_name(F.col("tail")), F.upper(F.trim("label"))
    rows = relations
    employed = F.lit(False)
    if employers is not None:
        known = employers.select(C.normal_name(F.col("employer")).alias("employer")).distinct()
        rows = rows.join(small(known), tail == F.col("employer"), "left")
        employed = F.col("employer").isNotNull() & label.isin("WORKS_AT", "EMPLOYED_BY", "WORKS_FOR") & ~head.isin(*owners)
    hierarchy = label.isin("MANAGES", "REPORTS_TO", "MENTORS", "MENTORED_BY") & tail.isin(*V.CONCEPTS)
    reason = F.when(head.isin(*V.CONCEPTS), "concept_head").when(employed, "owner_employer").when(hierarchy, "concept_in_hierarchy").otherwise("ok")
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok").drop("employer")


def select_entities(entities: DataFrame, edges: DataFrame, named: DataFrame) -> DataFrame:
    """Entities mentioned twice, at an edge, or named (id) in the latest analysis."""
    used = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(named.select("id")).distinct().withColumn("used", F.lit(True))
    return entities.join(used, "id", "left").where("mention_count >= 2 or used").drop("used")


def without_stale(examples: DataFrame, gone: DataFrame) -> DataFrame:
    """Examples (id, relations) without relations now rejected; an example that loses all goes, one that had none stays."""
    each = examples.select("id", F.posexplode_outer("relations").alias("pos", "r"))
    marked = each.select("id", "pos", "r.head", "r.label", "r.tail").join(gone.select("head", "label", "tail").distinct().withColumn("gone", F.lit(True)).hint("merge"), ["head", "label", "tail"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull() & F.col("pos").isNotNull(), F.struct("pos", "head", "label", "tail"))))
    rows = marked.groupBy("id").agg(kept.alias("relations"), F.count_if("gone").alias("stripped"))
    return rows.where("stripped = 0 or size(relations) > 0")


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.upper(F.trim("label")).alias("label")).agg(F.count("*").alias("n"))


def cap_label(rows: DataFrame, label: str, cap: int, max_ratio: float) -> DataFrame:
    """Rows (row_no, pos, label) without those of a dominant label beyond its cap, dropped from the newest row backward.

    (row_no, pos) names a row. Rows of the label are numbered over tasks, so none holds the label.
    """
    total = rows.agg(F.count("*").alias("total"), F.count_if(F.col("label") == label).alias("had"))
    drop = F.col("had") - F.least(F.lit(cap), F.floor(F.col("total") * max_ratio))
    newest = numbered(rows.where(F.col("label") == label).select("row_no", "pos"), [], [F.desc("row_no"), F.asc("pos")])
    doomed = newest.crossJoin(F.broadcast(total)).where(F.col("rn") <= drop).select("row_no", "pos")  # one row of totals
    return rows.join(doomed.hint("merge"), ["row_no", "pos"], "left_anti")


def upsample(rows: DataFrame, least: int) -> DataFrame:
    """Rows (id, label) and, for labels below the least, copies of their rows in turn until they reach it.

    Copies are numbered from 1; row i mod n of a label is the source of copy i. Only scarce labels are copied, so at
    most ``least`` rows of a label meet.
    """
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < least)
    scarce = rows.join(small(counts), "label").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("id")))
    wanted = counts.select("label", F.col("n").alias("size"), F.explode(F.sequence(F.lit(1), F.lit(least) - F.col("n").cast("int"))).alias("copy"))
    copies = scarce.join(wanted.hint("merge"), "label").where((F.col("copy") - 1) % F.col("size") == F.col("rn") - 1)
    made = copies.select(F.concat_ws(":", "id", F.lit("rebalance"), "label", "copy").alias("id"), "label")
    return rows.select("id", "label").unionByName(made)


def holdout(rows: DataFrame, share: float = 0.2, seed: int = 1337) -> DataFrame:
    """Adds held_out: the first max(1, round(share * n)) rows by a seeded hash of their id, not all of two or more.

    The cut is the hash value at that rank, from a range-partitioned sort, so no task holds all rows.
    """
    keyed = rows.withColumn("h", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))), 256))
    n = keyed.count()
    size = min(max(1, int(round(n * share))), max(1, n - 1))
    last = keyed.select("h", "id").orderBy("h", "id").offset(size - 1).limit(1).withColumnsRenamed({"h": "cut_h", "id": "cut_id"})
    return keyed.crossJoin(F.broadcast(last)).withColumn("held_out", (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("id") <= F.col("cut_id")))).drop("h", "cut_h", "cut_id")


def unify(rows: DataFrame) -> DataFrame:
    """Examples under one set of names, with text and entities; alternate fields are coalesced."""
    text = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("text", "content", "source_text") if c in rows.columns))
    return rows.withColumn("text", text).where("text is not null and size(entities) > 0")


def newest(rows: DataFrame, n: int, order: list) -> DataFrame:
    """The most recent n examples, a stated cap."""
    return rows.orderBy(*order).limit(n)


def hard_negatives(edges: DataFrame, signals: DataFrame, selected: DataFrame) -> DataFrame:
    """Rejected edges and negative signals (src, rel_type, dst) whose ends are both selected (id); each once, with its reason."""
    rejected = edges.where("audit_status in ('quarantined', 'deleted')").select("src", "rel_type", "dst", F.lit("edge").alias("reason"))
    both = rejected.unionByName(signals.select("src", "rel_type", "dst", F.lit("signal").alias("reason")))
    ids = selected.select("id").distinct()
    ends = both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ends.groupBy("src", "rel_type", "dst").agg(F.min("reason").alias("reason"))


def convert_records(examples: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Examples (id, text, entities, relations) with entities that the text holds and relations of allowed labels between them, by label."""
    inside = F.filter("entities", lambda e: F.lower("text").contains(F.lower(e)))
    rows = examples.withColumn("inside", inside)
    each = rows.select("id", "inside", F.explode_outer("relations").alias("r"))
    kept = each.where(F.col("r").isNull() | (F.col("r.label").isin(*allowed) & F.array_contains("inside", F.col("r.head")) & F.array_contains("inside", F.col("r.tail"))))
    by_label = kept.groupBy("id", F.col("r.label").alias("label")).agg(F.array_sort(F.collect_list(F.concat_ws("|", "r.head", "r.tail"))).alias("pairs"))
    return by_label.where("label is not null")


def feedback_examples(feedback: DataFrame, seen: DataFrame) -> DataFrame:
    """New examples of feedback (feedback_id, text, verdict, src, dst, rel_type, suggested_type): missing names appended, labels by decision."""
    fresh = feedback.join(seen.select("feedback_id"), "feedback_id", "left_anti")
    add = lambda text, c: F.when(F.lower(text).contains(F.lower(c)), text).otherwise(F.concat_ws(" ", text, c))
    text = add(add(F.col("text"), F.col("src")), F.col("dst"))
    positive = F.when(F.col("verdict") == "verify", F.col("rel_type")).when(F.col("verdict") == "reclassify", F.col("suggested_type"))
    negative = F.when(F.col("verdict") != "verify", F.col("rel_type"))
    return fresh.select(F.concat(F.lit("audit-feedback:"), "feedback_id").alias("id"), text.alias("text"), positive.alias("positive"), negative.alias("negative"))


def compare_models(base: DataFrame, candidate: DataFrame, deploy_gain: float = 0.03) -> DataFrame:
    """F1 by type of two models side by side (type, f1): the change of each type and whether the mean gain deploys."""
    both = base.select("type", F.col("f1").alias("base")).join(candidate.select("type", F.col("f1").alias("candidate")), "type", "full").fillna(0.0)
    change = both.withColumn("delta", F.round(F.col("candidate") - F.col("base"), 4))
    gain = change.where("type = '*'").select((F.col("delta") >= deploy_gain).alias("deploy"))
    return change.crossJoin(F.broadcast(gain))


def shadow(runs: DataFrame) -> DataFrame:
    """One row of runs (model, relations, fallbacks): rates of both models; the candidate passes at up to 1.2 times the base's."""
    rate = F.sum("fallbacks") / F.greatest(F.sum("relations"), F.lit(1))
    wide = runs.groupBy(F.lit(1).alias("one")).pivot("model", ["base", "candidate"]).agg(F.round(rate, 6).alias("rate"), F.round(F.avg("relations"), 6).alias("relations"))
    return wide.drop("one").withColumn("passed", F.col("candidate_rate") <= 1.2 * F.col("base_rate"))


def diagnostics(deltas: DataFrame, top: int = 5) -> DataFrame:
    """The labels of greatest gain and loss (label, delta): a report of a few rows."""
    up = deltas.orderBy(F.desc("delta"), "label").limit(top).withColumn("kind", F.lit("positive"))
    return up.unionByName(deltas.orderBy("delta", "label").limit(top).withColumn("kind", F.lit("negative")))


def contact_sentences(contacts: DataFrame) -> DataFrame:
    """(id, sentence) of contact texts ``NAME is a contact of OWNER. Employer: X. Title: Y. …``; id is a hash of the sentence."""
    field = lambda name: F.nullif(F.trim(F.regexp_extract("content", rf"(?i)(?:^|\.\s+){name}:\s*([^.\n]+)", 1)), F.lit(""))
    who = F.trim(F.regexp_extract("content", r"^(.+?) is a contact of ", 1))
    owner = F.trim(F.regexp_extract("content", r" is a contact of ([^.\n]+)", 1))
    note = field("Relationship")
    mate = F.lower(note).rlike("classmate|cohort|alumni|emba")
    say = lambda rule, *parts: F.when(rule, F.concat_ws(" ", *parts))
    sentences = F.array_compact(F.array(say(owner != "", who, F.lit("is a contact of"), owner), say(field("Employer").isNotNull(), who, F.lit("works at"), field("Employer")), say(field("Location").isNotNull(), who, F.lit("is located in"), field("Location")), say(mate, who, F.lit("and"), owner, F.lit("are"), note)))
    rows = contacts.select(who.alias("who"), F.explode(sentences).alias("sentence")).where((F.col("who") != "") & F.col("sentence").contains(F.col("who")))
    return rows.select(F.substring(F.sha2("sentence", 256), 1, 16).alias("id"), "sentence").distinct()


def golden_recall(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Recall by category and over all (``*``) of cases (case_id, category, name) against found (case_id, name): either holds the other, punctuation aside."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}0-9 ]", ""))
    wanted = cases.select("case_id", "category", bare(F.col("name")).alias("want")).distinct()
    have = found.select("case_id", bare(F.col("name")).alias("have")).distinct()
    hits = wanted.join(have, "case_id").where("have <> '' and want <> '' and (contains(have, want) or contains(want, have))").select("case_id", "want").distinct().withColumn("hit", F.lit(1))
    marked = wanted.join(hits, ["case_id", "want"], "left")
    return marked.rollup("category").agg(F.count("*").alias("expected"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall")).withColumn("category", F.coalesce("category", F.lit("*")))
