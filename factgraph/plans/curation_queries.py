"""Queries of audit, training curation and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.functions import vocabulary as V
from factgraph.operators import audit as A
from factgraph.operators import decisions as D
from factgraph.operators import metrics as M
from factgraph.operators import training as T
from factgraph.operators import traverse
from factgraph.plans.graph_queries import _KEYS
from factgraph.plans.registry import query

_in = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)

# -- audit ------------------------------------------------------------------------------------------------------------

_QUEUE = "CASE WHEN audit_status IS NULL THEN 0 WHEN audit_status = 'quarantined' THEN 1 ELSE 2 END"


def audited(t):
    return t.edges.withColumn("last_audited", F.when(F.col("mention_count") > 1, F.col("last_day")))


@query("n5_work_queue", f"SELECT src, rel_type, dst, CAST({_QUEUE} AS INT) AS priority FROM edges ORDER BY 4, CASE WHEN mention_count > 1 THEN last_day END NULLS LAST, src, rel_type, dst LIMIT 500")
def _(t):
    return A.work_queue(audited(t)).select("src", "rel_type", "dst", "priority")


_BATCHED = "batched AS (SELECT src, rel_type, dst, mention_count, CAST((row_number() OVER w - 1) // 25 AS INT) AS batch_no, CAST((row_number() OVER w - 1) % 25 + 1 AS INT) AS index FROM edges WINDOW w AS (PARTITION BY src ORDER BY rel_type, dst))"


def batched(t):
    return A.batches(t.edges.select("src", "rel_type", "dst", "mention_count"), "src", ["rel_type", "dst"])  # what is written is what the prompts say


@query("n6_batches", f"WITH {_BATCHED} SELECT src, rel_type, dst, batch_no, index FROM batched")
def _(t):
    return batched(t).select("src", "rel_type", "dst", "batch_no", "index")


@query("f26_prompts", f"WITH {_BATCHED} SELECT src, batch_no, string_agg(index || '. ' || src || ' -[' || rel_type || ']-> ' || dst || ' (mentions: ' || mention_count || ')', chr(10) ORDER BY index) AS prompt FROM batched GROUP BY 1, 2")
def _(t):
    return A.prompts(batched(t), "src")


@query("j15_verdict_by_index", f"WITH {_BATCHED} SELECT b.src, b.rel_type, b.dst, v.verdict FROM batched b JOIN verdicts v ON b.index = v.id % 25 + 1 AND b.batch_no = v.id // 25 WHERE b.src LIKE 'S%'")
def _(t):
    v = t.verdicts.select((F.col("id") % 25 + 1).cast("int").alias("index"), F.floor(F.col("id") / 25).cast("int").alias("batch_no"), "verdict")
    return batched(t).where("src like 'S%'").join(v, ["batch_no", "index"]).select("src", "rel_type", "dst", "verdict")


_CAPPED = """capped AS (SELECT *, verdict <> 'delete' OR sum(CASE WHEN verdict = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY id) <= least(15, greatest(3, floor(count(*) OVER (PARTITION BY run) * 0.05))) AS applied FROM verdicts)"""


def capped(t):
    return A.capped_deletes(t.verdicts, "run", ["id"])


@query("n7_delete_cap", f"WITH {_CAPPED} SELECT id, verdict, applied FROM capped")
def _(t):
    return capped(t).select("id", "verdict", "applied")


@query("f18_signals", f"""
    WITH {_CAPPED} SELECT signal, source, relation, count(*) AS n FROM (
      SELECT CASE verdict WHEN 'verify' THEN 'positive' ELSE 'negative' END AS signal, CASE WHEN verdict = 'reclassify' AND suggested_type IS NULL THEN 'quarantine' ELSE verdict END AS source, 'USES' AS relation FROM capped WHERE applied
      UNION ALL SELECT 'positive', 'reclassify', suggested_type FROM capped WHERE applied AND verdict = 'reclassify' AND suggested_type IS NOT NULL) GROUP BY ALL""")  # fmt: skip
def _(t):
    return A.signals(capped(t).withColumn("rel_type", F.lit("USES"))).groupBy("signal", "source", "relation").agg(F.count("*").alias("n"))


@query("a30_outcomes", f"WITH {_CAPPED} SELECT run, count(*) AS scanned, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}' AND applied) AS {v}" for v in A.VERDICTS) + " FROM capped GROUP BY 1")
def _(t):
    return A.outcome_totals(capped(t), "run")


@query("a29_audit_gate", "SELECT *, verify_ratio >= 0.6 AND delete_ratio <= 0.15 AS passed FROM (SELECT run, count(*) AS n, round(count(*) FILTER (WHERE verdict = 'verify') / count(*), 4) AS verify_ratio, round(count(*) FILTER (WHERE verdict = 'delete') / count(*), 4) AS delete_ratio FROM verdicts GROUP BY 1)")
def _(t):
    return A.gate(t.verdicts, "run")


@query("f17_parse_verdicts", "SELECT run, batch_no, CAST(row_number() OVER (PARTITION BY run, batch_no ORDER BY id) AS INT) AS index, verdict, coalesce(suggested_type, '') AS suggested_type FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY run ORDER BY id) - 1) / 40) AS INT) AS batch_no FROM verdicts)")
def _(t):
    rows = A.batches(t.verdicts, "run", ["id"], 40)
    item = F.format_string('{"index": %d, "verdict": " %s", "suggested_type": "%s", "note": "n"}', "index", F.initcap("verdict"), F.coalesce("suggested_type", F.lit("")))
    # one response a batch of at most 40 verdicts: fenced, with braces left out, or cut off
    body = rows.groupBy(F.struct("run", "batch_no").alias("batch_id")).agg(F.count("*").alias("batch_len"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", item.alias("item")))), lambda r: r["item"]), ", ").alias("body"))
    kind = (F.col("batch_id.run") + F.col("batch_id.batch_no")) % 3
    raw = F.when(kind == 0, F.concat(F.lit("```json\n["), "body", F.lit("]\n```"))).when(kind == 1, F.concat(F.lit("Here: ["), F.replace("body", F.lit('{"index"'), F.lit('"index"')), F.lit("]")))
    raw = raw.otherwise(F.concat(F.lit("["), "body", F.lit(', {"index": 9')))
    return A.parse_verdicts(body.select("batch_id", raw.alias("raw"), "batch_len")).select("batch_id.*", "index", "verdict", "suggested_type")


@query("f18_feedback_rows", "SELECT substr(sha256(src || '|' || rel_type || '|' || dst || '|verify'), 1, 24) AS feedback_id, CASE WHEN mention_count > 1 THEN 'seen' ELSE src || ' ' || lower(replace(rel_type, '_', ' ')) || ' ' || dst END AS text FROM edges WHERE rel_type = 'CUSTOMER_OF'")
def _(t):
    rows = t.edges.where("rel_type = 'CUSTOMER_OF'").withColumn("verdict", F.lit("verify")).withColumn("snippet", F.when(F.col("mention_count") > 1, "seen"))
    return A.feedback_rows(rows).select("feedback_id", "text")


# -- training ---------------------------------------------------------------------------------------------------------


@query("p16_silver_validator", f"""
    SELECT episode_id, pos, CASE WHEN head IN ({_in(V.CONCEPTS)}) THEN 'concept_head' WHEN label = 'WORKS_AT' AND tail LIKE 'S%1' AND head <> 'C1' THEN 'owner_employer' ELSE 'ok' END AS reason
    FROM (SELECT episode_id, pos, tail, CASE pos % 4 WHEN 0 THEN 'fintech' ELSE head END AS head, CASE flag WHEN 'y' THEN 'WORKS_AT' ELSE 'MANAGES' END AS label FROM (SELECT *, CASE WHEN score > 0.5 THEN 'y' ELSE 'n' END AS flag FROM candidates))""")  # fmt: skip
def _(t):
    rows = t.candidates.select("episode_id", "pos", "tail", F.when(F.col("pos") % 4 == 0, "fintech").otherwise(F.col("head")).alias("head"), F.when(F.col("score") > 0.5, "WORKS_AT").otherwise("MANAGES").alias("label"))
    employers = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("employer")).where("employer like 'S%1'")
    return T.validate_silver(rows, employers, ("c1",)).select("episode_id", "pos", "reason")


@query("j29_entity_selection", "SELECT id FROM entities WHERE mention_count >= 2 OR id IN (SELECT src FROM edges WHERE rel_type = 'USES' UNION SELECT dst FROM edges WHERE rel_type = 'USES') OR id LIKE 'C%9'")
def _(t):
    return T.select_entities(t.entities, t.edges.where("rel_type = 'USES'"), t.entities.where("id like 'C%9'")).select("id")


_GONE = "EXISTS (SELECT 1 FROM candidates g WHERE g.pos = 2 AND g.score < 0.2 AND g.head = c.head AND g.label = c.label AND g.tail = c.tail)"


@query("j13_stale_relations", f"SELECT episode_id AS id, count(*) FILTER (WHERE {_GONE}) AS stripped, CAST(count(*) FILTER (WHERE NOT {_GONE}) AS INT) AS left_over FROM candidates c GROUP BY 1 HAVING count(*) FILTER (WHERE {_GONE}) = 0 OR count(*) FILTER (WHERE NOT {_GONE}) > 0")
def _(t):
    examples = t.candidates.groupBy(F.col("episode_id").alias("id")).agg(F.collect_list(F.struct("head", "label", "tail")).alias("relations"))
    kept = T.without_stale(examples, t.candidates.where("pos = 2 and score < 0.2"))
    return kept.select("id", "stripped", F.size("relations").alias("left_over"))


@query("j16_hard_negatives", """
    SELECT src, rel_type, dst, min(reason) AS reason FROM (SELECT src, rel_type, dst, 'edge' AS reason FROM edges WHERE audit_status IN ('quarantined', 'deleted')
      UNION ALL SELECT head, 'CUSTOMER_OF', tail, 'signal' FROM candidates WHERE score < 0.1) x
    WHERE src IN (SELECT id FROM entities WHERE mention_count >= 2) AND dst IN (SELECT id FROM entities WHERE mention_count >= 2 OR id LIKE 'S%') GROUP BY 1, 2, 3""")  # fmt: skip
def _(t):
    negative = t.candidates.where("score < 0.1").select(F.col("head").alias("src"), F.lit("CUSTOMER_OF").alias("rel_type"), F.col("tail").alias("dst"))
    return T.hard_negatives(t.edges, negative, t.entities.where("mention_count >= 2 or id like 'S%'"))


@query("j28_unseen_feedback", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def _(t):
    return t.labels.join(t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("a23_label_counts", "SELECT upper(trim(label)) AS label, count(*) AS n FROM candidates GROUP BY 1")
def _(t):
    return T.label_counts(t.candidates)


@query("a36_training_statistics", "SELECT label, count(*) FILTER (WHERE score >= 0.4) AS positive, count(*) FILTER (WHERE score < 0.4) AS negative, count(DISTINCT head_type || tail_type) AS kinds FROM candidates GROUP BY 1")
def _(t):
    return t.candidates.groupBy("label").agg(F.count_if(F.col("score") >= 0.4).alias("positive"), F.count_if(F.col("score") < 0.4).alias("negative"), F.countDistinct(F.concat("head_type", "tail_type")).alias("kinds"))


_ROWS = "rows_ AS (SELECT l_orderkey * 10 + l_linenumber AS row_no, CAST(l_partkey * 1000 + l_suppkey AS BIGINT) AS pos, l_returnflag AS label, count(*) AS k FROM lineitem GROUP BY 1, 2, 3)"


@query("n14_cap_label", f"""
    WITH {_ROWS}, had AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = 'N') AS had FROM rows_),
    doomed AS (SELECT row_no, pos FROM (SELECT row_no, pos, row_number() OVER (ORDER BY row_no DESC, pos) AS rn FROM rows_ WHERE label = 'N') WHERE rn <= (SELECT had - least(12000, floor(total * 0.35)) FROM had))
    SELECT label, count(*) AS n FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.row_no = r.row_no AND d.pos = r.pos) GROUP BY 1""")  # fmt: skip
def _(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), F.col("l_returnflag").alias("label")).distinct()
    return T.cap_label(rows, "N", 12000, 0.35).groupBy("label").agg(F.count("*").alias("n"))


@query("n13_f23_upsample", """
    WITH rows_ AS (SELECT concat('V', doc_id) AS id, source AS label FROM documents), counts AS (SELECT label, count(*) AS n FROM rows_ GROUP BY 1 HAVING count(*) < 60),
    scarce AS (SELECT r.id, r.label, c.n, row_number() OVER (PARTITION BY r.label ORDER BY r.id) AS rn FROM rows_ r JOIN counts c USING (label))
    SELECT id, label FROM rows_ UNION ALL SELECT s.id || ':rebalance:' || s.label || ':' || i.i, s.label FROM scarce s, (SELECT unnest(range(1, 61)) AS i) i WHERE i.i <= 60 - s.n AND (i.i - 1) % s.n = s.rn - 1""")  # fmt: skip
def _(t):
    return T.upsample(t.documents.select(F.concat(F.lit("V"), "doc_id").alias("id"), F.col("source").alias("label")), 60)


@query("n15_holdout", """
    SELECT id, row_number() OVER (ORDER BY h, id) <= least(greatest(1, round(n * 0.2)), greatest(1, n - 1)) AS held_out FROM (
      SELECT doc_id AS id, sha256(doc_id || '|1337') AS h, count(*) OVER () AS n FROM documents)""")
def _(t):
    return T.holdout(t.documents.select(F.col("doc_id").alias("id")))


@query("n10_newest_examples", "SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10000")
def _(t):
    return T.newest(t.documents, 10_000, [F.desc("doc_id")]).select("doc_id")


@query("f28_unify_examples", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE trim(text) <> '' AND doc_id % 3 > 0")
def _(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("content"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("doc_id") % 3).cast("int")).alias("entities"))
    return T.unify(rows).select("doc_id", F.char_length("text").cast("bigint").alias("n"))


@query("f20_f22_training_records", """
    SELECT id, label, string_agg(head || '|' || tail, ';' ORDER BY head || '|' || tail) AS pairs FROM (
      SELECT episode_id AS id, label, head, tail FROM candidates WHERE pos <> 3 AND label <> 'related to') x WHERE NOT EXISTS (SELECT 1 WHERE x.tail LIKE 'S%4') GROUP BY 1, 2""")  # fmt: skip
def _(t):
    rows = t.candidates.where("pos <> 3")
    kept = F.filter(F.array_distinct(F.concat(F.collect_list("head"), F.collect_list("tail"))), lambda n: ~n.rlike("^S.*4$"))
    every = F.array_join(F.concat(F.collect_list("head"), F.filter(F.collect_list("tail"), lambda n: ~n.rlike("^S.*4$"))), " ")
    examples = rows.groupBy(F.col("episode_id").alias("id")).agg(F.concat(F.lit(" "), every, F.lit(" ")).alias("text"), kept.alias("entities"), F.collect_list(F.struct("head", "label", "tail")).alias("relations"))
    out = T.convert_records(examples, ("customer of", " works at"))
    return out.select("id", "label", F.array_join("pairs", ";").alias("pairs"))


@query("f21_feedback_examples", """
    SELECT 'audit-feedback:' || f AS id, CASE WHEN contains(lower(t1), lower(dst)) THEN t1 ELSE t1 || ' ' || dst END AS text, CASE verdict WHEN 'verify' THEN rel_type WHEN 'reclassify' THEN 'KNOWS' END AS positive, CASE WHEN verdict <> 'verify' THEN rel_type END AS negative FROM (
      SELECT substr(sha256(src || rel_type || dst), 1, 24) AS f, CASE WHEN contains('about s1', lower(src)) THEN 'about s1' ELSE 'about s1 ' || src END AS t1, src, dst, rel_type,
        CASE mention_count % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'verify' ELSE 'reclassify' END AS verdict FROM edges WHERE rel_type = 'CUSTOMER_OF')""")  # fmt: skip
def _(t):
    rows = t.edges.where("rel_type = 'CUSTOMER_OF'").select(F.substring(F.sha2(F.concat("src", "rel_type", "dst"), 256), 1, 24).alias("feedback_id"), F.lit("about s1").alias("text"), "src", "dst", "rel_type", F.lit("KNOWS").alias("suggested_type"), F.when(F.col("mention_count") % 3 == 0, "delete").when(F.col("mention_count") % 3 == 1, "verify").otherwise("reclassify").alias("verdict"))
    return T.feedback_examples(rows, rows.where("false"))


_F1 = "SELECT type, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1 FROM (SELECT coalesce(label, '*') AS type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM (SELECT DISTINCT episode_id, head, label, tail, max(score) >= 0.3 AS g, {p} AS p FROM candidates GROUP BY 1, 2, 3, 4) WHERE g OR p GROUP BY ROLLUP (label))"


@query("a25_model_comparison", f"""
    WITH b AS ({_F1.format(p="bool_or(pos <> 2)")}), c AS ({_F1.format(p="bool_or(pos <> 2 AND score > 0.25)")}), d AS (SELECT b.type, b.f1 AS base, c.f1 AS candidate, round(c.f1 - b.f1, 4) AS delta FROM b JOIN c USING (type))
    SELECT d.*, (SELECT delta >= 0.03 FROM d WHERE type = '*') AS deploy FROM d""")  # fmt: skip
def _(t):
    key = ["episode_id", "head", "label", "tail"]
    gold = t.candidates.where("score >= 0.3")
    f1 = lambda rows: M.precision_recall(gold, rows, key, "label").select("type", "f1")
    return T.compare_models(f1(t.candidates.where("pos <> 2")), f1(t.candidates.where("pos <> 2 and score > 0.25")))


@query("a27_shadow", "SELECT base_rate, candidate_rate, candidate_rate <= 1.2 * base_rate AS passed FROM (SELECT round(sum(fallbacks) FILTER (WHERE user_id % 2 = 0) / sum(relations) FILTER (WHERE user_id % 2 = 0), 6) AS base_rate, round(sum(fallbacks) FILTER (WHERE user_id % 2 = 1) / sum(relations) FILTER (WHERE user_id % 2 = 1), 6) AS candidate_rate FROM logs)")
def _(t):
    runs = t.logs.select(F.when(F.col("user_id") % 2 == 0, "base").otherwise("candidate").alias("model"), "relations", "fallbacks")
    return T.shadow(runs).select("base_rate", "candidate_rate", "passed")


@query("f25_diagnostics", """
    WITH d AS (SELECT tail AS label, round(avg(score) - 0.5, 6) AS delta FROM candidates GROUP BY 1)
    SELECT * FROM (SELECT label, delta, 'positive' AS kind FROM d ORDER BY delta DESC, label LIMIT 5) UNION ALL SELECT * FROM (SELECT label, delta, 'negative' FROM d ORDER BY delta, label LIMIT 5)""")  # fmt: skip
def _(t):
    return T.diagnostics(t.candidates.groupBy(F.col("tail").alias("label")).agg(F.round(F.avg("score") - 0.5, 6).alias("delta")))


@query("f16_contact_sentences", """
    WITH s AS (SELECT unnest([c_name || ' is a contact of Owner One', c_name || ' works at ' || c_mktsegment || ' Inc', c_name || ' is located in ' || n_name, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' and Owner One are classmates from School' END]) AS sentence FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT DISTINCT substr(sha256(sentence), 1, 16) AS id, sentence FROM s WHERE sentence IS NOT NULL""")  # fmt: skip
def _(t):
    text = F.concat("c_name", F.lit(" is a contact of Owner One. Employer: "), "c_mktsegment", F.lit(" Inc. Location: "), "n_name", F.lit(". Relationship: "), F.when(F.col("c_custkey") % 3 == 0, "classmates from School").otherwise("met once"), F.lit("."))
    return T.contact_sentences(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(text.alias("content")))


@query("a28_j24_golden_recall", """
    WITH cases AS (SELECT DISTINCT o_custkey AS case_id, o_orderpriority AS category, lower(o_orderstatus || 'x' || o_orderkey % 7) AS want FROM orders),
    found AS (SELECT DISTINCT o_custkey AS case_id, lower('x' || o_orderkey % 5) AS have FROM orders),
    marked AS (SELECT c.*, EXISTS (SELECT 1 FROM found f WHERE f.case_id = c.case_id AND (contains(f.have, c.want) OR contains(c.want, f.have))) AS hit FROM cases c)
    SELECT coalesce(category, '*') AS category, count(*) AS expected, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 4) AS recall FROM marked GROUP BY ROLLUP (category)""")  # fmt: skip
def _(t):
    cases = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("category"), F.concat("o_orderstatus", F.lit("x"), F.col("o_orderkey") % 7).alias("name"))
    found = t.orders.select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("X'"), F.col("o_orderkey") % 5).alias("name"))
    return T.golden_recall(cases, found)


# -- decisions --------------------------------------------------------------------------------------------------------


@query("p18_decision_prefilter", """
    SELECT id, CASE WHEN trim(content) = '' THEN 'empty_content' WHEN source = 'src3' THEN 'blocked_source' WHEN length(trim(content)) < 24 THEN 'too_short' WHEN n % 4 = 0 THEN 'promo_noise' WHEN n % 4 = 1 THEN 'matched' WHEN n % 4 = 2 THEN 'matched' ELSE 'insufficient_signal' END AS reason
    FROM (SELECT doc_id AS id, doc_id AS n, text AS content, source FROM documents)""")  # fmt: skip
def _(t):
    extra = F.when(F.col("doc_id") % 4 == 0, " Buy now, click here").when(F.col("doc_id") % 4 == 1, " So we decided on it").when(F.col("doc_id") % 4 == 2, " The plan is good, and a decision").otherwise(" The plan is good")
    short = F.length(F.trim("text")) < V.DECISION_MIN_CHARS
    rows = t.documents.select(F.col("doc_id").alias("id"), "source", F.when(short, F.col("text")).otherwise(F.concat("text", extra)).alias("content"))
    found = D.prefilter(rows.withColumn("source", F.when(F.col("source") == "src3", "blocked").otherwise("open")), ("blocked",))
    return found.select("id", "reason")


@query("f19_decision_payloads", """
    SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'missing_decision' ELSE '' END AS error, doc_id % 5 IN (2, 3) AND least(1.0, (doc_id % 10) / 10.0) >= 0.6 AS accepted, CASE WHEN doc_id % 5 = 0 THEN 'Me' ELSE 'You' END AS decided_by FROM documents""")  # fmt: skip
def _(t):
    n = F.col("doc_id")
    told = F.when(n % 5 == 1, "").otherwise("go")
    yes = F.when(n % 5 == 4, "false").otherwise('"yes"')
    body = F.format_string('Sure: {"is_decision": %s, "decision": "%s", "alternatives": ["a", "A", " b "], "decided_by": "You", "confidence": %s} done', yes, told, F.format_string("0.%d", n % 10))
    rows = t.documents.select(n.alias("id"), F.when(n % 5 == 0, "{not json}").otherwise(body).alias("raw"), F.lit("Me").alias("speaker"))
    return D.parse_payloads(rows).select("id", "error", "accepted", "decided_by")


_DECISIONS = "decisions AS (SELECT concat('K', o_orderkey) AS id, o_orderstatus || ' it' AS decision, 'Client ' || o_custkey AS decided_by, o_totalprice AS version FROM orders)"


def decisions(t):
    return t.orders.select(F.concat(F.lit("K"), "o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit(" it")).alias("decision"), F.lit("").alias("reasoning"), F.lit("").alias("outcome"), F.concat(F.lit("Client "), "o_custkey").alias("decided_by"), F.col("o_totalprice").alias("version"))


@query("p14_decision_search", f"WITH {_DECISIONS} SELECT id FROM decisions WHERE contains(lower(decision), 'f it') AND lower(decided_by) = 'client 7'")
def _(t):
    return D.search(decisions(t), text="F it", decided_by="client 7").select("id")


@query("w18_decision_upsert", f"WITH {_DECISIONS} SELECT id, max(v) AS version FROM (SELECT id, version AS v FROM decisions UNION ALL SELECT id, 100000.0 FROM decisions WHERE id LIKE '%5') GROUP BY 1")
def _(t):
    base = decisions(t)
    return D.upsert(base, base.where("id like '%5'").withColumn("version", F.lit(100000.0))).select("id", "version")


@query("w18_missing_people", f"WITH {_KEYS}, {_DECISIONS} SELECT DISTINCT decided_by || 'x' AS name FROM decisions WHERE decided_by LIKE '%1' UNION SELECT decided_by FROM decisions WHERE lower(decided_by) NOT IN (SELECT key FROM keys)")
def _(t):
    rows = decisions(t).withColumn("decided_by", F.when(F.col("decided_by").endswith("1"), F.concat("decided_by", F.lit("x"))).otherwise(F.col("decided_by")))
    return D.missing_people(rows, traverse.names_of(t.entities)).select("name")


_LINKS = "links AS (SELECT concat('K', l_orderkey) AS decision_id, CASE l_linenumber WHEN 1 THEN 'DECIDED_BY' WHEN 2 THEN 'PRECEDED_BY' WHEN 3 THEN 'SOURCED_FROM' ELSE 'RELATES_TO' END AS kind, CASE l_linenumber WHEN 2 THEN concat('K', l_orderkey + l_suppkey) WHEN 3 THEN concat('D', l_orderkey) ELSE concat('P', l_partkey) END AS target_id FROM lineitem)"


def links(t):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "DECIDED_BY").when(n == 2, "PRECEDED_BY").when(n == 3, "SOURCED_FROM").otherwise("RELATES_TO")
    target = F.when(n == 2, F.concat(F.lit("K"), F.col("l_orderkey") + F.col("l_suppkey"))).when(n == 3, F.concat(F.lit("D"), "l_orderkey")).otherwise(F.concat(F.lit("P"), "l_partkey"))
    return t.lineitem.select(F.concat(F.lit("K"), "l_orderkey").alias("decision_id"), kind.alias("kind"), target.alias("target_id"))


@query("j21_decision_view", f"""
    WITH {_DECISIONS}, {_LINKS} SELECT d.id, min(e.name) FILTER (WHERE kind = 'DECIDED_BY') AS decider, coalesce(string_agg(DISTINCT e.name, '|' ORDER BY e.name) FILTER (WHERE kind = 'RELATES_TO'), '') AS related,
      min(target_id) FILTER (WHERE kind = 'PRECEDED_BY') AS preceded_by, min(target_id) FILTER (WHERE kind = 'SOURCED_FROM') AS episode
    FROM decisions d LEFT JOIN links l ON d.id = l.decision_id LEFT JOIN entities e ON l.target_id = e.id GROUP BY 1""")  # fmt: skip
def _(t):
    return D.view(decisions(t).select("id"), links(t), t.entities).select("id", "decider", F.coalesce(F.array_join("related", "|"), F.lit("")).alias("related"), "preceded_by", "episode")


@query("j22_dangling_references", f"WITH {_DECISIONS}, {_LINKS} SELECT decision_id, kind, target_id FROM links WHERE (kind = 'PRECEDED_BY' AND target_id NOT IN (SELECT id FROM decisions)) OR (kind = 'SOURCED_FROM' AND target_id NOT IN (SELECT id FROM episodes))")
def _(t):
    return D.dangling(links(t), decisions(t), t.episodes)
