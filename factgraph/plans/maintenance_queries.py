"""Queries of the nights over a stored graph and of the training examples that grow with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.functions import vocabulary as V
from factgraph.functions.places import new_path
from factgraph.operators import edges as E
from factgraph.operators import maintenance as N
from factgraph.plans.fixtures import AS_OF
from factgraph.plans.registry import query

_LOOPS = "SELECT concat('C', c_custkey) AS src, 'KNOWS' AS rel_type, concat('C', c_custkey) AS dst, 0.5E0 AS confidence, 1 AS mention_count, CAST('1992-01-01' AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to, CAST('1998-01-01' AS DATE) AS last_day, CAST(NULL AS STRING) AS audit_status FROM {customer} WHERE c_custkey % 50 = 0"


def _answer(prompts):
    """A verdict on each line of a prompt, by its number."""
    number = lambda line: F.substring_index(line, ".", 1).cast("int")
    kinds = F.array(*(F.lit(f'"verdict": "{v}", "suggested_type": "{to}"}}') for v, to in (("reclassify", "none such"), ("verify", ""), ("Verify", ""), ("reclassify", "knows"), ("quarantine", ""), ("delete", ""))))
    items = F.transform(F.split("prompt", "\n"), lambda line: F.concat(F.lit('{"index": '), number(line), F.lit(", "), F.element_at(kinds, number(line) % 6 + 1)))
    return prompts.select("batch_no", F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("raw"))


def _night(t):
    """The store after one night, and its report: edges but those of some parts, some loops, vectors of most entities and of nobody."""
    store = N.maintained_store(t.spark, new_path(t.spark, "store"))
    graph = t.edges.where("dst not like 'P%0'").unionByName(t.spark.sql(_LOOPS, customer=t.customer))
    vectors = t.entities.where("mention_count % 10 <> 3").select("id").union(t.embeddings.where("label = 1").select(F.concat(F.lit("X"), "vec_id")))
    audits = t.edges.where("mention_count > 1").select(*E.EDGE, F.col("last_day").alias("last_audited"))
    store.commit(0, {"entities": E.entity_state(t.entities), "edges": E.edge_state(graph), "vectors": vectors.select("id", F.array(F.lit(1.0)).alias("embedding")), "audits": audits})
    return store, N.nightly(store, 1, AS_OF, _answer, V.RELATION_TYPES, mentions=t.mentions)


_SQL_NIGHT = f"""
    graph AS (SELECT src, rel_type, dst, confidence, mention_count, valid_to, audit_status, CASE WHEN mention_count > 1 THEN last_day END AS late FROM edges WHERE dst NOT LIKE 'P%0'
      UNION ALL SELECT src, rel_type, dst, confidence, mention_count, valid_to, audit_status, NULL FROM ({_LOOPS.replace('{customer}', 'customer')})),
    queue AS (SELECT src, rel_type, dst, row_number() OVER (ORDER BY CASE WHEN audit_status IS NULL THEN 0 WHEN audit_status = 'quarantined' THEN 1 ELSE 2 END, late NULLS LAST, src, rel_type, dst) AS k FROM graph WHERE src <> dst QUALIFY k <= 500),
    said AS (SELECT *, ((k - 1) % 25 + 1) % 6 AS kind, count(*) OVER () AS n FROM queue),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY k) AS place FROM said),
    outcome AS (SELECT src, rel_type, dst, CASE WHEN kind IN (1, 2) THEN 'verified' WHEN kind = 3 AND rel_type <> 'KNOWS' THEN 'moved'
      WHEN kind = 5 AND place <= least(15, greatest(3, floor(n * 0.05))) THEN 'deleted' WHEN kind = 5 THEN 'none' ELSE 'quarantined' END AS done FROM numbered)"""


@query("w14_nightly_edges", f"""
    WITH {_SQL_NIGHT}, rows AS (SELECT g.*, coalesce(o.done, 'none') AS done FROM graph g LEFT JOIN outcome o ON g.src = o.src AND g.rel_type = o.rel_type AND g.dst = o.dst WHERE g.src <> g.dst)
    SELECT src, CASE done WHEN 'moved' THEN 'KNOWS' ELSE rel_type END AS rel_type, dst, CAST(sum(mention_count) AS BIGINT) AS mention_count, max(confidence) AS confidence, max(valid_to) AS valid_to,
      max(CASE done WHEN 'none' THEN audit_status WHEN 'moved' THEN 'verified' ELSE done END) AS audit_status FROM rows WHERE done <> 'deleted' GROUP BY 1, 2, 3""")  # fmt: skip
def _(t):
    return _night(t)[0].table("edges").select(*E.EDGE, "mention_count", "confidence", "valid_to", "audit_status")


@query("a30_nightly_report", f"""
    WITH {_SQL_NIGHT}, used AS (SELECT src AS id FROM graph UNION SELECT dst FROM graph UNION SELECT entity_id FROM mentions),
    n AS (SELECT (SELECT count(*) FROM graph) AS edges, (SELECT count(*) FROM entities) AS graph_entities, (SELECT count(*) FROM entities WHERE mention_count % 10 <> 3) + (SELECT count(*) FROM embeddings WHERE label = 1) AS vector_entities,
      (SELECT count(*) FROM entities WHERE id NOT IN (SELECT id FROM used)) AS orphans, (SELECT count(*) FROM graph WHERE src = dst) AS self_loops, (SELECT count(*) FROM entities WHERE mention_count % 10 = 3 AND id IN (SELECT id FROM used)) AS refreshed,
      (SELECT count(*) FROM embeddings WHERE label = 1) + (SELECT count(*) FROM entities WHERE mention_count % 10 <> 3 AND id NOT IN (SELECT id FROM used)) AS stray, (SELECT count(DISTINCT rel_type) FROM graph) AS n_types)
    SELECT n.*, count(*) AS reviewed, {", ".join(f"count(*) FILTER (WHERE done = '{d}') AS {d}" for d in ("verified", "moved", "quarantined", "deleted"))}, count(*) FILTER (WHERE done = 'none') AS over_cap,
      CASE WHEN abs(graph_entities - vector_entities) >= 0.15 * graph_entities OR vector_entities < 0.97 * graph_entities THEN 'reindex_embeddings' WHEN vector_entities < 0.995 * graph_entities THEN 'optimize' ELSE 'healthy' END AS decision
    FROM n, outcome GROUP BY ALL""")  # fmt: skip
def _(t):
    row = _night(t)[1]
    return row.select("edges", "graph_entities", "vector_entities", "orphans", "self_loops", "refreshed", "stray", F.size("types").cast("long").alias("n_types"), "reviewed", "verified", "moved", "quarantined", "deleted", "over_cap", "decision")


_KEPT = "CAST(substr(tail, 2) AS INT) % 4 <> 0"


@query("t8_accumulated_examples", f"""
    WITH seen AS (SELECT DISTINCT episode_id, head AS src, tail AS dst, CAST(substr(tail, 2) AS INT) % 11 = 0 AS bad FROM candidates WHERE {_KEPT}),
    chosen AS (SELECT id FROM entities WHERE mention_count >= 2 OR id LIKE 'S%8' OR id IN (SELECT src FROM seen) OR id IN (SELECT dst FROM seen)),
    said AS (SELECT DISTINCT episode_id, entity_id FROM (SELECT episode_id, entity_id FROM mentions UNION ALL SELECT episode_id, tail FROM candidates) WHERE entity_id IN (SELECT id FROM chosen)),
    rel AS (SELECT s.episode_id, count(*) FILTER (WHERE NOT bad) AS good, count(*) FILTER (WHERE bad) AS bad FROM seen s JOIN said a ON a.episode_id = s.episode_id AND a.entity_id = s.src JOIN said b ON b.episode_id = s.episode_id AND b.entity_id = s.dst GROUP BY 1)
    SELECT concat('O', o_orderkey) AS id, concat('order ', o_orderkey) AS text, n_entities, coalesce(good, 0) AS n_relations, coalesce(bad, 0) AS n_negatives
    FROM orders JOIN (SELECT episode_id, count(*) AS n_entities FROM said GROUP BY 1) x ON x.episode_id = concat('O', o_orderkey) LEFT JOIN rel r ON r.episode_id = x.episode_id WHERE o_orderdate <= DATE '2000-01-01'""")  # fmt: skip
def _(t):
    store = N.maintained_store(t.spark, new_path(t.spark, "store"))
    tail = F.substring("tail", 2, 99).cast("int")
    said = t.candidates.where(tail % 4 != 0).select(F.col("head").alias("src"), F.lit("CUSTOMER_OF").alias("rel_type"), F.col("tail").alias("dst"), F.col("score").alias("confidence"), F.lit("").alias("snippet"), "episode_id", "pos", "day")
    status = F.when(F.substring("dst", 2, 99).cast("int") % 11 == 0, "quarantined")
    edges = E.edge_rows(said, ["day", "episode_id", "pos"]).withColumn("audit_status", status)
    store.commit(0, {"entities": E.entity_state(t.entities), "edges": edges, "seen_in": E.edge_episodes(said, ["day", "episode_id", "pos"])})
    mentions = t.mentions.select("episode_id", "entity_id").union(t.candidates.select("episode_id", "tail"))
    episodes = t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit("order "), "o_orderkey").alias("content"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    cursor, named = new_path(t.spark, "cursor"), t.entities.where("id like 'S%8'").select("id")
    for night, until in enumerate(("1996-01-01", "2000-01-01"), 1):  # the second run goes on where the first ended
        N.accumulate(store, night, cursor, episodes, mentions, named, F.lit(until).cast("timestamp"))
    size = lambda c: F.size(c).cast("long")
    return store.table("examples").select("id", "text", size("entities").alias("n_entities"), size("relations").alias("n_relations"), size("negatives").alias("n_negatives"))
