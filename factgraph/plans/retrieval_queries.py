"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import vocabulary as V
from factgraph.functions.places import written
from factgraph.operators import answer as A
from factgraph.operators import metrics as M
from factgraph.operators import retrieve as R
from factgraph.operators import traverse as T
from factgraph.plans.graph_queries import _KEYS, _NEAR, WITH_STRENGTH, day, strong
from factgraph.plans.registry import query

# questions: one for each region and nation, of names that the graph holds and others
QUESTIONS = """questions AS (
      SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'who works with ' || n_name || ' and lives in the city'
        WHEN 1 THEN 'Supplier#' || (n_nationkey + 1) || ' goes to ' || n_name ELSE 'reports about things that relate' END AS q FROM nation)"""
_COS = "1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])) / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * list_dot_product(CAST(q.q AS DOUBLE[]), CAST(q.q AS DOUBLE[])))"
_ASKED = "asked AS (SELECT vec_id AS query_id, embedding AS q, CASE WHEN vec_id % 2 = 0 THEN 'Person' END AS want_type FROM embeddings WHERE vec_id % 100 = 0)"


def questions(t):
    q = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("who works with "), "n_name", F.lit(" and lives in the city")))
    q = q.when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("Supplier#"), F.col("n_nationkey") + 1, F.lit(" goes to "), "n_name")).otherwise("reports about things that relate")
    return t.nation.select(F.col("n_nationkey").alias("query_id"), q.alias("q"))


def asked(t):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.when(F.col("vec_id") % 2 == 0, "Person").alias("want_type"))


_DENSE = f"""dense AS (SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM (
      SELECT q.query_id, v.vec_id, round(greatest(0, {_COS}), 12) AS distance, round(exp(-distance), 6) AS score FROM vectors v JOIN asked q ON q.want_type IS NULL OR q.want_type = v.entity_type)) WHERE rank <= 5)"""


@query("r1_dense_search", f"WITH {_ASKED}, {_DENSE} SELECT * FROM dense")
def _(t):
    return R.dense_search(t.vectors, asked(t))


@query("r2_euclidean_search", f"""
    WITH {_ASKED} SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM (
      SELECT q.query_id, v.vec_id, round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])), 12) AS distance, round(exp(-distance), 6) AS score FROM vectors v CROSS JOIN asked q)) WHERE rank <= 5""")  # fmt: skip
def _(t):
    return R.dense_search(t.vectors, asked(t).drop("want_type"), metric="euclidean")


_TERMS = "terms AS (SELECT r_regionkey * 100 AS query_id, lower(left(r_name, 2)) AS q FROM region)"  # ids of the dense questions
_KEYWORD = """keyword AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM (
      SELECT t.query_id, e.id, CAST(CASE WHEN lower(e.name) = t.q THEN 1.0 WHEN contains(lower(e.name), t.q) THEN 0.9 ELSE 0.7 END AS DOUBLE) AS score
      FROM entities e JOIN terms t ON contains(lower(e.name), t.q) OR contains(lower(e.description), t.q))) WHERE rank <= 10)"""


def terms(t):
    return t.region.select((F.col("r_regionkey") * 100).alias("query_id"), F.lower(F.substring("r_name", 1, 2)).alias("q"))


@query("r3_keyword_search", f"WITH {_TERMS}, {_KEYWORD} SELECT * FROM keyword")
def _(t):
    return R.keyword_search(t.entities.withColumnRenamed("description", "content"), terms(t))


@query("r4_ranked_text_search", """
    WITH tokens AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM documents),
    q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM benchmark),
    size AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tokens),
    counted AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM tokens) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    spread AS (SELECT term, count(*) AS df FROM counted GROUP BY 1),
    scored AS (SELECT q.query_id, c.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
      FROM counted c JOIN spread USING (term) CROSS JOIN size JOIN q USING (term) GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM scored) WHERE rank <= 10""")  # fmt: skip
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return R.bm25(docs, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")))


_HYBRID = """SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM (
      SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.id, k.id) AS id, round(0.7 * coalesce(d.score, 0) + 0.3 * coalesce(k.score, 0), 8) AS score
      FROM (SELECT query_id, concat('P', vec_id) AS id, score FROM dense) d FULL JOIN keyword k ON d.query_id = k.query_id AND d.id = k.id)) WHERE rank <= 10"""


@query("j18_hybrid_search", f"WITH {_ASKED}, {_DENSE}, {_TERMS}, {_KEYWORD} {_HYBRID}")
def _(t):
    dense = R.dense_search(t.vectors, asked(t)).select("query_id", F.concat(F.lit("P"), "vec_id").alias("id"), "score")
    return R.fuse(dense, R.keyword_search(t.entities.withColumnRenamed("description", "content"), terms(t)))


_WORDLIST = "regexp_extract_all(q, '[\\p{L}0-9_''-]+')"
NAMES = rf"""picked AS (SELECT query_id, [w FOR w IN {_WORDLIST} IF length(w) > 2 AND regexp_matches(w, '^(?:\p{{Lu}}[\p{{Ll}}0-9''-]*|[\p{{Lu}}0-9]*\p{{Lu}}[\p{{Lu}}0-9]*)$')] AS named,
        [w FOR w IN {_WORDLIST} IF length(w) >= 4 AND regexp_matches(w, '^\p{{L}}+$')] AS plain FROM questions),
    spelled AS (SELECT query_id, w, i FROM (SELECT query_id, unnest(xs) AS w, generate_subscripts(xs, 1) AS i FROM (SELECT query_id, CASE WHEN len(named) > 0 THEN named ELSE plain END AS xs FROM picked))),
    names AS (SELECT query_id, name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INT) AS pos FROM (SELECT query_id, arg_min(w, i) AS name, min(i) AS i FROM spelled GROUP BY query_id, lower(w)))"""


@query("r6_question_names", f"WITH {QUESTIONS}, {NAMES} SELECT query_id, pos, name FROM names")
def _(t):
    return R.question_names(questions(t))


_FOUND = f"""{_KEYS}, exact AS (SELECT n.query_id, k.id FROM names n JOIN keys k ON lower(trim(n.name)) = k.key WHERE n.pos < 5),
    loose AS (SELECT n.query_id, e.id, n.pos, min(n.pos) OVER (PARTITION BY n.query_id) AS first FROM names n JOIN entities e ON contains(lower(e.name), lower(n.name))
      WHERE n.pos < 5 AND n.query_id NOT IN (SELECT query_id FROM exact)),
    found AS (SELECT DISTINCT query_id, id, 'graph_exact' AS source FROM exact UNION SELECT query_id, id, 'graph_fuzzy' FROM loose WHERE pos = first)"""


def found(t):
    return R.exact_else_contains(R.question_names(questions(t)), T.names_of(t.entities), t.entities)


@query("r7_exact_else_contains", f"WITH {QUESTIONS}, {NAMES}, {_FOUND} SELECT * FROM found")
def _(t):
    return found(t)


_MERGE = """merged AS (SELECT * FROM (SELECT query_id, entity, score, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS INT) AS rank FROM (
      SELECT query_id, lower(entity) AS key, max(score) AS score, arg_min(entity, (side, entity)) AS entity, CASE WHEN min(side) = max(side) THEN min(side) ELSE 'combined' END AS source
      FROM both_sides GROUP BY 1, 2)) WHERE rank <= 10)"""
_SIDES = """both_sides AS (SELECT f.query_id, e.name AS entity, CASE f.source WHEN 'graph_exact' THEN 0.6 ELSE 0.5 END AS score, 'graph' AS side FROM found f JOIN entities e ON f.id = e.id
      UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END, 0.55, 'vector' FROM nation)"""


def merged(t):
    graph = found(t).join(t.entities.select("id", "name").hint("merge"), "id").select("query_id", F.col("name").alias("entity"), F.when(F.col("source") == "graph_exact", 0.6).otherwise(0.5).alias("score"))
    vector = t.nation.select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("entity"), F.lit(0.55).alias("score"))
    return R.merge_results(graph, vector)


@query("j17_r8_merge_results", f"WITH {QUESTIONS}, {NAMES}, {_FOUND}, {_SIDES}, {_MERGE} SELECT query_id, entity, score, source, rank FROM merged")
def _(t):
    return merged(t)


_INTENT = " + ".join(f"CASE WHEN list_contains(types, '{k}') AND list_has_any(words, {list(v)}) THEN 1 ELSE 0 END" for k, v in V.INTENT.items())
_RERANK = f"""ids AS (SELECT lower(name) AS key, min(id) AS id FROM entities GROUP BY 1),
    anchors AS (SELECT DISTINCT n.query_id, k.id FROM names n JOIN keys k ON lower(trim(n.name)) = k.key WHERE n.pos < 3),
    wanted AS (SELECT DISTINCT m.query_id, a.id AS a, i.id AS b FROM merged m JOIN ids i ON lower(m.entity) = i.key JOIN anchors a ON m.query_id = a.query_id WHERE a.id <> i.id),
    apart AS (SELECT query_id, b AS id, min(hops) AS hops FROM (
      SELECT w.query_id, w.b, 1 AS hops FROM wanted w JOIN near n ON n.id = w.a AND n.other = w.b
      UNION ALL SELECT w.query_id, w.b, 2 FROM wanted w JOIN near n ON n.id = w.a JOIN near o ON o.id = w.b AND o.other = n.other) GROUP BY 1, 2),
    around AS (SELECT id, count(DISTINCT other) AS neighbors, round(avg(strength), 6) AS avg_strength, list_distinct(list(rel_type)) AS types FROM near GROUP BY 1),
    words AS (SELECT query_id, q, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS words FROM (SELECT query_id, q, regexp_extract_all(lower(q), '[a-z]+') AS w FROM questions)),
    ready AS (SELECT m.*, w.q, w.words, coalesce(a.neighbors, 0) AS neighbors, coalesce(a.avg_strength, 0) AS avg_strength, coalesce(a.types, []) AS types, p.hops
      FROM merged m JOIN words w USING (query_id) LEFT JOIN ids e ON lower(m.entity) = e.key LEFT JOIN around a ON e.id = a.id LEFT JOIN apart p ON m.query_id = p.query_id AND e.id = p.id),
    final AS (SELECT query_id, entity, score, round(score * (1 + ln(1.0 + neighbors) * 0.1 + avg_strength * 0.2) + CASE WHEN hops BETWEEN 1 AND 2 THEN (3 - hops) * 0.15 ELSE 0 END
        + least(0.1, 0.05 * ({_INTENT})) + CASE WHEN contains(lower(q), lower(entity)) OR len([w FOR w IN regexp_split_to_array(lower(entity), '\\s+') IF length(w) > 2 AND contains(lower(q), w)]) > 0 THEN 1.5 ELSE 0 END, 6) AS final FROM ready)"""
_ALL = f"WITH {WITH_STRENGTH}, {_NEAR}, {QUESTIONS}, {NAMES}, {_FOUND}, {_SIDES}, {_MERGE}, {_RERANK}"


def reranked(t):
    return R.graph_rerank(merged(t).drop("rank"), questions(t), t.entities, strong(t))


@query("r9_r10_graph_rerank", f"{_ALL} SELECT query_id, entity, score, final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, entity) AS INT) AS rank FROM final")
def _(t):
    return reranked(t).select("query_id", "entity", "score", "final", "rank")


@query("a35_rank_lift", f"""{_ALL}, moved AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS o, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, entity) AS n FROM final),
    each_query AS (SELECT query_id, avg(o - n) AS change, bool_or(n = 1 AND o <> 1) AS lifted FROM moved GROUP BY 1)
    SELECT count(*) AS queries, round(avg(change), 3) AS rank_improvement_avg, round(100.0 * count(*) FILTER (WHERE lifted) / count(*), 1) AS rerank_lift_pct FROM each_query""")  # fmt: skip
def _(t):
    return R.rank_lift(reranked(t))


@query("r11_external_rerank", "SELECT c_custkey AS query_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM customer JOIN orders ON c_custkey = o_custkey")
def _(t):
    scored = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return R._top(scored, ["query_id"], [F.desc("score"), F.asc("id")], 1 << 30).drop("score")


@query("r12_paged_list", "SELECT id, name, (SELECT count(*) FROM entities) AS total FROM entities ORDER BY name, id LIMIT 50 OFFSET 100")
def _(t):
    return R.paged(t.entities.select("id", "name"), ["name", "id"], 50, 100)


@query("r13_latest_relationships", "SELECT src, rel_type, dst, last_day FROM edges ORDER BY last_day DESC, src, rel_type, dst LIMIT 200")
def _(t):
    return T.latest_relationships(t.edges).select("src", "rel_type", "dst", "last_day")


@query("r14_recent_retrievals", "SELECT id, source, result_count FROM logs ORDER BY ts DESC, id DESC LIMIT 100")
def _(t):
    return M.recent(t.logs, ["ts", "id"]).select("id", "source", "result_count")


@query("r15_query_log", f"WITH {QUESTIONS}, {NAMES}, {_FOUND}, {_SIDES}, {_MERGE} SELECT query_id, count(*) AS results, count(*) FILTER (WHERE source <> 'vector') AS graph_results, string_agg(entity, '|' ORDER BY rank) AS names FROM merged GROUP BY 1")
def _(t):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda r: r["entity"]), "|")
    return merged(t).groupBy("query_id").agg(F.count("*").alias("results"), F.count_if(F.col("source") != "vector").alias("graph_results"), names.alias("names"))


@query("r16_question_facts", f"""
    WITH {WITH_STRENGTH}, {QUESTIONS}, {NAMES}, {_FOUND},
    facts AS (SELECT f.query_id, s.dst, s.rel_type, row_number() OVER (PARTITION BY f.query_id, f.id ORDER BY s.strength DESC, s.valid_from DESC, s.rel_type, s.dst) AS rank
      FROM found f JOIN strong s ON f.id = s.src WHERE (s.valid_from IS NULL OR s.valid_from <= DATE '2002-01-01') AND (s.valid_to IS NULL OR s.valid_to > DATE '2002-01-01'))
    SELECT query_id, string_agg(rel_type || ' ' || dst, '|' ORDER BY rel_type, dst) AS facts FROM facts WHERE rank <= 10 GROUP BY 1""")  # fmt: skip
def _(t):
    ids = written(found(t).select("query_id", F.col("id").alias("src")), "asked")
    edges = t.edges.join(ids.select("src").distinct().hint("merge"), "src", "left_semi")  # only their edges are ranked
    facts = T.current_facts(edges, day(), top=10).select("src", "rel_type", "dst").join(ids.hint("merge"), "src")
    return facts.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "rel_type", "dst"))), "|").alias("facts"))


@query("h1_hash_embedding", r"""
    WITH tokens AS (SELECT id, sha256(unnest(regexp_extract_all(lower(name), '[a-z0-9_]+'))) AS h FROM entities),
    parts AS (SELECT id, h, w, substr(h, w * 8 + 1, 2) AS b0, substr(h, w * 8 + 7, 2) || substr(h, w * 8 + 5, 2) || substr(h, w * 8 + 3, 2) || substr(h, w * 8 + 1, 2) AS le FROM tokens, (SELECT unnest(range(8)) AS w)),
    summed AS (SELECT id, CAST(('0x' || le) AS BIGINT) % 64 AS i, sum(CASE WHEN CAST(('0x' || b0) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM parts GROUP BY 1, 2),
    whole AS (SELECT id, map(list(i), list(x)) AS m, sqrt(sum(x * x)) AS size FROM summed GROUP BY 1)
    SELECT id, [round(coalesce(m[i], 0.0) / greatest(size, 1e-12), 6) FOR i IN range(64)] AS embedding FROM whole""")  # fmt: skip
def _(t):
    return R.hash_embedding(t.entities.select("id", F.col("name").alias("text")))


@query("h2_fitted_vectors", "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) FOR x IN list_slice(embedding, 1, 48)]), 4) AS head, 80 AS size FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(F.aggregate(C.fitted(F.col("embedding"), 48), F.lit(0.0), lambda s, x: s + x), 4).alias("head"), F.size(C.fitted(F.col("embedding"), 80)).alias("size"))


def _embedded(name: str, source: str) -> str:
    """CTEs that embed a table of (id, text) by the hashes of its tokens."""
    return f"""{name}_tokens AS (SELECT id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS h FROM ({source})),
    {name}_parts AS (SELECT id, h, w, substr(h, w * 8 + 1, 2) AS b0, substr(h, w * 8 + 7, 2) || substr(h, w * 8 + 5, 2) || substr(h, w * 8 + 3, 2) || substr(h, w * 8 + 1, 2) AS le FROM {name}_tokens, (SELECT unnest(range(8)) AS w)),
    {name}_summed AS (SELECT id, CAST(('0x' || le) AS BIGINT) % 64 AS i, sum(CASE WHEN CAST(('0x' || b0) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM {name}_parts GROUP BY 1, 2),
    {name}_whole AS (SELECT id, map(list(i), list(x)) AS m, sqrt(sum(x * x)) AS size FROM {name}_summed GROUP BY 1),
    {name} AS (SELECT id, [CAST(round(coalesce(m[i], 0.0) / greatest(size, 1e-12), 6) AS DOUBLE) FOR i IN range(64)] AS embedding FROM {name}_whole)"""


_EMBEDDED = _embedded("entity_vectors", "SELECT id, name || ' ' || entity_type || ' ' || left(description, 200) AS text FROM entities") + ", " + _embedded("question_vectors", "SELECT query_id AS id, q AS text FROM questions")
_ANSWERS = f"""WITH {WITH_STRENGTH}, {_NEAR}, {QUESTIONS}, {NAMES}, {_KEYS}, {_EMBEDDED},
    facts AS (SELECT src AS id, list(rel_type || ' ' || dst ORDER BY rank) AS facts FROM (
      SELECT *, row_number() OVER (PARTITION BY src ORDER BY strength DESC, valid_from DESC, rel_type, dst) AS rank FROM strong
      WHERE (valid_from IS NULL OR valid_from <= DATE '2002-01-01') AND (valid_to IS NULL OR valid_to > DATE '2002-01-01')) WHERE rank <= 10 GROUP BY 1),
    exact AS (SELECT n.query_id, k.id, min(n.pos) AS place FROM names n JOIN keys k ON lower(trim(n.name)) = k.key JOIN facts f ON f.id = k.id WHERE n.pos < 5 GROUP BY 1, 2),
    met AS (SELECT n.query_id, n.pos, e.id, row_number() OVER (PARTITION BY n.query_id, n.pos ORDER BY e.name, e.id) AS n
      FROM names n JOIN entities e ON contains(lower(e.name), lower(n.name)) WHERE n.pos < 5 AND n.query_id NOT IN (SELECT query_id FROM exact)),
    loose AS (SELECT *, min(pos) OVER (PARTITION BY query_id) AS least FROM met JOIN facts USING (id) WHERE n <= 5),
    apart_ AS (SELECT q.id AS query_id, v.id, round(greatest(0, 1 - list_dot_product(v.embedding, q.embedding) / sqrt(list_dot_product(v.embedding, v.embedding) * list_dot_product(q.embedding, q.embedding))), 12) AS distance FROM question_vectors q, entity_vectors v),
    ranked_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM apart_),
    sides AS (SELECT query_id, id, 0 AS side, place, 'graph_exact' AS source, 0.5 AS score FROM exact
      UNION ALL SELECT query_id, id, 0, n, 'graph_fuzzy', 0.5 FROM loose WHERE pos = least
      UNION ALL SELECT query_id, id, 1, n, 'vector', round(exp(-distance), 6) FROM ranked_ JOIN facts USING (id) WHERE n <= 5),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY side, place) AS r FROM sides) WHERE r = 1),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY side, place, id) AS m FROM once) WHERE m <= 5),
    found_ AS (SELECT k.query_id, k.id, e.name AS entity, k.source, k.score, CASE WHEN k.side = 0 THEN f.facts ELSE f.facts[1:5] END AS facts FROM kept k JOIN entities e ON e.id = k.id JOIN facts f ON f.id = k.id),
    anchors AS (SELECT DISTINCT n.query_id, k.id FROM names n JOIN keys k ON lower(trim(n.name)) = k.key WHERE n.pos < 3),
    wanted AS (SELECT DISTINCT m.query_id, a.id AS a, m.id AS b FROM found_ m JOIN anchors a ON m.query_id = a.query_id WHERE a.id <> m.id),
    apart AS (SELECT query_id, b AS id, min(hops) AS hops FROM (
      SELECT w.query_id, w.b, 1 AS hops FROM wanted w JOIN near n ON n.id = w.a AND n.other = w.b
      UNION ALL SELECT w.query_id, w.b, 2 FROM wanted w JOIN near n ON n.id = w.a JOIN near o ON o.id = w.b AND o.other = n.other) GROUP BY 1, 2),
    around AS (SELECT id, count(DISTINCT other) AS neighbors, round(avg(strength), 6) AS avg_strength FROM near GROUP BY 1),
    words AS (SELECT query_id, q, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS words FROM (SELECT query_id, q, regexp_extract_all(lower(q), '[a-z]+') AS w FROM questions)),
    ready AS (SELECT m.*, w.q, w.words, coalesce(a.neighbors, 0) AS neighbors, coalesce(a.avg_strength, 0) AS avg_strength, list_distinct([split_part(f, ' ', 1) FOR f IN m.facts]) AS types, p.hops
      FROM found_ m JOIN words w USING (query_id) LEFT JOIN around a ON m.id = a.id LEFT JOIN apart p ON m.query_id = p.query_id AND m.id = p.id),
    final AS (SELECT query_id, id, entity, source, score, facts, round(score * (1 + ln(1.0 + neighbors) * 0.1 + avg_strength * 0.2) + CASE WHEN hops BETWEEN 1 AND 2 THEN (3 - hops) * 0.15 ELSE 0 END
        + least(0.1, 0.05 * ({_INTENT})) + CASE WHEN contains(lower(q), lower(entity)) OR len([w FOR w IN regexp_split_to_array(lower(entity), '\\s+') IF length(w) > 2 AND contains(lower(q), w)]) > 0 THEN 1.5 ELSE 0 END, 6) AS final FROM ready)"""


def answers(t):
    vectors = A.entity_vectors(t.entities).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return A.answer(questions(t), t.entities, strong(t), written(vectors, "vectors"), day())


@query("r17_answers", f"{_ANSWERS} SELECT query_id, id, entity, source, score, final, array_to_string(facts, '|') AS facts, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, entity) AS INT) AS rank FROM final")
def _(t):
    text = F.array_join(F.transform("facts", lambda f: F.concat_ws(" ", f["rel_type"], f["target"])), "|")
    return answers(t).select("query_id", "id", "entity", "source", "score", "final", text.alias("facts"), "rank")


@query("r15_answer_log", f"""{_ANSWERS}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, entity) AS rank FROM final)
    SELECT query_id, CASE WHEN count(*) FILTER (WHERE source <> 'vector') BETWEEN 1 AND count(*) - 1 THEN 'combined' ELSE min(source) END AS source, count(*) AS results,
      count(*) FILTER (WHERE source <> 'vector') AS graph_results, string_agg(entity, '|' ORDER BY rank) AS names FROM placed GROUP BY 1""")  # fmt: skip
def _(t):
    return A.retrieval_source(answers(t))
