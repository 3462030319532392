"""Queries of measures, health rules and vocabulary adoption."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.operators import metrics as M
from factgraph.operators import traverse as T
from factgraph.plans.fixtures import LOG_DAY
from factgraph.plans.graph_queries import _NEAR, WITH_STRENGTH, strong
from factgraph.plans.registry import query


@query("a1_counts", "SELECT 'entities' AS kind, count(*) AS n FROM entities UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'episodes', count(*) FROM episodes")
def _(t):
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one(t.entities, "entities").union(one(t.edges, "edges")).union(one(t.episodes, "episodes"))


@query("a2_type_counts", "SELECT entity_type AS type, count(*) AS n FROM entities GROUP BY 1 UNION ALL SELECT rel_type, count(*) FROM edges GROUP BY 1")
def _(t):
    return M.type_counts(t.entities, "entity_type").union(M.type_counts(t.edges, "rel_type"))


@query("a3_neighbourhood", f"WITH {WITH_STRENGTH}, {_NEAR} SELECT e.id, coalesce(n.neighbors, 0) AS neighbors, coalesce(n.avg_strength, 0.0) AS avg_strength FROM entities e LEFT JOIN (SELECT id, count(DISTINCT other) AS neighbors, sum(CAST(round(strength * 1000000) AS BIGINT)) / count(*) / 1000000 AS avg_strength FROM near GROUP BY 1) n ON e.id = n.id")
def _(t):
    return T.neighbourhood(strong(t), t.entities)


_DEGREE = "degree AS (SELECT e.id, e.last_day, e.confidence, e.mention_count, coalesce(d.n, 0) AS degree FROM entities e LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d ON e.id = d.id)"


@query("a4_top_degree", f"WITH {_DEGREE} SELECT id, degree FROM degree ORDER BY degree DESC, id LIMIT 10")
def _(t):
    return M.degrees(t.entities, t.edges).orderBy(F.desc("degree"), "id").limit(10).select("id", "degree")


@query("a4_all_degrees", f"WITH {_DEGREE} SELECT id, degree FROM degree")
def _(t):
    return M.degrees(t.entities, t.edges).select("id", "degree")


@query("a4_recent_entities", "SELECT id, last_day FROM entities ORDER BY last_day DESC NULLS LAST, id LIMIT 10")
def _(t):
    return t.entities.orderBy(F.desc_nulls_last("last_day"), "id").limit(10).select("id", "last_day")


@query("a5_top_strength", f"WITH {WITH_STRENGTH} SELECT src, rel_type, dst, strength FROM strong ORDER BY strength DESC, src, rel_type, dst LIMIT 50")
def _(t):
    return strong(t).orderBy(F.desc("strength"), "src", "rel_type", "dst").limit(50).select("src", "rel_type", "dst", "strength")


@query("a6_hotspots", "SELECT src, dst, mention_count FROM edges WHERE rel_type = 'CUSTOMER_OF' AND mention_count >= 3 ORDER BY mention_count DESC, src, dst LIMIT 50")
def _(t):
    return t.edges.where("rel_type = 'CUSTOMER_OF' and mention_count >= 3").orderBy(F.desc("mention_count"), "src", "dst").limit(50).select("src", "dst", "mention_count")


@query("a7_audit_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE audit_status IS NULL) AS unaudited, count(*) FILTER (WHERE audit_status IN ('quarantined', 'deleted')) AS flagged, round(100.0 * count(audit_status) / count(*), 2) AS audited_pct FROM edges")
def _(t):
    return M.audit_coverage(t.edges)


@query("a8_dashboard", "SELECT e.n AS entities, r.n AS edges, r.k AS rel_types, 0.0 AS generic_share, round(r.n / e.n, 4) AS density FROM (SELECT count(*) AS n FROM entities) e, (SELECT count(*) AS n, count(DISTINCT rel_type) AS k FROM edges) r")
def _(t):
    return M.dashboard(t.entities, t.edges)


@query("a9_source_yield", """
    SELECT *, CAST(row_number() OVER (ORDER BY quality DESC, source) AS INT) AS from_top, CAST(row_number() OVER (ORDER BY quality, source DESC) AS INT) AS from_bottom FROM (
      SELECT source, count(*) AS runs, round(avg(result_count), 4) AS avg_entities, round(avg(relations), 4) AS avg_relations, sum(result_count) AS total_entities, sum(fallbacks) AS total_uniques,
        round(coalesce(sum(fallbacks) / nullif(sum(result_count), 0), 0) * (1 + 0.1 * avg(relations)), 6) AS quality, min(day) AS first_day, max(day) AS last_day FROM logs GROUP BY 1)""")  # fmt: skip
def _(t):
    return M.source_yield(t.logs.select("source", F.col("result_count").alias("entities"), F.col("fallbacks").alias("uniques"), "relations", "day"))


@query("a10_daily_sources", f"SELECT source, count(*) AS runs, sum(result_count) AS entities FROM logs WHERE day = DATE '{LOG_DAY}' GROUP BY 1")
def _(t):
    return t.logs.where(F.col("day") == F.lit(LOG_DAY).cast("date")).groupBy("source").agg(F.count("*").alias("runs"), F.sum("result_count").alias("entities"))


_PCT = "list_sort(list(latency))[1 + CAST(least(floor(count(*) * {p} / 100.0), count(*) - 1) AS INT)]"


@query("a11_retrieval_summary", f"SELECT source, count(*) AS n, round(avg(latency), 4) AS avg_latency, round(count(*) FILTER (WHERE result_count > 0) / count(*), 4) AS hit_rate, round(avg(result_count), 4) AS avg_results, {_PCT.format(p=50)} AS p50, {_PCT.format(p=95)} AS p95 FROM logs GROUP BY 1")
def _(t):
    return M.retrieval_summary(t.logs, ["source"])


@query("a12_session_counters", "SELECT user_id, count(*) AS queries, count(*) FILTER (WHERE result_count > 0) AS hits FROM logs GROUP BY 1")
def _(t):
    return t.logs.groupBy("user_id").agg(F.count("*").alias("queries"), F.count_if(F.col("result_count") > 0).alias("hits"))


@query("a13_t5_weekly_trend", "SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n, round(avg(latency), 4) AS avg_latency, round(count(*) FILTER (WHERE result_count > 0) / count(*), 4) AS connected_share FROM logs GROUP BY 1")
def _(t):
    return M.weekly_trend(t.logs)


@query("a14_n11_daily_growth", """
    SELECT *, requests - coalesce(lag(requests) OVER (ORDER BY day), 0) AS growth FROM (
      SELECT day, count(*) AS requests, count(*) FILTER (WHERE source = 'error') AS errors, round(sum(fallbacks) / greatest(sum(relations), 1), 4) AS fallback_rate FROM logs GROUP BY 1)""")  # fmt: skip
def _(t):
    return M.daily_growth(t.logs)


@query("a15_ingestion_counters", "SELECT day, sum(result_count) AS entities, sum(relations) AS relations, round(sum(relations) / count(*), 4) AS per_job, round(sum(fallbacks) / sum(relations), 4) AS fallback_rate FROM logs GROUP BY 1")
def _(t):
    return t.logs.groupBy("day").agg(F.sum("result_count").alias("entities"), F.sum("relations").alias("relations"), F.round(F.sum("relations") / F.count("*"), 4).alias("per_job"), F.round(F.sum("fallbacks") / F.sum("relations"), 4).alias("fallback_rate"))


@query("a16_result_diversity", "SELECT episode_id, round(count(DISTINCT tail_type) / count(*), 4) AS diversity, round(count(*) FILTER (WHERE score > 0) / count(*), 4) AS connected FROM candidates GROUP BY 1")
def _(t):
    return t.candidates.groupBy("episode_id").agg(F.round(F.countDistinct("tail_type") / F.count("*"), 4).alias("diversity"), M.share(F.col("score") > 0).alias("connected"))


@query("a17_suggestion_digest", "SELECT kind, key, n FROM (SELECT 'fallback' AS kind, label AS key, count(*) AS n FROM candidates WHERE score < 0.3 GROUP BY 2 UNION ALL SELECT 'hotspot', src, max(mention_count) FROM edges WHERE mention_count >= 3 GROUP BY 2)")
def _(t):
    fallbacks = t.candidates.where("score < 0.3").groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n")).select(F.lit("fallback").alias("kind"), "key", "n")
    hot = t.edges.where("mention_count >= 3").groupBy(F.col("src").alias("key")).agg(F.max("mention_count").alias("n")).select(F.lit("hotspot").alias("kind"), "key", "n")
    return fallbacks.unionByName(hot)


_HISTORY = """history AS (SELECT kind, value, count(DISTINCT day) AS days, count(*) AS total, round(count(DISTINCT day) / (date_diff('day', min(day), DATE '2024-01-30') + 1), 6) AS frequency FROM (
      SELECT CASE WHEN user_id % 2 = 0 THEN 'relation' ELSE 'entity' END AS kind, concat(source, user_id % 10) AS value, day FROM logs) GROUP BY 1, 2)"""


def history(t):
    daily = t.logs.groupBy(F.when(F.col("user_id") % 2 == 0, "relation").otherwise("entity").alias("kind"), F.concat("source", F.col("user_id") % 10).alias("value"), "day").agg(F.count("*").alias("n"))
    return M.adoption(daily, F.lit(LOG_DAY).cast("date"))


@query("a18_adoption_history", f"WITH {_HISTORY} SELECT kind, value, days, total, frequency FROM history")
def _(t):
    return history(t).select("kind", "value", "days", "total", "frequency")


@query("a19_adoption", f"""
    WITH {_HISTORY} SELECT kind, value, total FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY total DESC, value) AS rank FROM history WHERE days >= 3 AND total >= 5 AND frequency >= 0.4)
    WHERE rank <= CASE kind WHEN 'relation' THEN 3 ELSE 2 END""")  # fmt: skip
def _(t):
    return M.adopt(history(t)).select("kind", "value", "total")


@query("a20_n9_schema_drift", """
    WITH daily AS (SELECT day, list(DISTINCT source || CAST(user_id % 7 AS STRING)) FILTER (WHERE value_ok) AS types FROM (SELECT *, latency > 40 AS value_ok FROM logs) GROUP BY 1),
    seen AS (SELECT day, types, lag(types) OVER (ORDER BY day) AS before FROM daily),
    changed AS (SELECT day, len(types) AS n_types, round(CASE WHEN before IS NULL THEN 0.0 ELSE (len(types) - len(before)) * 100.0 / len(before) END, 4) AS change,
      CASE WHEN before IS NULL THEN '' ELSE array_to_string(list_sort([x FOR x IN types IF NOT list_contains(before, x)]), '|') END AS new_types FROM seen)
    SELECT day, CAST(n_types AS INT) AS n_types, change, new_types, CASE WHEN abs(change) > 10 THEN 'high' WHEN abs(change) > 5 THEN 'warn' ELSE 'none' END AS alarm FROM changed""")  # fmt: skip
def _(t):
    daily = t.logs.where("latency > 40").groupBy("day").agg(F.collect_set(F.concat("source", (F.col("user_id") % 7).cast("string"))).alias("types"))
    return M.drift(daily).select("day", F.size("types").alias("n_types"), "change", F.array_join("new_types", "|").alias("new_types"), "alarm")


_ROLL = "rolled AS (SELECT *, count(*) OVER f AS rows_, round(sum(fallbacks) OVER f / greatest(sum(relations) OVER f, 1), 6) AS rate, row_number() OVER (PARTITION BY epoch ORDER BY ts, id) AS rn FROM (SELECT *, user_id % 3 AS epoch FROM logs) WINDOW f AS (PARTITION BY epoch ORDER BY ts, id ROWS BETWEEN {n} PRECEDING AND CURRENT ROW))"


@query("a21_n8_spikes", f"WITH {_ROLL.format(n=49)} SELECT id, rate, rate / 0.3 > 2 AS spike FROM rolled WHERE rn % 10 = 0")
def _(t):
    jobs = t.logs.withColumn("epoch", F.col("user_id") % 3)
    return M.spikes(M.rolling_health(jobs, 50, 10), 0.3).select("id", "rate", "spike")


@query("a22_degradation", f"WITH {_ROLL.format(n=99)} SELECT id, rate, rows_ = 100 AND rate > 0.3 + 0.15 AS degraded FROM rolled")
def _(t):
    jobs = t.logs.withColumn("epoch", F.col("user_id") % 3)
    return M.degraded(M.rolling_health(jobs, 100), 0.3, 100).select("id", "rate", "degraded")


@query("a31_t11_signal_counts", "SELECT source AS signal_type, count(*) AS n FROM logs GROUP BY 1")
def _(t):
    return t.logs.groupBy(F.col("source").alias("signal_type")).agg(F.count("*").alias("n"))


_HEALTH = "health AS (SELECT user_id, count(*) * 10 AS graph_entities, count(*) * 10 - sum(CASE WHEN result_count = 0 THEN 1 ELSE 0 END) * (user_id % 8) AS vector_entities, 1 - (user_id % 10) / 200.0 AS completeness, (user_id % 600) AS pending, CASE WHEN user_id % 13 = 0 THEN 1 ELSE 0 END AS stuck, CASE WHEN user_id % 17 = 0 THEN 2 ELSE 0 END AS dead, round(count(*) FILTER (WHERE source = 'error') / count(*), 4) AS error_rate, round(avg(latency) * 4, 3) AS avg_ms, max(latency) * 1.5 AS p95_ms FROM logs GROUP BY user_id)"


@query("a32_infra_health", f"""
    WITH {_HEALTH}, m AS (SELECT *, round(abs(graph_entities - vector_entities) / graph_entities, 6) AS drift FROM health)
    SELECT user_id, drift, CASE WHEN drift >= 0.15 OR completeness < 0.97 OR error_rate >= 0.15 OR p95_ms >= 600 THEN 'reindex_embeddings' WHEN stuck > 0 OR pending >= 500 THEN 'refresh_embeddings'
      WHEN completeness < 0.995 OR avg_ms >= 250 THEN 'optimize' ELSE 'healthy' END AS decision FROM m""")  # fmt: skip
def _(t):
    u = F.col("user_id")
    rows = t.logs.groupBy("user_id").agg(
        (F.count("*") * 10).alias("graph_entities"), (F.count("*") * 10 - F.count_if(F.col("result_count") == 0) * F.first(u % 8)).alias("vector_entities"), F.first(1 - (u % 10) / 200.0).alias("completeness"), F.first(u % 600).alias("pending"),
        F.first(F.when(u % 13 == 0, 1).otherwise(0)).alias("stuck"), F.first(F.when(u % 17 == 0, 2).otherwise(0)).alias("dead"), M.share(F.col("source") == "error").alias("error_rate"), F.round(F.avg("latency") * 4, 3).alias("avg_ms"), (F.max("latency") * 1.5).alias("p95_ms"),
    )
    return M.infra_decision(rows).select("user_id", "drift", "decision")


@query("a33_fanout_pollution", "SELECT episode_id, sum(n) AS relations, max(n) AS top, sum(n) >= 4 AND max(n) / sum(n) > 0.6 AS polluted FROM (SELECT episode_id, CASE WHEN pos % 4 = 3 THEN tail ELSE 'S1' END AS tail, count(*) AS n FROM candidates GROUP BY 1, 2) GROUP BY 1")
def _(t):
    rows = t.candidates.select("episode_id", F.when(F.col("pos") % 4 == 3, F.col("tail")).otherwise("S1").alias("tail"))
    return M.fanout_pollution(rows, "episode_id")


@query("a34_confidence_range", "SELECT episode_id, min(score) AS low, max(score) AS high, round(avg(score), 6) AS mean FROM candidates GROUP BY 1")
def _(t):
    return M.confidence_range(t.candidates, "episode_id")


@query("a38_search_latency", f"SELECT user_id, count(*) AS n, count(*) FILTER (WHERE source = 'error') AS errors, round(avg(latency), 4) AS mean, {_PCT.format(p=95)} AS p95, arg_max(latency, (ts, id)) AS last FROM logs GROUP BY 1")
def _(t):
    base = t.logs.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "error").alias("errors"), F.round(F.avg("latency"), 4).alias("mean"), F.max_by("latency", F.struct("ts", "id")).alias("last"))
    return base.join(M.percentiles(t.logs, "latency", ["user_id"], (95,)), "user_id")


@query("h9_floor_percentile", f"SELECT day, {_PCT.format(p=90)} AS p90 FROM logs GROUP BY 1")
def _(t):
    found = M.percentiles(t.logs, "latency", ["day"], (90,)).withColumnRenamed("day", "of")
    return t.logs.select("day").distinct().join(found, F.col("day").eqNullSafe(F.col("of")), "left").drop("of")


@query("a39_hotspot_events", "SELECT src, dst, day FROM (SELECT head AS src, tail AS dst, day, row_number() OVER (PARTITION BY head, tail ORDER BY day, episode_id, pos) AS n FROM candidates) WHERE n = 3")
def _(t):
    return M.hotspot_events(t.candidates.select(F.col("head").alias("src"), F.col("tail").alias("dst"), "day", "episode_id", "pos")).select("src", "dst", "day")


@query("a40_combined_stats", "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM episodes) AS episodes, (SELECT string_agg(t || '=' || n, ';' ORDER BY t) FROM (SELECT entity_type AS t, count(*) AS n FROM entities GROUP BY 1)) AS types, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS queued")
def _(t):
    types = M.type_counts(t.entities, "entity_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    one = [t.entities.agg(F.count("*").alias("entities")), t.edges.agg(F.count("*").alias("edges")), t.episodes.agg(F.count("*").alias("episodes")), types.select(text.alias("types")), t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("queued"))]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(F.broadcast(x))
    return out


_GOLD = "gold AS (SELECT DISTINCT episode_id, head, label, tail FROM candidates WHERE score >= 0.3), predicted AS (SELECT DISTINCT episode_id, head, label, tail FROM candidates WHERE pos <> 2)"
_FLAGS = "flags AS (SELECT coalesce(g.label, p.label) AS label, g.label IS NOT NULL AS g, p.label IS NOT NULL AS p FROM gold g FULL JOIN predicted p ON g.episode_id = p.episode_id AND g.head = p.head AND g.label = p.label AND g.tail = p.tail)"


@query("j23_a24_u3_precision_recall", f"""
    WITH {_GOLD}, {_FLAGS}, sums AS (SELECT coalesce(label, '*') AS type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM flags GROUP BY ROLLUP (label))
    SELECT type, tp, fp, fn, round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1 FROM sums""")  # fmt: skip
def _(t):
    return M.precision_recall(t.candidates.where("score >= 0.3"), t.candidates.where("pos <> 2"), ["episode_id", "head", "label", "tail"], "label")


@query("a26_calibration", """
    SELECT bin, n, mean_confidence, accuracy, gap, CASE WHEN gap > 0.25 THEN 'high' WHEN gap > 0.15 THEN 'warn' ELSE 'none' END AS warning FROM (SELECT *, round(abs(mean_confidence - accuracy), 6) AS gap FROM (
      SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_confidence, round(avg(CASE WHEN pos % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM candidates GROUP BY 1))""")  # fmt: skip
def _(t):
    return M.calibration(t.candidates.select(F.col("score").alias("confidence"), (F.col("pos") % 2 == 0).alias("correct")))
