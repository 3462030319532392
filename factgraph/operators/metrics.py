"""Measures over the graph and its logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import vocabulary as V
from factgraph.functions.places import numbered


def share(part: Column, digits: int = 4) -> Column:
    """Rounded share of rows for which part holds; 0 for no rows."""
    return F.round(F.coalesce(F.count_if(part) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), digits)


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every entity, 0 included. Each edge is pre-aggregated at either end before the shuffle."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    return entities.join(ends, "id", "left").fillna({"degree": 0})


def dashboard(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, edges, edges by entity, relation types, share of RELATED_TO."""
    e = entities.agg(F.count("*").alias("entities"))
    r = edges.agg(F.count("*").alias("edges"), F.countDistinct("rel_type").alias("rel_types"), share(F.col("rel_type") == "RELATED_TO").alias("generic_share"))
    return e.crossJoin(F.broadcast(r)).withColumn("density", F.round(F.col("edges") / F.greatest("entities", F.lit(1)), 4))


def audit_coverage(edges: DataFrame) -> DataFrame:
    status = F.coalesce("audit_status", F.lit(""))
    return edges.agg(F.count("*").alias("total"), F.count_if(status == "").alias("unaudited"), F.count_if(status.isin("quarantined", "deleted")).alias("flagged"), F.round(100.0 * F.count_if(status != "") / F.count("*"), 2).alias("audited_pct"))


def source_yield(logs: DataFrame) -> DataFrame:
    """By source (entities, uniques, relations, day): counts, means, quality = unique / total * (1 + 0.1 * mean relations), ranks from both ends."""
    quality = F.coalesce(F.sum("uniques") / F.nullif(F.sum("entities"), F.lit(0)), F.lit(0.0)) * (1 + 0.1 * F.avg("relations"))
    by = logs.groupBy("source").agg(
        F.count("*").alias("runs"), F.round(F.avg("entities"), 4).alias("avg_entities"), F.round(F.avg("relations"), 4).alias("avg_relations"),
        F.sum("entities").alias("total_entities"), F.sum("uniques").alias("total_uniques"), F.round(quality, 6).alias("quality"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    one = Window.partitionBy(F.lit(1))  # a row for each source: a small table
    return by.withColumn("from_top", F.row_number().over(one.orderBy(F.desc("quality"), "source"))).withColumn("from_bottom", F.row_number().over(one.orderBy("quality", F.desc("source"))))


def percentiles(rows: DataFrame, value: str, by: list[str], points: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Exact floor-index percentiles of large groups: equal values are counted, the counts fall into about a hundred
    cells by bounds of a mergeable sketch, and only the cells that hold a wanted rank are sorted. No group is gathered
    or sorted in one task."""
    key = F.struct(*(F.col(c) for c in by))
    counts = rows.where(F.col(value).isNotNull()).groupBy(key.alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("m"))
    sketch = rows.where(F.col(value).isNotNull()).groupBy(key.alias("of")).agg(F.percentile_approx(value, F.array(*(F.lit(i / 100) for i in range(1, 100))), F.lit(1000)).alias("bounds"))
    cell = F.size(F.filter("bounds", lambda x: x < F.col("value")))
    dealt = counts.join(sketch.hint("merge"), F.col("key").eqNullSafe(F.col("of"))).select("key", "value", "m", cell.alias("cell"))
    sizes = dealt.groupBy("key", "cell").agg(F.sum("m").alias("size"))  # at most a hundred rows a group
    w = Window.partitionBy("key")
    up_to = F.sum("size").over(w.orderBy("cell"))
    offsets = sizes.select("key", "cell", (up_to - F.col("size")).alias("before"), up_to.alias("after"), F.sum("size").over(w).alias("n"))
    at = lambda p: F.least(F.floor(F.col("n") * p / 100.0), F.col("n") - 1)
    holds = lambda p: (F.col("before") <= at(p)) & (at(p) < F.col("after"))
    wanted = offsets.where(reduce(lambda x, y: x | y, map(holds, points))).select(F.col("key").alias("of"), F.col("cell").alias("in"), "before", "n")
    near = dealt.join(wanted.hint("merge"), F.col("key").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("in")))
    end = F.col("before") + F.sum("m").over(Window.partitionBy("key", "cell").orderBy("value"))
    ranked = near.withColumn("end", end)
    hit = lambda p: (F.col("end") - F.col("m") <= at(p)) & (at(p) < F.col("end"))
    found = ranked.groupBy("key").agg(*(F.max(F.when(hit(p), F.col("value"))).alias(f"p{p}") for p in points))
    return found.select(*(F.col("key")[c].alias(c) for c in by), *(f"p{p}" for p in points))


def retrieval_summary(logs: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and percentiles of latency, hit rate and mean results for each group."""
    base = logs.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("latency"), 4).alias("avg_latency"), share(F.col("result_count") > 0).alias("hit_rate"), F.round(F.avg("result_count"), 4).alias("avg_results"))
    return base.join(percentiles(logs, "latency", by), by)


def weekly_trend(logs: DataFrame) -> DataFrame:
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "ts"), F.weekofyear("ts"))
    return logs.groupBy(week.alias("week")).agg(F.count("*").alias("n"), F.round(F.avg("latency"), 4).alias("avg_latency"), share(F.col("result_count") > 0).alias("connected_share"))


def daily_growth(logs: DataFrame) -> DataFrame:
    """Daily requests, errors and growth over the day before."""
    days = logs.groupBy("day").agg(F.count("*").alias("requests"), F.count_if(F.col("source") == "error").alias("errors"), F.round(F.sum("fallbacks") / F.greatest(F.sum("relations"), F.lit(1)), 4).alias("fallback_rate"))
    return days.withColumn("growth", F.col("requests") - F.lag("requests", 1, 0).over(Window.partitionBy(F.lit(1)).orderBy("day")))


def drift(daily: DataFrame) -> DataFrame:
    """Per day (day, types): new types against the day before, change in per cent and alarm above 5 or 10 per cent."""
    before = F.lag("types").over(Window.partitionBy(F.lit(1)).orderBy("day"))
    change = F.when(before.isNull() | (F.size(before) == 0), 0.0).otherwise((F.size("types") - F.size(before)) * 100.0 / F.size(before))
    new = F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except("types", before)))
    seen = daily.withColumn("change", F.round(change, 4)).withColumn("new_types", new)
    return seen.withColumn("alarm", F.when(F.abs("change") > 10, "high").when(F.abs("change") > 5, "warn").otherwise("none"))


def rolling_health(jobs: DataFrame, size: int, every: int = 1, block: int = 100_000, order: list[str] | None = None) -> DataFrame:
    """Fallback rate over the last size jobs of each baseline epoch, at every n-th job; the order (ts, id) must have no ties.

    An epoch of any length is cut into blocks of jobs by their numbers; a block begins with the last size - 1 jobs of
    the one before, so every frame is whole and no task holds an epoch.
    """
    rows = numbered(jobs, ["epoch"], [F.asc(c) for c in order or ("ts", "id")])
    own = F.floor((F.col("rn") - 1) / block)
    reach = F.floor((F.col("rn") + size - 2) / block)  # the last block whose frames hold this job
    rows = rows.withColumn("own", own).withColumn("block", F.explode(F.sequence(own, reach)))
    w = Window.partitionBy("epoch", "block").orderBy("rn")
    frame = w.rowsBetween(-(size - 1), 0)
    rate = F.sum("fallbacks").over(frame) / F.greatest(F.sum("relations").over(frame), F.lit(1))
    seen = rows.withColumn("rows", F.count("*").over(frame)).withColumn("rate", F.round(rate, 6))
    return seen.where((F.col("own") == F.col("block")) & (F.col("rn") % every == 0)).drop("own", "block")


def spikes(health: DataFrame, baseline: float, factor: float = 2.0) -> DataFrame:
    return health.withColumn("spike", F.col("rate") / F.greatest(F.lit(baseline), F.lit(0.01)) > factor)


def degraded(health: DataFrame, baseline: float, size: int, margin: float = 0.15) -> DataFrame:
    """Only full frames count."""
    return health.withColumn("degraded", (F.col("rows") == size) & (F.col("rate") > round(baseline + margin, 9)))


def infra_decision(metrics: DataFrame, allow_rebuild: bool = False) -> DataFrame:
    """Decision and reasons for rows of health metrics, by an ordered cascade of rules."""
    drift_ = F.when(F.col("graph_entities") <= 0, 0.0).otherwise(F.abs(F.col("graph_entities") - F.col("vector_entities")) / F.col("graph_entities"))
    m = metrics.withColumn("drift", F.round(drift_, 6))
    c = F.col
    h = V.HEALTH
    rebuild = F.lit(allow_rebuild) & ((c("drift") >= h["drift_rebuild"]) | (c("error_rate") >= h["errors_rebuild"]) | ((c("vector_entities") == 0) & (c("graph_entities") > 500) & (c("error_rate") > 0.2)))
    reindex = (c("drift") >= h["drift_reindex"]) | (c("completeness") < h["complete_reindex"]) | (c("error_rate") >= h["errors_reindex"]) | (c("p95_ms") >= h["p95_reindex"])
    refresh = (c("stuck") > 0) | (c("pending") >= h["backlog"])
    optimize = (c("completeness") < h["complete_optimize"]) | (c("avg_ms") >= h["avg_optimize"])
    decision = F.when(rebuild, "rebuild_vectors").when(reindex, "reindex_embeddings").when(refresh, "refresh_embeddings").when(optimize, "optimize").otherwise("healthy")
    dead = F.when(c("dead") > 0, F.lit("queue_dead"))
    of = lambda name, rule: F.when(rule, F.lit(name))
    why = (
        F.when(rebuild, F.array(of("entity_coverage_drift", c("drift") >= h["drift_rebuild"]), of("similarity_error_rate", c("error_rate") >= h["errors_rebuild"])))
        .when(reindex, F.array(of("entity_coverage_drift", c("drift") >= h["drift_reindex"]), of("index_completeness", c("completeness") < h["complete_reindex"]), of("similarity_error_rate", c("error_rate") >= h["errors_reindex"]), of("similarity_p95_ms", c("p95_ms") >= h["p95_reindex"])))
        .when(refresh, F.array(of("queue_stuck", c("stuck") > 0), of("queue_pending", c("pending") >= h["backlog"])))
        .when(optimize, F.array(of("index_completeness", c("completeness") < h["complete_optimize"]), of("similarity_avg_ms", c("avg_ms") >= h["avg_optimize"])))
        .otherwise(F.array(F.lit("no_thresholds_triggered")))
    )
    reasons = F.when(decision == "healthy", F.array(F.lit("no_thresholds_triggered"))).otherwise(F.array_compact(F.concat(F.array(dead), why)))
    return m.withColumn("decision", decision).withColumn("reasons", reasons)


def fanout_pollution(relations: DataFrame, by: str, threshold: float = 0.6, least: int = 4) -> DataFrame:
    """Batches of at least four relations in which one tail has over the threshold of them."""
    tails = relations.groupBy(by, C.normal_name(F.col("tail")).alias("t")).agg(F.count("*").alias("n"))
    grouped = tails.groupBy(by).agg(F.sum("n").alias("relations"), F.max("n").alias("top"))
    return grouped.withColumn("polluted", (F.col("relations") >= least) & (F.col("top") / F.col("relations") > threshold))


def hotspot_events(mentions: DataFrame, at: int = 3) -> DataFrame:
    """One event when a pair reaches its third mention."""
    w = Window.partitionBy("src", "dst").orderBy("day", "episode_id", "pos")
    return mentions.withColumn("n", F.row_number().over(w)).where(F.col("n") == at)


def adoption(daily: DataFrame, as_of: Column) -> DataFrame:
    """Per key (kind, value, day, n): distinct days, total, span and frequency as of a day."""
    grouped = daily.where(F.col("day") <= as_of).groupBy("kind", "value").agg(F.countDistinct("day").alias("days"), F.sum("n").alias("total"), F.min("day").alias("first_day"))
    return grouped.withColumn("frequency", F.round(F.col("days") / (F.datediff(as_of, F.col("first_day")) + 1), 6))


def adopt(history: DataFrame, relations: int = 3, entities: int = 2, total: int = 20) -> DataFrame:
    """Keys that pass the gates: the first by total of each kind up to its cap, all within the total cap (relations first)."""
    passed = history.where("days >= 3 and total >= 5 and frequency >= 0.4")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("total"), "value"))
    ranked = passed.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("kind") == "relation", relations).otherwise(entities))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("kind"), "rank"))  # at most a few rows are left
    return ranked.withColumn("place", order).where(F.col("place") <= total)


def precision_recall(gold: DataFrame, predicted: DataFrame, key: list[str], by: str) -> DataFrame:
    """Per type and over all (``*``): true and false positives, misses, precision, recall, F1."""
    g, p = gold.select(*key).distinct().withColumn("g", F.lit(1)), predicted.select(*key).distinct().withColumn("p", F.lit(1))
    flags = g.join(p, key, "full").select(by, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    sums = flags.rollup(by).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return sums.select(F.coalesce(by, F.lit("*")).alias("type"), "tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of (confidence, correct): mean confidence, accuracy, gap, share of rows (gap times share sums to the error)."""
    bin_no = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    by = rows.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))
    gap = F.round(F.abs(F.col("mean_confidence") - F.col("accuracy")), 6)
    return by.withColumn("gap", gap).withColumn("warning", F.when(gap > 0.25, "high").when(gap > 0.15, "warn").otherwise("none"))


def confidence_range(relations: DataFrame, by: str, score: str = "score") -> DataFrame:
    """(by, low, high, mean) of the scores of each job."""
    return relations.groupBy(by).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.round(F.avg(score), 6).alias("mean"))


def latest_runs(runs: DataFrame, order: list[str], limit: int = 50, report: str = "props") -> DataFrame:
    """The newest runs with the status that their report (JSON) gives, under the first of the names status, state and k: a top-k report."""
    status = F.coalesce(*(F.get_json_object(report, f"$.{name}") for name in ("status", "state", "k")))
    return runs.orderBy(*map(F.desc, order)).limit(limit).withColumn("status", status)


def recent(log: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The newest rows of a log: a top-k report."""
    return log.orderBy(*map(F.desc, order)).limit(limit)
