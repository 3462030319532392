"""Model tables of the graph made from the driver tables, in SQL that Spark and DuckDB both read.

Keys carry a letter for their kind: C customer (Person), S supplier (Organization), P part (Technology), N nation and
R region (Place), D document and T conversation turn (episodes), V vector.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions.places import written

DRIVER = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
AS_OF, LOG_DAY = "2002-01-01", "2024-01-30"

MODELS = {
    "trades": """
        SELECT o.o_custkey AS custkey, l.l_suppkey AS suppkey, l.l_partkey AS partkey, l.l_discount AS discount,
               l.l_quantity AS quantity, CAST(o.o_orderdate AS DATE) AS day, l.l_returnflag AS flag,
               l.l_orderkey AS orderkey, l.l_linenumber AS line, o.o_orderpriority AS priority
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "entities": """
        SELECT concat('C', c.c_custkey) AS id, c.c_name AS name, 'Person' AS entity_type,
               concat('Client ', c.c_custkey) AS alias, concat(c.c_mktsegment, ' account') AS description,
               0.5 + (c.c_custkey % 50) / 100.0E0 AS confidence, coalesce(o.n, 0) AS mention_count,
               o.first_day AS first_day, o.last_day AS last_day, c.c_custkey % 7 = 0 AS stale
        FROM {customer} c LEFT JOIN (
          SELECT o_custkey, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day,
                 max(CAST(o_orderdate AS DATE)) AS last_day FROM {orders} GROUP BY o_custkey) o
          ON c.c_custkey = o.o_custkey
        UNION ALL
        SELECT concat('S', s_suppkey), s_name, 'Organization', concat('Vendor ', s_suppkey), 'supplier of parts',
               0.6E0, 1, CAST('1992-01-01' AS DATE), CAST('1998-06-01' AS DATE), false FROM {supplier}
        UNION ALL
        SELECT concat('P', p_partkey), concat(p_name, ' ', p_partkey), 'Technology', concat('Part ', p_partkey), p_type,
               0.7E0, p_size, CAST('1993-01-01' AS DATE), CAST('1997-06-01' AS DATE), p_size > 40 FROM {part}
        UNION ALL
        SELECT concat('N', n_nationkey), n_name, 'Place', concat('Nation ', n_nationkey), 'country', 0.9E0, 3,
               CAST('1992-01-01' AS DATE), CAST('1998-01-01' AS DATE), false FROM {nation}
        UNION ALL
        SELECT concat('R', r_regionkey), r_name, 'Place', concat('Region ', r_regionkey), 'region', 0.9E0, 2,
               CAST('1992-01-01' AS DATE), CAST('1998-01-01' AS DATE), false FROM {region}""",
    "edges": """
        SELECT concat('C', custkey) AS src, 'CUSTOMER_OF' AS rel_type, concat('S', suppkey) AS dst,
               round(1 - avg(discount), 6) AS confidence, count(*) AS mention_count, min(day) AS valid_from,
               CASE WHEN suppkey % 3 = 0 THEN CAST(max(day) + INTERVAL 365 DAY AS DATE) END AS valid_to, max(day) AS last_day,
               CASE WHEN suppkey % 11 = 0 THEN 'quarantined' WHEN suppkey % 5 = 0 THEN 'verified' END AS audit_status
        FROM {trades} GROUP BY custkey, suppkey
        UNION ALL
        SELECT concat('C', custkey), 'USES', concat('P', partkey), round(1 - avg(discount), 6), count(*), min(day),
               CASE WHEN partkey % 3 = 0 THEN CAST(max(day) + INTERVAL 365 DAY AS DATE) END, max(day),
               CASE WHEN partkey % 11 = 0 THEN 'deleted' END
        FROM {trades} GROUP BY custkey, partkey
        UNION ALL
        SELECT concat('S', suppkey), 'CREATED', concat('P', partkey), round(1 - avg(discount), 6), count(*), min(day),
               CAST(NULL AS DATE), max(day), CAST(NULL AS STRING)
        FROM {trades} GROUP BY suppkey, partkey
        UNION ALL
        SELECT concat('C', c_custkey), 'LOCATED_IN', concat('N', c_nationkey), 0.9E0, 1, CAST('1992-01-01' AS DATE),
               CAST(NULL AS DATE), CAST('1998-01-01' AS DATE), 'verified' FROM {customer}
        UNION ALL
        SELECT concat('S', s_suppkey), 'LOCATED_IN', concat('N', s_nationkey), 0.9E0, 1, CAST('1992-01-01' AS DATE),
               CAST(NULL AS DATE), CAST('1998-01-01' AS DATE), 'verified' FROM {supplier}
        UNION ALL
        SELECT concat('N', n_nationkey), 'LOCATED_IN', concat('R', n_regionkey), 0.95E0, 1, CAST('1992-01-01' AS DATE),
               CAST(NULL AS DATE), CAST('1998-01-01' AS DATE), 'verified' FROM {nation}""",
    "mentions": """
        SELECT concat('O', o_orderkey) AS episode_id, concat('C', o_custkey) AS entity_id,
               CAST(o_orderdate AS DATE) AS day FROM {orders}""",
    "candidates": """
        SELECT concat('O', orderkey) AS episode_id, line AS pos, concat('C', custkey) AS head,
               concat('S', suppkey) AS tail, 'Person' AS head_type,
               CASE WHEN suppkey % 4 = 0 THEN 'Place' WHEN suppkey % 7 = 0 THEN 'Concept' ELSE 'Organization' END AS tail_type,
               CASE flag WHEN 'A' THEN 'customer of' WHEN 'N' THEN 'related to' ELSE ' works at' END AS label,
               round(discount * 10, 4) AS score,
               CASE priority WHEN '1-URGENT' THEN 'contacts_json' WHEN '2-HIGH' THEN 'email' WHEN '3-MEDIUM' THEN 'Session '
                             WHEN '5-LOW' THEN 'voice' ELSE 'fax' END AS source, day
        FROM {trades}""",
    "episodes": """
        SELECT concat('D', doc_id) AS id, text AS content, lang AS speaker, source,
               CAST('2024-01-02' AS DATE) AS day FROM {documents}
        UNION ALL
        SELECT concat('T', conv_id, '-', turn), text, role, 'conversation', CAST('2024-01-15' AS DATE) FROM {conversations}""",
    "logs": """
        SELECT event_id AS id, CAST(ts AS DATE) AS day, ts, user_id, event_type AS source, value AS latency,
               event_id % 7 AS result_count, event_id % 3 AS fallbacks, event_id % 5 AS relations
        FROM {events}""",
    "vectors": """
        SELECT vec_id, embedding, CASE WHEN label < 5 THEN 'Person' ELSE 'Organization' END AS entity_type FROM {embeddings}""",
    "verdicts": """
        SELECT doc_id AS id, concat('D', doc_id) AS episode_id,
               CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 0 THEN 'quarantine' WHEN doc_id % 6 = 0 THEN 'reclassify' ELSE 'verify' END AS verdict,
               CASE WHEN doc_id % 6 = 0 THEN 'KNOWS' END AS suggested_type, doc_id % 9 AS run
        FROM {labels}""",
}


def _named(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def write_models(spark: SparkSession, sf_dir: str) -> None:
    """Writes the model tables once, so that what reads them afterwards times its own work."""
    for name in MODELS:
        _WRITTEN[spark.sparkContext.applicationId, sf_dir, name] = written(load(spark, sf_dir, name), name)


#: Trades that a task groups at once.
DEALT = 1_000_000


def edges_of(trades: DataFrame, customer: DataFrame, supplier: DataFrame, nation: DataFrame, parts: int) -> DataFrame:
    """The rows of MODELS["edges"] with fewer shuffles.

    Nearly every trade is an edge of its own, so trades are dealt as they are, before any of them is grouped: once by
    customer, which serves both kinds of a customer's edges, and once by supplier and part.
    """
    columns = ["src", "rel_type", "dst", "confidence", "mention_count", "valid_from", "valid_to", "last_day", "audit_status"]
    key = lambda letter, c: F.concat(F.lit(letter), c)
    merged = (F.round(1 - F.avg("discount"), 6).alias("confidence"), F.count("*").alias("mention_count"), F.min("day").alias("valid_from"), F.max("day").alias("last_day"))
    uses = F.col("rel_type") == "USES"
    sold = F.struct(F.lit("CUSTOMER_OF").alias("rel_type"), F.col("suppkey").alias("other"))
    used = F.struct(F.lit("USES").alias("rel_type"), F.col("partkey").alias("other"))
    of_customer = trades.select("custkey", "suppkey", "partkey", "discount", "day").repartition(parts, "custkey")
    of_customer = of_customer.select("custkey", "discount", "day", F.explode(F.array(sold, used)).alias("e")).groupBy("custkey", "e.rel_type", "e.other").agg(*merged)
    until = F.when(F.col("other") % 3 == 0, F.date_add("last_day", 365))
    status = F.when(uses & (F.col("other") % 11 == 0), "deleted").when(~uses & (F.col("other") % 11 == 0), "quarantined").when(~uses & (F.col("other") % 5 == 0), "verified")
    of_customer = of_customer.select(key("C", "custkey").alias("src"), "rel_type", F.when(uses, key("P", "other")).otherwise(key("S", "other")).alias("dst"), "confidence", "mention_count", "valid_from", until.alias("valid_to"), "last_day", status.alias("audit_status"))
    created = trades.select("suppkey", "partkey", "discount", "day").repartition(parts, "suppkey", "partkey").groupBy("suppkey", "partkey").agg(*merged)
    created = created.select(key("S", "suppkey").alias("src"), F.lit("CREATED").alias("rel_type"), key("P", "partkey").alias("dst"), "confidence", "mention_count", "valid_from", F.lit(None).cast("date").alias("valid_to"), "last_day", F.lit(None).cast("string").alias("audit_status"))

    def located(rows: DataFrame, src: Column, dst: Column, confidence: float) -> DataFrame:
        date = lambda day: F.lit(day).cast("date")
        return rows.select(src.alias("src"), F.lit("LOCATED_IN").alias("rel_type"), dst.alias("dst"), F.lit(confidence).alias("confidence"), F.lit(1).cast("long").alias("mention_count"), date("1992-01-01").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), date("1998-01-01").alias("last_day"), F.lit("verified").alias("audit_status"))

    places = located(customer, key("C", "c_custkey"), key("N", "c_nationkey"), 0.9).union(located(supplier, key("S", "s_suppkey"), key("N", "s_nationkey"), 0.9))
    places = places.union(located(nation, key("N", "n_nationkey"), key("R", "n_regionkey"), 0.95))
    return of_customer.select(columns).union(created.select(columns)).union(places.select(columns))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a model table as a view over driver tables: nothing is read until it is used."""
    stored = _WRITTEN.get((spark.sparkContext.applicationId, sf_dir, name))
    if stored is not None:
        return stored
    if name in DRIVER:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "edges":
        # a count of rows that the files' footers give; as many tasks as the session deals to, if not more
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-load(spark, sf_dir, "lineitem").count() // DEALT))
        return edges_of(*(load(spark, sf_dir, n) for n in ("trades", "customer", "supplier", "nation")), parts)
    text = MODELS[name]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in dict.fromkeys(_named(text))})


def with_models(sql: str) -> str:
    """SQL with the model tables that it names as common table expressions, for DuckDB."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in MODELS and name not in needed:
            for n in _named(MODELS[name]):
                visit(n)
            needed.append(name)

    for name in MODELS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    text = {n: re.sub(r"\{(\w+)\}", r"\1", MODELS[n]) for n in needed}
    head = ", ".join(f"{n} AS ({text[n]})" for n in needed)
    sql = sql.strip()
    if not head:
        return sql
    if re.match(r"(?i)with\s", sql):
        return f"WITH {head}, {sql[4:].lstrip()}"
    return f"WITH {head} {sql}"
