"""Retrieval for tables of questions: dense, keyword and hybrid search, merging and graph-aware ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.functions import columns as C
from factgraph.functions import vocabulary as V
from factgraph.functions.places import written
from factgraph.functions.sizes import containing, small
from factgraph.operators import traverse


def _top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


#: Questions and vectors of a tile: a task compares one tile of each by matrix products of ``CHUNK`` rows.
QUERY_BLOCK, VECTOR_BLOCK, CHUNK = 1000, 20_000, 2048
_SCORED = "query_id long, vec_id long, distance double"


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of vectors from vectors, row by row, in double precision, to the 12 decimals that no order of summing changes."""
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = np.maximum(0, 1 - (x * q).sum(axis=1) / np.sqrt((x**2).sum(axis=1) * (q**2).sum(axis=1))) if metric == "cosine" else np.sqrt(((x - q) ** 2).sum(axis=1))
    return np.round(exact, 12)


def _nearest(vec_ids: np.ndarray, x: np.ndarray, kind: np.ndarray, ids: np.ndarray, q: np.ndarray, wanted: list[str | None], k: int, metric: str) -> pa.RecordBatch:
    """(query_id, vec_id, distance): the best k of these vectors for each question by distance, then by id.

    A matrix product finds those that may be among them, within its own rounding; they are measured exactly.
    """
    own, typed = (q**2).sum(axis=1), np.array([w is not None for w in wanted])
    want, parts = np.array([w or "" for w in wanted], object), []
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        squares = (part**2).sum(axis=1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            rough = 1 - part @ q.T / np.sqrt(squares * own) if metric == "cosine" else squares + own - 2 * (part @ q.T)
        slack = 1e-11 * (np.ones_like(squares) if metric == "cosine" else squares + own)
        slack[~np.isfinite(slack)] = 0
        rough[~np.isfinite(rough) | (typed & (kind[at : at + CHUNK, None] != want))] = np.inf
        kth = np.partition(rough, k - 1, axis=0)[k - 1] if len(part) > k else np.full(len(ids), np.inf)
        row, column = np.nonzero((rough - slack <= (kth + np.max(slack, axis=0))) & np.isfinite(rough))
        parts.append((row + at, column))
    row, column = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int))
    distance = np.concatenate([_distances(x[row[i : i + 65536]], q[column[i : i + 65536]], metric) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    order = np.lexsort((vec_ids[row], distance, column))
    row, column, distance = row[order], column[order], distance[order]
    place = np.arange(len(column)) - np.searchsorted(column, column)
    kept = (place < k) & np.isfinite(distance)
    return pa.RecordBatch.from_arrays([pa.array(ids[column[kept]], pa.int64()), pa.array(vec_ids[row[kept]], pa.int64()), pa.array(distance[kept], pa.float64())], ["query_id", "vec_id", "distance"])


def _matrix(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = rows.column(name)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, np.float64).reshape(rows.num_rows, -1)


def _against(block: pa.Table, k: int, metric: str):
    """Best k of each Arrow batch of vectors for one tile of questions."""
    ids, q, wanted = np.asarray(block.column("query_id")), _matrix(block, "q"), block.column("want_type").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kind = np.array(batch.column("entity_type").to_pylist(), object)
                yield _nearest(np.asarray(batch.column("vec_id")), _matrix(batch, "embedding"), kind, ids, q, wanted, k, metric)

    return run


def _tiles(k: int, metric: str):
    """Best k of a tile of vectors for a tile of questions."""

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        if not vectors.num_rows or not questions.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        kind = np.array(vectors.column("entity_type").to_pylist(), object)
        return pa.Table.from_batches([_nearest(np.asarray(vectors.column("vec_id")), _matrix(vectors, "embedding"), kind, np.asarray(questions.column("query_id")), _matrix(questions, "q"), questions.column("want_type").to_pylist(), k, metric)])

    return run


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank) of queries (query_id, q[, want_type]): exp(-distance), the type filter before the cut.

    Ranked by unrounded distance, then by id; the score is rounded on output only. Up to ``query_block`` questions (the
    bound is proven by a count) go to the tasks as they are, and each batch of vectors passes on its best k. More are
    dealt into tiles, vectors too, and each pair of tiles is one group of one plan: the driver holds no questions, and
    a task holds one tile of each. All vectors have one length; rows without a vector or at no finite distance are no
    results.
    """
    kind = F.col("entity_type") if "entity_type" in vectors.columns else F.lit(None).cast("string")
    want = F.col("want_type") if "want_type" in queries.columns else F.lit(None).cast("string")
    rows = vectors.where("embedding is not null and not exists(embedding, x -> x is null)").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), kind.alias("entity_type"))
    asked = queries.where("q is not null").select(F.col("query_id").cast("long"), F.col("q").cast("array<double>"), want.alias("want_type"))
    if asked.limit(query_block + 1).count() <= query_block:
        block = asked.toArrow()
        scored = rows.mapInArrow(_against(block, k, metric), _SCORED) if block.num_rows else vectors.sparkSession.createDataFrame([], _SCORED)
    else:
        asked = written(asked, "questions")
        n_asked, n_rows = -(-asked.count() // query_block), max(1, -(-rows.count() // vector_block))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.withColumn("row", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int")).withColumn("column", spread(n_asked))
        right = asked.withColumn("column", F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int")).withColumn("row", spread(n_rows))
        scored = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(_tiles(k, metric), _SCORED)
    best = _top(scored, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k)
    return best.select("query_id", "vec_id", F.round(F.exp(-F.col("distance")), 6).alias("score"), "rank")


def keyword_search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank) of rows (id, name, content): 1.0 for the exact name, 0.9 in the name, 0.7 in the content."""
    q = F.lower("q")
    score = F.when(F.lower("name") == q, 1.0).when(F.lower("name").contains(q), 0.9).when(F.lower("content").contains(q), 0.7)
    hits = containing(rows, [F.col("name"), F.col("content")], queries, F.col("q"), "query_id")
    return _top(hits.select("query_id", "id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], k)


#: Share of the documents that a term may be in before its postings are read for candidates only.
FREQUENT = 0.1


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, frequent: float = FREQUENT) -> DataFrame:
    """(query_id, id, score, rank) of docs (id, content) for query terms, in two phases; the result is that of one.

    Terms in few documents are joined first. The kth best of what they give, made whole by the frequent terms of these
    few documents, bounds what a result needs; what the frequent terms of a question can add at most is known from
    their greatest weights. Frequent postings are then joined for documents alone that may still reach that bound. A
    question whose frequent terms alone could reach it takes the documents of those terms, as nothing else would be exact.
    A null content is an empty document.
    """
    tokens = docs.select("id", C.hash_tokens(F.coalesce("content", F.lit(""))).alias("ts"))
    tokens = written(tokens.select("id", F.size("ts").alias("len"), "ts"), "tokens")
    average = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    terms = written(queries.select("query_id", F.explode(F.array_distinct(C.hash_tokens(F.col("q")))).alias("term")), "terms")
    wanted = terms.select("term").distinct()
    counted = tokens.select("id", "len", F.explode("ts").alias("term")).join(small(wanted), "term").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    counted = written(counted, "counted")
    spread = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighed = counted.join(small(spread), "term").crossJoin(F.broadcast(average))
    weighed = written(weighed.select("id", "term", weight.alias("w"), (F.col("df") > frequent * F.col("n")).alias("often")), "postings")
    rare, often = weighed.where("not often").drop("often"), weighed.where("often").drop("often")
    most = written(often.groupBy("term").agg(F.max("w").alias("most")), "most")
    asked = written(terms.join(small(most), "term"), "frequent_terms")
    bound = asked.groupBy("query_id").agg(F.sum("most").alias("more"))
    first = written(rare.join(small(terms), "term").groupBy("query_id", "id").agg(F.sum("w").alias("part")), "partial")

    def whole(pairs: DataFrame) -> DataFrame:
        """(query_id, id, score) of pairs with a partial score: with the weights of the frequent terms that both have."""
        kept = pairs.select("query_id", "id").join(asked.select("query_id", "term").hint("merge"), "query_id")
        extra = kept.join(often.hint("merge"), ["id", "term"]).groupBy("query_id", "id").agg(F.sum("w").alias("extra"))
        return pairs.join(extra.hint("merge"), ["query_id", "id"], "left").select("query_id", "id", (F.col("part") + F.coalesce("extra", F.lit(0.0))).alias("score"))

    leaders = whole(_top(first, ["query_id"], [F.desc("part"), F.asc("id")], k).drop("rank"))
    need = leaders.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("need"))
    limits = terms.select("query_id").distinct().join(need.hint("merge"), "query_id", "left").join(bound.hint("merge"), "query_id", "left")
    limits = written(limits.select("query_id", F.coalesce("need", F.lit(0.0)).alias("need"), F.coalesce("more", F.lit(0.0)).alias("more")), "limits")
    open_ones = limits.where("more > 0 and more >= need - 0.00001").select("query_id")
    may = first.join(limits.hint("merge"), "query_id").where("part + more >= need - 0.00001").select("query_id", "id", "part")
    # questions that their frequent terms alone could answer: every document of these terms is a candidate
    others = asked.join(open_ones.hint("merge"), "query_id", "left_semi").select("query_id", "term").join(often.hint("merge"), "term").select("query_id", "id").distinct()
    others = others.join(may.select("query_id", "id").hint("merge"), ["query_id", "id"], "left_anti").withColumn("part", F.lit(0.0))
    scored = whole(written(may.unionByName(others), "candidates"))
    return _top(scored.select("query_id", "id", F.round("score", 6).alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], k)


def fuse(dense: DataFrame, keyword: DataFrame, k: int = 10, weight: float = 0.7) -> DataFrame:
    """(query_id, id, score, rank): weighted sum of both scores, a missing one counts as 0."""
    both = dense.select("query_id", "id", F.col("score").alias("d")).join(keyword.select("query_id", "id", F.col("score").alias("s")), ["query_id", "id"], "full")
    total = F.round(weight * F.coalesce("d", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0)), 8)
    return _top(both.select("query_id", "id", total.alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], k)


def question_names(questions: DataFrame) -> DataFrame:
    """(query_id, pos, name): title- or upper-case words of over two letters, else words of four letters or more; ordered distinct."""
    words = F.regexp_extract_all("q", F.lit(r"[\p{L}0-9_'-]+"), F.lit(0))
    named = F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^(?:\p{Lu}[\p{Ll}0-9'-]*|[\p{Lu}0-9]*\p{Lu}[\p{Lu}0-9]*)$"))
    plain = F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{L}+$"))
    chosen = C.distinct_ignoring_case(F.when(F.size(named) > 0, named).otherwise(plain))
    return questions.select("query_id", F.posexplode(chosen).alias("pos", "name"))


def exact_else_contains(names: DataFrame, keys: DataFrame, entities: DataFrame, first: int = 5) -> DataFrame:
    """(query_id, id, source): entities named exactly; for questions with none, those whose name contains the earliest name that hits."""
    names = names.where(F.col("pos") < first)
    exact = names.join(keys.hint("merge"), C.normal_name(F.col("name")) == F.col("key")).select("query_id", "id", F.lit("graph_exact").alias("source"))
    answered = exact.select("query_id").distinct()
    named = entities.select("id", F.col("name").alias("entity"))
    rest = written(names.join(answered.hint("merge"), "query_id", "left_anti"), "names")
    loose = containing(named, [F.col("entity")], rest, F.col("name"), "query_id")
    kept = loose.withColumn("least", F.min("pos").over(Window.partitionBy("query_id"))).where("pos = least")
    return exact.union(kept.select("query_id", "id", F.lit("graph_fuzzy"))).distinct()


def merge_results(graph: DataFrame, vector: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, entity, score, source, rank) of results (query_id, entity, score): one row an entity (case ignored), the greater score, ``combined`` if both found it."""
    both = graph.withColumn("side", F.lit("graph")).unionByName(vector.withColumn("side", F.lit("vector")))
    grouped = both.groupBy("query_id", F.lower("entity").alias("key")).agg(F.max("score").alias("score"), F.min_by("entity", F.struct("side", "entity")).alias("entity"), F.min("side").alias("a"), F.max("side").alias("z"))
    source = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise("combined")
    return _top(grouped.select("query_id", "entity", "score", source.alias("source")), ["query_id"], [F.desc("score"), F.asc("entity")], limit)


def intent_words(question: Column) -> Column:
    """Words and bigrams of a question in lower case."""
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z]+"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.filter(pairs, lambda p: p.contains(" ")))


def intent_boost(rel_types: Column, words: Column) -> Column:
    """0.05 for each distinct relation type with a keyword among the words, 0.10 at most."""
    table = F.create_map(*(x for k, v in V.INTENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    hits = F.filter(F.array_distinct(rel_types), lambda r: F.coalesce(F.arrays_overlap(F.try_element_at(table, r), words), F.lit(False)))
    return F.least(F.lit(V.INTENT_CAP), F.size(hits) * V.INTENT_BOOST)


def rerank(results: DataFrame) -> DataFrame:
    """results (query_id, entity, score, neighbors, avg_strength, hops, rel_types, q) ranked by graph-aware scores.

    A name is in the question if the whole of it or a word of over two letters is.

    score * (1 + 0.1 ln(1 + neighbors) + 0.2 strength) + path (0.30 at one hop, 0.15 at two) + intent + 1.5 for a name in the question.
    """
    around = 1 + F.log(1.0 + F.col("neighbors")) * V.NEIGHBOR_WEIGHT + F.col("avg_strength") * V.STRENGTH_WEIGHT
    path = F.when(F.col("hops").between(1, 2), (3 - F.col("hops")) * V.PATH_WEIGHT).otherwise(0.0)
    asked = F.lower("q")
    part = F.exists(F.split(F.lower("entity"), r"\s+"), lambda w: (F.length(w) > 2) & asked.contains(w))
    named = F.when(asked.contains(F.lower("entity")) | part, V.NAME_BOOST).otherwise(0.0)
    total = F.round(F.col("score") * around + path + intent_boost(F.col("rel_types"), intent_words(F.col("q"))) + named, 6)
    ranked = results.withColumn("final", total)
    return _top(ranked, ["query_id"], [F.desc("final"), F.asc("entity")], 1 << 30)


def graph_rerank(results: DataFrame, questions: DataFrame, entities: DataFrame, edges: DataFrame, anchors: int = 3) -> DataFrame:
    """results (query_id, entity, score) of questions (query_id, q), ranked with what the graph says of each entity.

    Neighbours, mean strength and relation types come from the edges of result entities alone; hops are the fewest,
    up to two, from an entity that the question's first names stand for. Results may bring the id of their entity and
    the relation types of their facts.
    """
    results = written(results, "results")
    rows = results.join(questions.hint("merge"), "query_id")
    if "id" not in results.columns:
        ids = entities.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
        rows = rows.join(ids.hint("merge"), F.lower("entity") == F.col("key"), "left").drop("key")
    rows = written(rows, "results")
    wanted = written(rows.where("id is not null").select("id").distinct(), "ids")
    near = traverse.both_ways(edges).join(small(wanted), "id", "left_semi")  # few entities go to the edges, which need not move
    around = near.groupBy("id").agg(F.countDistinct("other").alias("neighbors"), F.round(F.avg("strength"), 6).alias("avg_strength"), F.collect_set("rel_type").alias("rel_types"))
    if "rel_types" in rows.columns:
        around = around.drop("rel_types")
    first = question_names(questions).where(F.col("pos") < anchors)
    anchor = first.join(traverse.names_of(entities).hint("merge"), C.normal_name(F.col("name")) == F.col("key")).select("query_id", F.col("id").alias("a")).distinct()
    pairs = written(rows.where("id is not null").select("query_id", F.col("id").alias("b")).join(anchor.hint("merge"), "query_id").where("a <> b"), "pairs")
    apart = pairs.join(traverse.path_lengths(edges, pairs.select("a", "b").distinct(), 2).hint("merge"), ["a", "b"]).groupBy("query_id", F.col("b").alias("id")).agg(F.min("hops").alias("hops"))
    ready = rows.join(around.hint("merge"), "id", "left").join(apart.hint("merge"), ["query_id", "id"], "left")
    ready = ready.fillna({"neighbors": 0, "avg_strength": 0.0}).withColumn("rel_types", F.coalesce("rel_types", F.array().cast("array<string>")))
    return rerank(ready)


def rank_lift(results: DataFrame) -> DataFrame:
    """One row: mean change of rank by re-ranking (before, after orders) and share of questions with a new first result."""
    moved = results.withColumn("old", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")))
    each = moved.groupBy("query_id").agg(F.avg(F.col("old") - F.col("rank")).alias("change"), F.max((F.col("rank") == 1) & (F.col("old") != 1)).alias("lifted"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("change"), 3).alias("rank_improvement_avg"), F.round(100.0 * F.count_if("lifted") / F.count("*"), 1).alias("rerank_lift_pct"))


#: Tokens that are hashed at once.
TOKENS = 65_536


#: Decimals of an embedding's components.
PLACES = 6


def _rounded(x: np.ndarray) -> np.ndarray:
    """x to PLACES decimals as Spark's round gives them: half up by the shortest decimal of each number; what lies near a half is rounded as that decimal."""
    scaled = np.abs(x) * 10**PLACES
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(PLACES).to_integral_value(ROUND_HALF_UP))
    return np.where(whole == 0, 0.0, np.copysign(whole, x)) / 10**PLACES


def _token_vectors(dim: int):
    """Sum of the signs at each place for each row (id, tokens), scaled to length 1 and rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(1).value_lengths()))
            at = 0
            while at < batch.num_rows:  # rows of about TOKENS tokens, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
                rows = batch.slice(at, to - at)
                n, tokens = np.asarray(rows.column(1).value_lengths()), rows.column(1).flatten().to_pylist()
                words = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in tokens), "<u4")
                place = np.repeat(np.arange(len(n)) * dim, n * 8) + words % dim
                sums = np.bincount(place, weights=np.where(words & 1, -1.0, 1.0), minlength=len(n) * dim).reshape(-1, dim)
                size = np.maximum(np.sqrt((sums * sums).sum(axis=1)), 1e-12)  # sums are whole numbers: no order of adding matters
                scaled = _rounded((sums / size[:, None]).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * dim, pa.int32()), pa.array(scaled))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["id", "embedding"])
                at = to

    return run


def hash_embedding(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(id, embedding) of (id, text): each token's SHA-256 gives eight places and signs, summed and scaled to length 1.

    Places are little-endian words modulo the size, the sign is the parity of the digest's first byte of the word. Rows
    that share an id are one text; ids without tokens give no row. Tokens move once, by id; what they hash to stays in
    its row, so no task groups places, and a batch of rows is summed, scaled and rounded as one array.
    """
    tokens = rows.select("id", C.hash_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    whole = tokens.repartition(rows.sparkSession.sparkContext.defaultParallelism, "id").groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return whole.mapInArrow(_token_vectors(dim), schema)


def paged(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in an order, with the number of all rows as total."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def fact_caps(facts: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` facts of each question (or entity) in an order: the cap is the feature."""
    return _top(facts, by, order, cap).drop("rank")
