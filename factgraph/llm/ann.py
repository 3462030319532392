"""Approximate nearest neighbours: an inverted file scanned with adaptive dimensions.

Vectors are rotated at random and dealt into lists by their nearest centroid; the table of lists is written once,
sorted by list, and each task holds a stretch of it. Queries come in blocks of bounded size, which are sent to every
task. A block makes two passes over the lists, and no vector is moved or copied for it:

* the nearest lists of each query, until they hold enough candidates, are measured; their k best give its bound;
* the other lists that it probes are scanned against that bound, which goes on falling with what a task finds.
  Rotated vectors are read in column blocks, and after each block a hypothesis test on the partial distance abandons
  the candidates that would exceed the bound with high confidence. Survivors are measured in double precision on the
  original vectors, and a task reports at most k of them for each query.

Centroids are fitted on a bounded, documented sample; every row is indexed. A long list is spread over tasks. A query
always probes enough lists to have k candidates: where the table is small or lists are few, the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.shared import sized, table, written

K = 10
#: Vectors that centroids are fitted on (the first by a hash of their id), and the greatest number of lists.
SAMPLE, MAX_LISTS = 20_000, 4096
#: Share of the lists that a query probes: without clusters to exploit, near neighbours are spread over most lists.
PROBE_SHARE = 0.9
#: Dimensions in a column block, and the width of the test (its error falls as exp(-width squared)).
BLOCK, WIDTH = 8, 1.4
#: Bytes of query vectors in a block; rows of a list and pairs of row and query that a task scans at once.
QUERY_BYTES, CHUNK, PAIRS = 32 << 20, 4096, 1 << 18
#: Queries whose lists a task ranks at once.
SLICE = 256
#: Candidates, in multiples of k, that the nearest lists must hold to give the first bound.
FIRST = 8
SEED = 29


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def valid(vector: Column, dim: int | None = None) -> Column:
    """Not null, no null or non-finite component, not zero (and of the given length)."""
    fine = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine & (F.size(vector) == dim) if dim else fine, F.lit(False))


def centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k-means on the sample; an empty cluster keeps its centre."""
    c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        sums, sizes = np.zeros_like(c), np.bincount(near, minlength=lists)
        np.add.at(sums, near, x)
        c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return c


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


class Best:
    """The k nearest found so far of each query: distances and ids, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.d, self.ids, self.new = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), bool)

    def merge(self, of: np.ndarray, d: np.ndarray, ids: np.ndarray, new: bool = True) -> None:
        if not len(of):
            return
        k, some = self.d.shape[1], np.unique(of)
        of = np.r_[np.repeat(some, k), of]
        d, ids = np.r_[self.d[some].ravel(), d], np.r_[self.ids[some].ravel(), ids]
        fresh = np.r_[self.new[some].ravel(), np.full(len(of) - len(some) * k, new)]
        order = np.lexsort((ids, d, of))
        of = of[order]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(begin, np.diff(np.r_[begin, len(of)]))
        order, of, place = order[place < k], of[place < k], place[place < k]
        self.d[of, place], self.ids[of, place], self.new[of, place] = d[order], ids[order], fresh[order]


def scan(best: Best, x: np.ndarray, rotated: np.ndarray, ids: np.ndarray, query: np.ndarray, query_rotated: np.ndarray, own: np.ndarray, at: np.ndarray, block: int = BLOCK, width: float = WIDTH, read: list[int] | None = None) -> None:
    """Scans rows of one list for the queries ``at`` and merges what is found into ``best``.

    Partial squared distances over the first d of D rotated dimensions, scaled by D/d, are tested against the bound
    widened by (1 + width / sqrt(d)) squared. read, if given, gets the dimensions read and the pairs measured exactly.
    """
    dim = x.shape[1]
    for row in range(0, len(ids), CHUNK):
        part, step = rotated[row : row + CHUNK], max(1, PAIRS // min(CHUNK, len(ids) - row))
        squares = (part[:, :block] ** 2).sum(axis=1)
        for first in range(0, len(at), step):
            of = at[first : first + step]
            bound, q = best.d[of, -1] ** 2, query_rotated[of]
            # the first column block for all pairs at once, the others for those that are left
            partial = squares[:, None] + (q[:, :block] ** 2).sum(axis=1) - 2 * part[:, :block] @ q[:, :block].T
            pairs, to = partial.size * min(block, dim), min(block, dim)
            while True:
                limit = bound * (1 + 1e-9) + 1e-12 if to == dim else bound * (to / dim) * (1 + width / np.sqrt(to)) ** 2 + 1e-12
                if to <= block:
                    i, j = np.nonzero((partial <= limit) & (ids[row : row + CHUNK, None] != own[of]))
                    partial = partial[i, j]
                else:
                    stay = partial <= limit[j]
                    i, j, partial = i[stay], j[stay], partial[stay]
                if to == dim or not len(i):
                    break
                end = min(dim, to + block)
                difference = part[i, to:end] - q[j, to:end]
                partial += np.einsum("ij,ij->i", difference, difference)
                pairs, to = pairs + difference.size, end
            if len(i):
                exact = np.sqrt(((x[row + i] - query[of[j]]) ** 2).sum(axis=1))
                best.merge(of[j], exact, ids[row + i])
            if read is not None:
                read[0] += pairs
                read[1] += len(i)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, sample: int = SAMPLE, max_lists: int = MAX_LISTS, probe_share: float = PROBE_SHARE, block: int = BLOCK, width: float = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, nearest first, ties to the smaller id.

    score is the Euclidean distance on the original vectors. A row with the query's id is no candidate for it. Null,
    zero and non-finite vectors, null ids and vectors of another length than the most common one take no part. Rows
    that repeat an id count as often as they stand there; a repeated query is searched once. With fewer than k
    candidates all of them are returned; an empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    named = [df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & valid(F.col("v"))) for df in (vectors, queries)]
    lengths = named[0].groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, total = lengths[0]["n"], lengths[0]["count"]
    rows, asked = (df.where(F.size("v") == dim) for df in named)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    lists = int(max(1, min(max_lists, round(np.sqrt(total)), total)))
    turn = rotation(dim)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    centre = centroids(_matrix(picked.column("v"), dim) @ turn.T, min(lists, min(sample, total)))
    lists = len(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim) @ turn.T
            near = [np.argmin((centre**2).sum(axis=1) - 2 * x[a : a + 4096] @ centre.T, axis=1) for a in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near).astype(np.int32) if near else [], pa.int32()), batch.column(0), batch.column(1)], ["list", "id", "v"])

    dealt = written(rows.select("id", "v").mapInArrow(assign, "list int, id long, v array<double>"), "assigned")
    filed = written(dealt.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list", "id"), "lists")
    counts = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}  # at most max_lists rows
    size = np.array([counts.get(i, 0) for i in range(lists)])
    least = max(1, int(np.ceil(probe_share * lists)))
    n_asked = asked.count()
    blocks = max(1, -(-n_asked * dim * 8 // QUERY_BYTES))
    norms = (centre**2).sum(axis=1)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How far each query's nearest lists go, those that give the first bound, and the lists to probe: distances to centres."""
        for batch in batches:
            x = _matrix(batch.column(1), dim) @ turn.T
            near, far = np.zeros(len(x)), np.zeros(len(x))
            for a in range(0, len(x), SLICE):
                apart = norms - 2 * x[a : a + SLICE] @ centre.T
                turn_in = np.argsort(apart, axis=1, kind="stable")
                held = np.cumsum(size[turn_in], axis=1) - size[turn_in]  # before each list
                # until there are candidates for the first bound; the share to probe, and on until there are k
                first = (held <= FIRST * k).sum(axis=1) - 1
                last = np.maximum(np.maximum(least, (held <= k).sum(axis=1)) - 1, first)
                of = np.arange(len(apart))
                near[a : a + SLICE], far[a : a + SLICE] = apart[of, turn_in[of, first]], apart[of, turn_in[of, last]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(far)], ["id", "v", "near", "far"])

    asked = written(asked.repartition(sized(spark, n_asked, SLICE)).mapInArrow(reach, "id long, v array<double>, near double, far double"), "asked")

    def one_block(block_rows: pa.Table) -> DataFrame:
        own, query = block_rows.column("id").to_numpy(), _matrix(block_rows.column("v"), dim)
        query_rotated = query @ turn.T
        near, far = (block_rows.column(c).to_numpy() * (1 + 1e-12) + 1e-12 for c in ("near", "far"))

        def scanned(start: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
            # vectors twice and k bounds for each query: a few times QUERY_BYTES, whatever the number of lists
            sent = spark.sparkContext.broadcast((start, own, query, query_rotated, near, far))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                start, own, query, query_rotated, near, far = sent.value
                best = Best(len(own), k)
                if start is not None:
                    best.merge(*start, new=False)
                for batch in batches:
                    of, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    x = _matrix(batch.column(2), dim)
                    rotated = x @ turn.T
                    cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else [0]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        apart = norms[of[a]] - 2 * query_rotated @ centre[of[a]]
                        at = np.flatnonzero(apart <= near if start is None else (apart > near) & (apart <= far))
                        if len(at):
                            scan(best, x[a:b], rotated[a:b], ids[a:b], query, query_rotated, own, at, block, width)
                q, i = np.nonzero(best.new & np.isfinite(best.d))
                for at in range(0, len(q), 1 << 16):
                    y, z = q[at : at + (1 << 16)], i[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(own[y]), pa.array(best.ids[y, z]), pa.array(best.d[y, z])], ["query_id", "vec_id", "score"])

            return filed.mapInArrow(run, "query_id long, vec_id long, score double")

        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        first = written(scanned(None).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "nearest")
        bound = first.toArrow()  # at most k rows for each query of the block
        number = {int(q): n for n, q in enumerate(own)}
        start = np.array([number[q] for q in bound.column("query_id").to_pylist()], np.int64), bound.column("score").to_numpy(), bound.column("vec_id").to_numpy()
        rest = scanned(start)
        return first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    found = []
    for b in range(blocks):
        here = one_block(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow())
        found.append(written(here, "found") if blocks > 1 else here)
    return reduce(DataFrame.union, found)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op3_ann": op3_ann}
