"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints are collapsed to distinct ones first, so exact copies cost one row. The index is a tree:

* upper nodes: the bits are cut into ``distance + 1`` blocks, of which two fingerprints within the distance leave one
  equal. An upper node is the masked bit pattern of one block that all fingerprints below it share, and the key of the
  shuffle. A node of more than ``split`` fingerprints is factored again: the bits that its mask leaves free are cut
  the same way, level on level, until at most ``free`` bits are, so no node outgrows a task and no pair is lost.
* inner nodes: below an upper node fingerprints stand in Gray order; runs of neighbours are factored into (mask of
  agreeing bits, their pattern), level on level.
* leaves: the fingerprints.

Every upper node is searched the same way: pairs of nodes are expanded from the top while their accumulated
difference (over the bits that both nodes fix, which only grow downwards) stays within the distance, so whole groups
are pruned at once. Each upper node reports its links as a forest (a link per joined fingerprint, not per pair);
components over upper nodes come from alternating star contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.shared import sized, table, written

SEED, SHINGLE = 42, 3
DISTANCE = 2
#: Children of an inner node.
FAN_OUT = 2
#: Fingerprints of an upper node beyond which it is factored again, and the free bits at which that ends.
SPLIT, FREE = 1 << 16, 16
_CHUNK = 1 << 18
_ONES = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; a text without words (or null) has fingerprint zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        grams: list[bytes] | Iterator[bytes] = [b" ".join(words)]
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long. No shuffle, one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def masks(above: int = 0, distance: int = DISTANCE) -> list[int]:
    """Masks one level below a mask: each adds one of distance + 1 blocks of the bits that it leaves free."""
    free = [b for b in range(64) if not above >> b & 1]
    edges = [round(i * len(free) / (distance + 1)) for i in range(distance + 2)]
    return [above | sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray sequence: neighbours in rank tend to share bits."""
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _find(parent: np.ndarray, a: np.ndarray) -> np.ndarray:
    while True:
        up = parent[a]
        if np.array_equal(up, a):
            return a
        a = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of many links at once: hook larger roots below smaller ones until no link joins two trees."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _levels(fps: np.ndarray, node: np.ndarray, fan_out: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(mask of agreeing bits, pattern, first child, children) by level, leaves first, up to one root for each upper node.

    fps stand in Gray order within their upper node; node numbers these from zero without gaps.
    """
    mask, pattern = np.full(len(fps), _ONES, np.uint64), fps
    levels = [(mask, pattern, np.zeros(0, np.int64), np.zeros(0, np.int64))]
    roots = int(node[-1]) + 1 if len(node) else 0
    while len(pattern) > roots:
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        first = np.flatnonzero((np.arange(len(node)) - begin[node]) % fan_out == 0)
        ones = np.bitwise_and.reduceat(pattern & mask, first)
        zeros = np.bitwise_and.reduceat(~pattern & mask, first)
        levels.append((ones | zeros, ones, first, np.diff(np.r_[first, len(node)])))
        mask, pattern, node = ones | zeros, ones, node[first]
    return levels


def tree_links(fps: np.ndarray, node: np.ndarray, distance: int = DISTANCE, fan_out: int = FAN_OUT, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within upper nodes as a forest: indexes (child, root). fps are distinct in a node and stand as for _levels.

    seen, if given, gets the number of pairs compared at each level, from the roots down to the leaves.
    """
    levels = _levels(fps, node, fan_out)
    parent = np.arange(len(fps))
    roots = np.arange(len(levels[-1][1]))
    stack = [(len(levels) - 1, roots, roots)]
    tally = [0] * len(levels)
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            _join(parent, a, b)
            continue
        first, children = levels[level][2:]
        mask, pattern = levels[level - 1][:2]
        for at in range(0, len(a), step := max(1, _CHUNK // (fan_out * fan_out))):
            x, y = a[at : at + step], b[at : at + step]
            n = children[x] * children[y]
            which = np.repeat(np.arange(len(x)), n)
            k = np.arange(len(which)) - (np.cumsum(n) - n)[which]
            width = children[y][which]
            x, y = first[x][which] + k // width, first[y][which] + k % width
            apart = x < y if level == 1 else x <= y
            x, y = x[apart], y[apart]
            tally[level - 1] += len(x)
            close = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= distance
            if close.any():
                stack.append((level - 1, x[close], y[close]))
    if seen is not None:
        seen.extend(reversed(tally))
    root = _find(parent, np.arange(len(fps)))
    child = np.flatnonzero(root != np.arange(len(fps)))
    return child, root[child]


def _index_links(distance: int, fan_out: int):
    def emit(mask: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole upper nodes; rows come by (mask, pattern)."""
        pattern = fp & mask
        new = np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]
        node = np.cumsum(new) - 1
        many = np.bincount(node)[node] > 1  # a node of one fingerprint has no pair
        if many.any():
            fp, rep = fp[many], rep[many]
            node = np.cumsum(np.r_[0, np.diff(node[many]) != 0])
            order = np.lexsort((gray_rank(fp), node))
            fp, rep = fp[order], rep[order]
            child, root = tree_links(fp, node, distance, fan_out)
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[child], rep[root])), pa.array(np.minimum(rep[child], rep[root]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            mask, fp = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            rep, pattern = batch.column(2).to_numpy(), fp & mask
            if not len(fp):
                continue
            if held and (held[-1][0][-1] != mask[0] or held[-1][1][-1] & held[-1][0][-1] != pattern[0]):
                yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            last = np.flatnonzero((mask != mask[-1]) | (pattern != pattern[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                held.append([mask[:cut], fp[:cut], rep[:cut]])
                yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append([mask[cut:], fp[cut:], rep[cut:]])
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def upper_nodes(reps: DataFrame, distance: int = DISTANCE, split: int = SPLIT, free: int = FREE) -> DataFrame:
    """(mask, p, fp, rep): each fingerprint below each of its upper nodes.

    Nodes of more than ``split`` fingerprints give way to those one level down, which only their rows pay for.
    """
    done, level = None, [0]
    rows = reps.select(F.lit(0).cast("long").alias("mask"), "fp", "rep")
    while True:
        below = {m: masks(m, distance) for m in level}
        pick = F.create_map(*(c for m, ms in below.items() for c in (F.lit(_signed(m)), F.array(*(F.lit(_signed(x)) for x in ms)))))
        nodes = rows.select(F.explode(pick[F.col("mask")]).alias("mask"), "fp", "rep")
        nodes = nodes.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("p"), "fp", "rep")
        level = sorted({m for ms in below.values() for m in ms})
        if min(m.bit_count() for m in level) >= 64 - free:
            return nodes if done is None else done.union(nodes)
        large = written(nodes.groupBy("mask", "p").agg(F.count("*").alias("n")).where(F.col("n") > split).select("mask", "p"), "large")
        if large.isEmpty():
            return nodes if done is None else done.union(nodes)
        small = nodes.join(large.hint("merge"), ["mask", "p"], "left_anti")
        done = small if done is None else done.union(small)
        rows = written(nodes.join(large.hint("merge"), ["mask", "p"], "left_semi").select("mask", "fp", "rep"), "split")


def links(reps: DataFrame, distance: int = DISTANCE, fan_out: int = FAN_OUT, split: int = SPLIT, free: int = FREE) -> DataFrame:
    """Links (u > v) between representatives whose fingerprints differ in at most ``distance`` bits, as forests.

    reps: (fp, rep) with distinct fp. The shuffle carries one small row for each fingerprint and upper node.
    """
    nodes = upper_nodes(reps, distance, split, free)
    dealt = nodes.repartition("mask", "p").sortWithinPartitions("mask", "p")
    return dealt.select("mask", "fp", "rep").mapInArrow(_index_links(distance, fan_out), "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of linked nodes, component the smallest node reachable: alternating star contraction.

    A large star links the larger neighbours of each node to its smallest neighbour, a small star does so with the
    rest; rounds repeat until no link changes. Each round is cut off by a table in the shared folder. Minima are
    pre-aggregated before their shuffle and written, and the joins that carry them can be split where a node is a hub.
    """

    def star(both: DataFrame, keep_larger: bool, tasks: int) -> DataFrame:
        # written, so that both sides of the join are plain shuffles and adaptive execution can split a hub
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        joined = both.join(least.hint("merge"), "u")
        if keep_larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).coalesce(tasks)
        return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).union(least.select("u", F.col("m").alias("v")))

    edges = written(edges, "links")
    seen = (edges.count(), None)
    for _ in range(max_rounds):
        tasks = sized(edges.sparkSession, 2 * seen[0])  # a round has at most twice the rows that it begins with
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True, tasks).where("u > v").distinct().coalesce(tasks)
        small = star(large, False, tasks).where("u > v").distinct().coalesce(tasks)
        edges = written(small, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError("star contraction did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row (id, fp, component_id) for each input row.

    component_id is the smallest id that links reach. Null and empty texts have fingerprint zero, linked like any
    other. Very long texts are read whole, their shingle hashes held at 8 bytes a word. Rows that share an id are one
    node. A row with a null id joins no group: its component_id is null. An empty table gives no rows; other columns
    are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = written(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    # an id with two texts ties their fingerprints together
    twice = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("id")
    same = fps.join(twice.hint("merge"), "id").join(reps.hint("merge"), "fp").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    found = components(links(reps, distance).union(same))
    of_fp = written(reps.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "components")
    joined = fps.join(of_fp.hint("merge"), "fp", "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs without near-duplicates: of each group the rows with the smallest id stay; rows with a null id stay.

    Null, empty and wordless texts have fingerprint zero and are copies of each other; very long texts are shingled
    whole; rows that share an id stay or go together. All columns stay, whatever their names; an empty table gives an
    empty one.
    """
    found = near_duplicates(docs, id_col, text_col, distance)
    lost = written(found.where("id <> component_id").select("id").distinct(), "lost")
    return docs.join(lost.hint("merge"), docs[id_col].cast("long") == lost["id"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
