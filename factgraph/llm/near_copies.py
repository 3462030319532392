"""Near copies by the Jaccard similarity of their word shingles: two sources feed candidates, every link is exact.

Texts are collapsed to distinct shingle sets first, so exact copies cost one row. First the SimHash fingerprints of the
sets meet in the Gray-order hierarchical index (``simhash.links``): it gives a forest of links within 2 bits, of which
those with the similarity stay. What they join is one component to the second source, MinHash bands, which find the
pairs that lie farther apart. A set's signature is cut into bands;
sets that agree in a band meet in a bucket. With 32 bands of 5 rows a pair at the least similarity of 0.8 misses all
of them with a chance of 3 in a million. Buckets are not expanded to all pairs: the smallest sets of a bucket (its
pivots: 1, then 8, 64, ...) meet its other sets and then leave it. A large bucket is dealt over tasks, and a task
passes on only pairs that links don't join yet and whose sketches allow the similarity. A sketch counts the shingles
in each of 256 cells of their hashes: the sum of the lesser counts of two sketches bounds the shingles that the sets
can share, so no pair is lost by it. A bucket is done when links join all that is left of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm import simhash
from factgraph.llm.shared import sized, written
from factgraph.llm.simhash import components

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
BANDS, ROWS = 32, 5
#: Cells of a sketch; greatest number of pivots in a round; sets of a bucket that a task takes.
CELLS, PIVOTS, DEALT = 256, 4096, 2000
_CHUNK = 1 << 12
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the buckets of a set; an empty set has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (_FACTORS * hashes[at : at + _CHUNK] + _OFFSETS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(b.astype("<u8").tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set: a bit is 1 if it is in over half of the hashes; an empty set has zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes))))


def sketch(hashes: np.ndarray) -> bytes:
    """Shingles in each cell, two bytes each; a cell of 65,535 or more says so."""
    cells = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
    return np.minimum(cells, 65_535).astype("<u2").tobytes()


def _signed(xs: list[int]) -> np.ndarray:
    return np.array(xs, np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, fp, bands) of each row; node names the shingle set. One pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # sets are as large as their texts
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            keys = [_signed(bands(s)) for s in sets]
            names, fps = _signed([node(s) for s in sets]), _signed([fingerprint(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "fp", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, node long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of each row of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # sets are as large as their texts
                sets = [shingle_set(t.as_py()) for t in batch.column(0)[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(_signed([node(s) for s in sets])), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.select("text").mapInArrow(run, "node long, hashes array<long>")


def sketches(sets: DataFrame) -> DataFrame:
    """(node, n, sketch) of each set (node, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(h.values, np.int64).view(np.uint64) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([sketch(s) for s in found], pa.binary())], ["node", "n", "sketch"])

    return sets.select("node", "hashes").mapInArrow(run, "node long, n long, sketch binary")


def _meet(least: float):
    """Pairs (a, b) of members and pivots that links don't join and that may have the similarity; rows come by (key, salt), pivots first."""

    def pairs(p: dict[str, np.ndarray], m: dict[str, np.ndarray]) -> np.ndarray:
        step, out = max(1, (1 << 12) // len(p["node"])), []
        for at in range(0, len(m["node"]), step):
            x = {k: v[at : at + step, None] for k, v in m.items()}
            n, low = x["n"] + p["n"], np.minimum(x["n"], p["n"])
            i, j = np.nonzero((x["node"] > p["node"]) & (x["component"] != p["component"]) & (low >= least * (n - low) - 1e-9))
            if len(i):
                a, b = m["sketch"][at + i], p["sketch"][j]
                both = np.minimum(a, b)
                most = np.where((both == 65_535).any(axis=1), low[i, j], both.sum(axis=1, dtype=np.int64))
                may = most >= least * (n[i, j] - most) - 1e-9
                out.append(np.stack([m["node"][at + i[may]], p["node"][j[may]]]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy() for k in ("key", "salt", "pivot", "node", "component", "n")}
            rows["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(-1, CELLS)
            cuts = np.flatnonzero(np.r_[True, (np.diff(rows["key"]) != 0) | (np.diff(rows["salt"]) != 0) | (np.diff(rows["pivot"]) != 0)])
            out = []
            for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=True):
                part = {k: rows[k][a:b] for k in ("node", "component", "n", "sketch")}
                here = rows["key"][a], rows["salt"][a]
                if rows["pivot"][a] == 0:
                    held = pivots if here == group else {k: v[:0] for k, v in part.items()}
                    group, pivots = here, {k: np.concatenate([held[k], part[k]]) for k in part}
                elif here == group:
                    out.append(pairs(pivots, part))
            if out:
                found = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return run


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (u > v) of the pairs (a, b) whose sets have at least the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    m, n = F.size("x"), F.size("y")
    near = pairs.join(left.hint("merge"), "a")
    both = F.size(F.array_intersect("x", "y"))
    joined = near.join(right.hint("merge"), "b").where(both >= F.lit(least) * (m + n - both) - 1e-9)
    return joined.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _named(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows (key, node) with the component that links have reached so far."""
    if found is None:
        return rows.withColumn("component", F.col("node"))
    of = found.select(F.col("node"), F.col("component").alias("c"))
    return rows.join(of.hint("merge"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("component"))


def groups(live: DataFrame, sets: DataFrame, links: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, component) of linked nodes, from buckets (key, node), their sets and links known beforehand."""
    found, pivots, spark = None if links.isEmpty() else components(links), 1, live.sparkSession
    shapes = written(sketches(sets), "sketches")
    while True:
        tasks = sized(spark, live.count())
        named = _named(live, found)
        open_ = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high")
        open_ = open_.select("key", F.ceil(F.col("size") / DEALT).alias("salts"))
        named = written(named.join(open_.hint("merge"), "key").join(shapes.hint("merge"), "node").coalesce(tasks), "buckets")
        if named.isEmpty():
            return components(links) if found is None else found
        rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
        first = written(named.withColumn("rank", rank).where(F.col("rank") <= pivots).coalesce(tasks), "pivots").drop("rank")
        of = ["key", "salt", "pivot", "node", "component", "n", "sketch"]
        dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("pivot", F.lit(0)).select(*of)
        dealt = dealt.union(named.withColumn("salt", F.pmod(F.xxhash64("node"), "salts")).withColumn("pivot", F.lit(1)).select(*of))
        dealt = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "pivot")
        pairs = written(dealt.mapInArrow(_meet(least), "a long, b long").distinct().coalesce(tasks), "pairs")
        near = written(similar(pairs, sets, least).coalesce(sized(spark, pairs.count(), 10_000)), "near")
        if found is None:
            found = components(links.union(near))
        elif not near.isEmpty():  # what is known is a star for each component already
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(near))
        last = first.groupBy("key").agg(F.max("node").alias("last"))
        live = written(named.join(last.hint("merge"), "key").where("node > last").select("key", "node").coalesce(tasks), "live")
        pivots = min(PIVOTS, pivots * 8)


def fingerprint_pairs(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints the Gray-order index links, from (node, fp): a forest, not all pairs."""
    first = written(reps.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    equal = reps.join(first.hint("merge"), "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return equal.union(simhash.links(first).select(F.col("u").alias("a"), F.col("v").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, component_id) for each row with an id; component_id is the smallest id that links reach.

    Rows without words (null and empty texts too) are copies of each other. Rows that share an id are one document. Very
    long texts are shingled whole, one at a time, and their shingles are rows of the check that follows. Rows with a
    null id take no part. An empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = written(signatures(docs, id_col, text_col).where("id is not null"), "signatures")
    reps = written(rows.groupBy("node").agg(F.min("id").alias("rep"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "representatives")
    # an id with several texts ties their sets together
    least = rows.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v <> most").select("id", "v")
    same = written(rows.join(least.hint("merge"), "id").where("node > v").select(F.col("node").alias("u"), "v").distinct(), "same")
    keys = reps.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = written(keys.join(shared.hint("merge"), "key").select("key", "node"), "live")
    close = written(fingerprint_pairs(reps.select("node", "fp")), "close")
    wanted = written(live.select("node").union(close.select("a")).union(close.select("b")).distinct(), "candidates")
    ids = written(reps.join(wanted.hint("merge"), "node").select(F.col("rep").alias("id")).distinct(), "ids")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids.hint("merge"), "id", "left_semi")
    sets = written(shingle_sets(texts).groupBy("node").agg(F.any_value("hashes").alias("hashes")), "sets")
    found = groups(live, sets, written(same.union(similar(close, sets)), "first_links"))
    named = written(reps.select("node", "rep").join(found.hint("merge"), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "components")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = written(named.join(smallest.hint("merge"), "component").select("node", "component_id"), "smallest")
    return rows.select("id", "node").join(of_node.hint("merge"), "node").select("id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group the rows with the smallest id stay; rows with a null id stay.

    Null, empty and wordless texts are copies of each other; very long texts are compared whole; rows that share an id
    stay or go together. All columns stay, whatever their names; an empty table gives an empty one.
    """
    lost = written(near_duplicates(docs, id_col, text_col).where("id <> component_id").select("id").distinct(), "lost")
    return docs.join(lost.hint("merge"), docs[id_col].cast("long") == lost["id"], "left_anti")
