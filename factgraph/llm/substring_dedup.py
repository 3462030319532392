"""Substring deduplication with difference-cover anchors.

A passage repeats if ``WINDOW`` consecutive words of one document also start in a document with a smaller id.
Windows are not all shuffled. Positions modulo a period P in a difference cover D are anchors: for any two positions
there is a shift below P that puts both on the cover, so any two equal windows share an aligned anchor, a run of
``WINDOW - P + 1`` words that is hashed. The steps:

1. one pass hashes the words at anchors; hashes are pre-aggregated in each batch (one row for a hash, and rows that
   are already known to repeat are dealt by document), shuffled, and hashes held by two documents or more remain.
   The same shuffle finds whole texts that are copies of an earlier one.
2. anchors that remain are extended to the windows around them; those windows are compared by 128-bit hashes of all
   their words, the same way, and each document learns which windows an earlier document has.
3. words covered by such windows go. Texts are dealt by id once, for steps 2 and 3 alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.shared import table, written

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
_RNG = np.random.default_rng(1905)
_ODD = _RNG.integers(1, 1 << 63, size=(3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Kinds of rows: a probe (the least id of its batch), one whose batch holds the hash in several documents, the others
#: of that batch, and the same for copies of an earlier text or window.
PROBE, SHARED, KNOWN, FIRST, LATER = range(5)
_ROW = "h long, g long, id long, kind byte"
#: Hashes that a task holds before it passes them on.
_HELD = 1 << 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _combined(hashes: np.ndarray, at: np.ndarray, size: int, family: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += hashes[at + k] * _ODD[family, k % 64] + np.uint64(k)
    return _mixed(total)


def anchors(hashes: np.ndarray, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a text."""
    size = window - period + 1
    at = np.arange(max(0, len(hashes) - size + 1))
    at = at[np.isin(at % period, cover)]
    return at, _combined(hashes, at, size, 0)


def windows(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    return _combined(hashes, at, window, 1), _combined(hashes, at, window, 2)


def whole_text(words: list[bytes]) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(b" ".join(words))
    return both >> 64, both & 0xFFFFFFFFFFFFFFFF


def _batch(h: np.ndarray, g: np.ndarray | None, ids: np.ndarray, first: bool) -> pa.RecordBatch:
    """Rows of one batch, pre-aggregated: the least id of each hash and, by document, the others."""
    if not len(h):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.int8())], ["h", "g", "id", "kind"])
    keys = (ids, h) if g is None else (ids, g, h)
    order = np.lexsort(keys)
    h, ids = h[order], ids[order]
    g = None if g is None else g[order]
    same = h[1:] == h[:-1] if g is None else (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    again = np.r_[False, same & (ids[1:] == ids[:-1])]  # the same hash twice in a document
    h, ids = h[~again], ids[~again]
    g = None if g is None else g[~again]
    same = np.r_[False, h[1:] == h[:-1] if g is None else (h[1:] == h[:-1]) & (g[1:] == g[:-1])]
    if first:
        kind = np.where(same, LATER, FIRST)
    else:
        more = np.r_[same[1:], False]
        kind = np.where(same, KNOWN, np.where(more, SHARED, PROBE))
    second = pa.nulls(len(h), pa.int64()) if g is None else pa.array(g.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), second, pa.array(ids), pa.array(kind.astype(np.int8))], ["h", "g", "id", "kind"])


def _scan_anchors(window: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids, first, second, of, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                _, h = anchors(word_hashes(words), window, period, cover)
                hs.append(h), ids.append(np.full(len(h), i))
                a, b = whole_text(words)
                first.append(a), second.append(b), of.append(i)
                held += len(h)
                if held > _HELD:  # long texts: what is held follows no batch size
                    yield _batch(np.concatenate(hs), None, np.concatenate(ids), False)
                    hs, ids, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
            yield _batch(np.concatenate(hs), None, np.concatenate(ids), False)
            yield _batch(np.array(first, np.uint64), np.array(second, np.uint64), np.array(of, np.int64), True)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash: all that several documents hold, or all but the least id of a FIRST run."""

    def emit(h: np.ndarray, g: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        direct = (kind == KNOWN) | (kind == LATER)
        h2, g2, i2, k2 = h[~direct], g[~direct], ids[~direct], kind[~direct]
        same = np.r_[False, (h2[1:] == h2[:-1]) & (g2[1:] == g2[:-1]) & ((k2[1:] == FIRST) == (k2[:-1] == FIRST))]
        apart = np.r_[False, i2[1:] != i2[:-1]]
        run = np.cumsum(~same)
        # ids are sorted within a run, so its first id is the least and the run is shared if its last id differs
        starts = np.flatnonzero(~same)
        least = i2[starts][run - 1] if len(i2) else i2
        last = i2[np.r_[starts[1:] - 1, len(i2) - 1]][run - 1] if len(i2) else i2
        several = np.add.reduceat((k2 == SHARED).astype(np.int64), starts)[run - 1] > 0 if len(i2) else apart
        stay = np.where(k2 == FIRST, i2 != least, (least != last) | several)
        out = [np.concatenate([x[direct], y[stay]]) for x, y in ((h, h2), (ids, i2), (kind, k2))]
        return pa.RecordBatch.from_arrays([pa.array(out[1]), pa.array(out[0]), pa.array(out[2] >= FIRST)], ["of", "h", "later"])

    held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, np.int8)]
    for batch in batches:
        cols = [batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()]
        held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        whole = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else held[0]
        if len(whole) and (cut := int(whole[-1]) + 1):
            yield emit(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield emit(*held)


def settled(rows: DataFrame) -> DataFrame:
    """(of, h, later): hashes that a document shares, from pre-aggregated rows; later: with an earlier document.

    Rows of one hash meet in one task, one for each batch of documents at most; rows that their batch has settled
    are dealt by document.
    """
    salt = F.when(F.col("kind").isin(KNOWN, LATER), F.col("id")).otherwise(F.lit(0))
    dealt = rows.repartition(F.col("h"), salt).sortWithinPartitions("h", "g", "id")
    return dealt.mapInArrow(_settle, "of long, h long, later boolean")


def _unsigned(found: pa.Scalar | None) -> set[int]:
    return {x & 0xFFFFFFFFFFFFFFFF for x in found.as_py()} if found is not None and found.is_valid else set()


def _members(values: np.ndarray, found: pa.Scalar) -> np.ndarray:
    if not found.is_valid or not len(found):
        return np.zeros(len(values), bool)
    return np.isin(values, found.values.to_numpy().view(np.uint64))


def _extend(window: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, ids, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
            for i, text, shared, copies in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                if i is None or not text.is_valid or not shared.is_valid or not len(shared):
                    continue
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                n = len(words) - window + 1
                if n < 1 or copies.is_valid and whole_text(words)[0] in _unsigned(copies):
                    continue
                hashes = word_hashes(words)
                at, h = anchors(hashes, window, period, cover)
                hit = at[_members(h, shared)]
                mark = np.zeros(n + 1, np.int64)  # windows around an anchor: from period - 1 before it up to it
                np.add.at(mark, np.clip(hit - period + 1, 0, n), 1)
                np.add.at(mark, np.clip(hit + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(mark)[:n])
                a, b = windows(hashes, at, window)
                first.append(a), second.append(b), ids.append(np.full(len(at), i))
                held += len(at)
                if held > _HELD:
                    yield _batch(np.concatenate(first), np.concatenate(second), np.concatenate(ids), True)
                    first, second, ids, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
            yield _batch(np.concatenate(first), np.concatenate(second), np.concatenate(ids), True)

    return run


def _removed(window: int, digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, copies, lost in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n, stay = len(words), words
                if n >= window and copies.is_valid and whole_text(words)[0] in _unsigned(copies):
                    stay = []
                elif n >= window and lost.is_valid:
                    at = np.arange(n - window + 1)
                    hit = at[_members(windows(word_hashes(words), at, window)[0], lost)]
                    mark = np.zeros(n + 1, np.int64)
                    np.add.at(mark, hit, 1)
                    np.add.at(mark, hit + window, -1)
                    stay = [words[k] for k in np.flatnonzero(np.cumsum(mark)[:n] == 0)]
                n_words.append(n), n_removed.append(n - len(stay))
                joined = b" ".join(stay)
                kept.append(hashlib.sha256(joined).hexdigest() if digest_only else joined.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, digest_only: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row; kept words are joined by one space (their SHA-256 if digest_only).

    Each word covered by a window whose words also start in a document with a smaller id is removed; windows are
    judged on the input. Null and short texts lose nothing; a very long text is read whole and takes memory in
    proportion to its words. Rows that share an id are one document and lose nothing
    to each other; a row with a null id takes no part and keeps all. An empty table gives no rows.
    Other columns are left out, whatever their names.
    """
    if not all(any((a + s) % period in cover and (b + s) % period in cover for s in range(period)) for a in range(period) for b in range(period)) or period > window:
        raise ValueError("not a difference cover")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    part = source.where("id is not null and text is not null")
    shared = settled(part.mapInArrow(_scan_anchors(window, period, cover), _ROW))
    by_doc = written(shared.groupBy("of").agg(F.collect_set(F.when(~F.col("later"), F.col("h"))).alias("shared"), F.collect_set(F.when(F.col("later"), F.col("h"))).alias("copies")), "anchors")
    copies = by_doc.where(F.size("copies") > 0).select("of", "copies")
    dealt = source.repartition("id")
    # outer joins both times: no filter is pushed below the exchange of the texts, so both use the same one
    around = dealt.join(by_doc.hint("merge"), F.col("id") == F.col("of"), "left").select("id", "text", "shared", F.when(F.size("copies") > 0, F.col("copies")).alias("copies"))
    later = settled(around.mapInArrow(_extend(window, period, cover), _ROW))
    lost = later.groupBy("of").agg(F.collect_list("h").alias("lost"))
    told = dealt.join(copies.withColumnRenamed("of", "o1").hint("merge"), F.col("id") == F.col("o1"), "left").join(lost.withColumnRenamed("of", "o2").hint("merge"), F.col("id") == F.col("o2"), "left")
    return told.select("id", "text", "copies", "lost").mapInArrow(_removed(window, digest_only), "id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), digest_only=True)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE = {
    "op7_substring_dedup": r"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    grams AS (
      SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 12), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS pos FROM words WHERE len(w) >= 13)),
    firsts AS (SELECT gram, min(doc_id) AS first_doc FROM grams GROUP BY gram HAVING min(doc_id) <> max(doc_id)),
    hits AS (SELECT g.doc_id, g.pos FROM grams g JOIN firsts f ON g.gram = f.gram AND g.doc_id > f.first_doc),
    covered AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 12)) AS pos FROM hits),
    each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
    kept AS (
      SELECT e.doc_id, count(c.pos) AS n_removed,
             coalesce(string_agg(e.word, ' ' ORDER BY e.pos) FILTER (WHERE c.pos IS NULL), '') AS kept
      FROM each_word e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
}
