"""Document fingerprints that tell versions apart: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs and these at the marks that end a sentence or clause; each piece has a 64-bit digest (its
n-th repetition one of its own). A sketch adds every digest to one cell of each of three tables: a count, the XOR of
digests and the XOR of check hashes. The sketch of one version minus that of another holds only the digests in which
they differ, and cells with one digest left are peeled until nothing is left. Where peeling stops early the sketches
are made again with four times the cells, from the pieces, until it comes through; so likeness is exact, never estimated.

Texts move once, by ranges of their id. A row meets the next one inside its task; only the first and last row of each
task are written and meet by the number of the task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.shared import table, written

#: Cells of a fingerprint, in three tables; peeling mostly comes through for differences up to two thirds of them.
CELLS = 12
#: Characters of texts that a task compares at once.
SLICE = 1_000_000
_ENDS = re.compile(r"(?<=[.!?,;:])\s+|\n+|(?<=[。！？、，；：])")
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

Sketch = tuple[np.ndarray, np.ndarray, np.ndarray]
Pieces = tuple[np.ndarray, np.ndarray]


def digests(text: str) -> np.ndarray:
    """Distinct digests of the pieces of a text, in order; repetitions of a piece are told apart by their number."""
    pieces = [p for p in map(str.strip, _ENDS.split(text)) if p]
    if len(set(pieces)) == len(pieces):
        return np.array([xxhash.xxh64_intdigest(p.encode()) for p in pieces], np.uint64)
    seen: dict[str, int] = {}
    out = []
    for p in pieces:
        n = seen.get(p, 0)
        seen[p] = n + 1
        out.append(xxhash.xxh64_intdigest(p.encode(), n))
    return np.array(out, np.uint64)


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys + np.uint64(_STEP * (salt + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, 7).astype(np.uint32)


def _cells(keys: np.ndarray, row: np.ndarray, cells: int, j: int) -> np.ndarray:
    """Places of keys in table j of their row's sketch, in one flat array of all sketches."""
    size = cells // 3
    return row * cells + j * size + (_mixed(keys, j) % np.uint64(size)).astype(np.int64)


def sketch(pieces: Pieces, rows: int, cells: int) -> Sketch:
    """Counts, digests and checks of ``rows`` sketches, flat; pieces are (digest, row) arrays."""
    keys, row = pieces
    count, key, check = np.zeros(rows * cells, np.int32), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint32)
    for j in range(3):
        at = _cells(keys, row, cells, j)
        np.add.at(count, at, 1)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, _check(keys))
    return count, key, check


def peel(a: Sketch, b: Sketch, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, digest, row, side) of sketches a minus b: rows that came through, and digests that only a (1) or b (-1) has."""
    count, key, check = a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]
    size, found, idle = cells // 3, [], 0
    shaped = np.arange(rows * cells).reshape(rows, 3, size)
    for turn in range(6 * cells):  # each digest takes a turn or less; what a false match keeps turning is made again
        if idle == 3:
            break
        j = turn % 3  # a table has a digest in one cell only, so what is pure in one table has no repeats
        at = shaped[:, j].ravel()
        at = at[np.abs(count[at]) == 1]
        at = at[(_check(key[at]) == check[at]) & (_cells(key[at], at // cells, cells, j) == at)]
        idle = 0 if len(at) else idle + 1
        if len(at):
            keys, side, row = key[at], count[at].copy(), at // cells
            found.append((keys, row, side))
            for other in range(3):
                to = _cells(keys, row, cells, other)
                np.subtract.at(count, to, side)
                np.bitwise_xor.at(key, to, keys)
                np.bitwise_xor.at(check, to, _check(keys))
    left = ((count != 0) | (key != 0)).reshape(rows, cells).any(axis=1)
    keys, row, side = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    return ~left, keys, row, side


def _flat(each: list[np.ndarray]) -> Pieces:
    return np.concatenate([np.zeros(0, np.uint64), *each]), np.repeat(np.arange(len(each)), [len(x) for x in each])


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, row, side) in which each pair of versions differs, peeled from sketches that grow until all come through."""
    todo = np.arange(len(a))
    out = []
    while len(todo):
        first, second = (sketch(_flat([x[i] for i in todo]), len(todo), cells) for x in (a, b))
        whole, keys, row, side = peel(first, second, len(todo), cells)
        good = whole[row]
        out.append((keys[good], todo[row[good]], side[good]))
        todo, cells = todo[~whole], cells * 4
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Shared pieces over all pieces of each pair, from the peeled differences; 1 if neither has any."""
    _, row, side = differences(a, b, cells)
    only_a, only_b = (np.bincount(row[side == s], minlength=len(a)) for s in (1, -1))
    n = np.array([len(x) for x in a], np.int64)
    union = n + only_b
    return np.where(union == 0, 1.0, (n - only_a) / np.maximum(union, 1))


def fingerprint(each: list[np.ndarray], cells: int = CELLS) -> list[bytes]:
    """Sketches as bytes, a list for each of counts, digests and checks, little-endian; equal pieces give equal bytes."""
    parts = sketch(_flat(each), len(each), cells)
    shaped = np.hstack([x.astype(x.dtype.newbyteorder("<")).reshape(len(each), cells).view(np.uint8) for x in parts])
    return [r.tobytes() for r in shaped]


def subtract(a: bytes, b: bytes, cells: int = CELLS) -> tuple[list[int], list[int]] | None:
    """Digests that only a or only b has, of two fingerprints of one size; None if they differ in more than peeling brings out."""

    def parts(x: bytes) -> Sketch:
        return np.frombuffer(x, "<i4", cells), np.frombuffer(x, "<u8", cells, 4 * cells), np.frombuffer(x, "<u4", cells, 12 * cells)

    whole, keys, _, side = peel(parts(a), parts(b), 1, cells)
    return ([int(k) for k in keys[side == 1]], [int(k) for k in keys[side == -1]]) if whole[0] else None


def edited(text: str, after: str) -> str:
    """A text with its last half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_DONE = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("efp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ROW = pa.schema([*_DONE, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
_DDL = "id long, n_chars long, edited_sha256 string, fp binary, efp binary, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], own: list[np.ndarray], cells: int) -> pa.RecordBatch:
    """Rows of all texts but the last, each beside the one after it."""
    versions = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    changed = [digests(v) for v in versions]
    columns = [ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(v.encode()).hexdigest() for v in versions], fingerprint(own[:-1], cells), fingerprint(changed, cells), likeness(own[:-1], changed, cells), likeness(own[:-1], own[1:], cells)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DONE, strict=True)], schema=_DONE)


def _slices(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
            ids.append(i.as_py()), texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _walk(cells: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        edge = lambda name, i, t: pa.RecordBatch.from_pylist([{"id": i, "part": part, "edge": name, "text": t}], _ROW)
        for ids, texts in _slices(batches, chars):
            own = [digests(t) for t in texts]
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
            if len(ids) > 1:
                done = _rows(ids, texts, own, cells)
                rest = [pa.nulls(done.num_rows, f.type) for f in list(_ROW)[len(_DONE) :]]
                yield pa.RecordBatch.from_arrays([*done.columns, *rest], schema=_ROW)
            held = ids[-1], texts[-1], own[-1]
        if held is not None:
            yield edge("last", held[0], held[1])

    return run


def _pairs(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "after")), strict=True):
                yield _rows([i, None], [a, b], [digests(a), digests(b)], cells)

    return run


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, chars: int = SLICE) -> DataFrame:
    """(id, n_chars, edited_sha256, fp, efp, near_edited, near_next) for each input row, beside the next one by id.

    The edited text is the row's with its last half replaced by the beginning of the next row's text; the last row's
    next is the first one, a lone row's is itself. fp and efp are the sketches of both texts as bytes, near_* the
    shares of pieces in common with the edited and the next text. Null texts are empty; texts without pieces are alike
    (1.0). Null ids come first; rows that share an id follow each other by hash and text, each a row of its own. Very
    long texts are compared whole, one or a few at a time. An empty table gives no rows. Other columns are left out,
    whatever their names.
    """
    order = [F.asc_nulls_first("id"), F.asc("h"), F.asc_nulls_first("text")]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).drop("h")
    found = written(dealt.mapInArrow(_walk(cells, chars), _DDL + ", part int, edge string, text string"), "versions")
    done = found.where("edge is null").drop("part", "edge", "text")
    first = found.where("edge = 'first'").select(F.col("part").alias("to"), F.col("text").alias("after"))
    last = found.where("edge = 'last'").select("id", "text", "part")
    after = F.lead("part").over(Window.orderBy("part"))  # one row a task
    parts = found.where("edge = 'first'").select("part").withColumn("next", after)
    least = found.where("edge = 'first'").agg(F.min("part").alias("least"))
    follows = parts.crossJoin(F.broadcast(least)).select(F.col("part").alias("of"), F.coalesce("next", "least").alias("to"))
    ends = last.join(follows.hint("merge"), F.col("part") == F.col("of")).join(first.hint("merge"), "to")
    return done.unionByName(ends.select("id", "text", "after").mapInArrow(_pairs(cells), _DDL))


def _compared(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable((b.slice(at, 64) for at in range(0, b.num_rows, 64)) for b in batches):
            a, b = ([digests(t or "") for t in batch.column(c).to_pylist()] for c in ("a", "b"))
            keys, row, side = differences(a, b, cells)
            lists = [[keys[(row == i) & (side == s)].view(np.int64) for i in range(len(a))] for s in (1, -1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int64())), pa.array(likeness(a, b, cells))], ["id", "only_a", "only_b", "likeness"])

    return run


def compare(pairs: DataFrame, id_col: str, a_col: str, b_col: str, cells: int = CELLS) -> DataFrame:
    """(id, only_a, only_b, likeness) of pairs of versions: the digests of the pieces that only one of them has.

    A null or empty version has no pieces; other columns are left out; repeated rows and null ids are rows of their own.
    """
    chosen = pairs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{a_col}`").alias("a"), F.col(f"`{b_col}`").alias("b"))
    return chosen.mapInArrow(_compared(cells), "id long, only_a array<long>, only_b array<long>, likeness double")


def op11_version_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.translate(F.base64("fp"), "\r\n", "").alias("fingerprint"), F.translate(F.base64("efp"), "\r\n", "").alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op11_version_sketch": op11_version_sketch}
