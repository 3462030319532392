"""Benchmark decontamination with the q-gram lemma.

Texts are normalised (compatible forms unified, lower case, every run of other than letters and digits to one space,
typographic signs and spaces included) and benchmark items are cut into overlapping segments. A segment of n
characters matches where a region of the document is within its edit budget k; such a region shares at least
``n + 1 - q * (k + 1)`` q-grams with the segment, on at most k + 1 neighbouring diagonals. So a document's q-grams are
looked up among those of the distinct segments, hits are counted in overlapping diagonal bands, bands that reach the
bound are kept, and each is verified by a banded alignment. Hits are made in parts of a document that hold a bounded
number of them and overlap by more than a region, so repetitive texts cost time in proportion and no more memory.

Documents are read once for each block of the benchmark, without a shuffle. A block has a bounded number of q-grams
(``BLOCK_GRAMS``), so what is sent to the tasks and held on the driver does not grow with the benchmark, only the
number of blocks. A block's text is broadcast, and each Python worker makes its index once, for all tasks that it runs.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.shared import table, written

Q, SEGMENT, STRIDE, RATE = 12, 60, 20, 0.05
BAND = 8
#: q-grams of the segments of a block of benchmark, repeats included: about three for each character.
BLOCK_GRAMS = 20 << 20
#: Hits held at once, and characters whose q-grams are hashed at once.
_HITS, _PART = 1 << 20, 1 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
#: Signs of no width, and what is neither ASCII nor a letter or digit.
_NOTHING, _SIGNS = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]"), re.compile(r"[^\w\x00-\x7f]+")


def normalised(text: str | None) -> str:
    text = text or ""
    if not text.isascii():
        text = _SIGNS.sub(" ", _NOTHING.sub("", unicodedata.normalize("NFKC", text)))
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()).decode("utf-8", "surrogatepass")


def codes(raw: str) -> np.ndarray:
    return np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_hashes(raw: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of each q-gram of code points, built from powers of two of its length."""
    if len(raw) < q:
        return np.zeros(0, np.uint64)
    level = raw.astype(np.uint64) + np.uint64(1)
    n, size, base, out, done = len(raw) - q + 1, 1, _BASE, None, 0
    scale = 1
    while True:
        if q & size:
            part = level[done : done + n]
            out = part * np.uint64(scale) if out is None else out + part * np.uint64(scale)
            done += size
            scale = scale * base & _MASK
        if size * 2 > q:
            break
        level = level[:-size] + level[size:] * np.uint64(base)
        size, base = size * 2, base * base & _MASK
    return out ^ (out >> np.uint64(29))


class Index:
    """q-grams of the distinct segments of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, segment: int = SEGMENT, stride: int = STRIDE, rate: float = RATE):
        self.q, self.ids = q, [i for i, _ in items]
        number: dict[str, int] = {}
        self.count: list[int] = []  # segments of each item
        self.uses: list[list[int]] = []  # items of each distinct segment, as often as it stands in them
        for n, (_, text) in enumerate(items):
            raw = normalised(text)
            size = min(segment, len(raw))
            last = len(raw) - size
            starts = sorted({*range(0, last + 1, stride), last}) if size >= q else []
            for s in starts:
                k = number.setdefault(raw[s : s + size], len(number))
                if k == len(self.uses):
                    self.uses.append([])
                self.uses[k].append(n)
            self.count.append(len(starts))
        self.segments = list(number)
        sizes = np.array([len(t) for t in self.segments], np.int64)
        self.budget = np.maximum(0, np.minimum((rate * sizes).astype(np.int64), (sizes - q) // q))
        self.bound = sizes + 1 - q * (self.budget + 1)
        self.slack = int(self.budget.max(initial=0))
        self.reach = int(sizes.max(initial=0)) + BAND + 2 * self.slack
        lengths = np.maximum(0, sizes - q + 1)
        h = np.empty(int(lengths.sum()), np.uint64)
        ends = np.cumsum(lengths)
        for t, a, b in zip(self.segments, ends - lengths, ends, strict=True):
            h[a:b] = qgram_hashes(codes(t), q)
        order = np.argsort(h, kind="stable")  # by q-gram, then segment and place
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), lengths)[order]
        self.at = (order - (ends - lengths)[of]).astype(np.int16 if segment < 1 << 15 else np.int64)
        h = h[order]
        del order
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        self.keys = h[new]
        del h
        self.entry = np.cumsum(new) - 1  # ascending: by q-gram, then segment
        self.entry *= max(1, len(sizes))
        self.entry += of
        # one bit for each of 64 to 128 places a q-gram
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.keys)) * 64))))
        self._shift = np.uint64(64 - bits)
        place = self.keys >> self._shift
        self._seen = np.zeros(1 << bits - 3, np.uint8)
        np.bitwise_or.at(self._seen, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def _places(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of its q-gram) where a text has a q-gram of the segments."""
        out = []
        for a in range(0, max(1, len(raw) - self.q + 1), _PART):
            h = qgram_hashes(raw[a : a + _PART + self.q - 1], self.q)
            place = h >> self._shift
            p = np.flatnonzero(self._seen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            key = np.searchsorted(self.keys, h[p])
            good = key < len(self.keys)
            good[good] = self.keys[key[good]] == h[p][good]
            out.append((p[good] + a, key[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _bands(self, p: np.ndarray, key: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
        """(segment, band) of segments low to high with enough hits at the places; halves the segments while there are too many hits."""
        every = max(1, len(self.segments))
        first = np.searchsorted(self.entry, key * every + low)
        n = np.searchsorted(self.entry, key * every + high) - first
        total = int(n.sum())
        if total > _HITS and high - low > 1:
            middle = (low + high) // 2
            yield from self._bands(p, key, low, middle)
            yield from self._bands(p, key, middle, high)
            return
        if not total:
            return
        slot = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
        of = self.entry[slot] - np.repeat(key, n) * every
        diagonal = np.repeat(p, n) - self.at[slot] + self.reach  # never negative
        band = diagonal // BAND
        again = diagonal - band * BAND < self.slack  # bands overlap by the budget
        wide = int(band.max()) + 2
        both = np.r_[of * wide + band + 1, of[again] * wide + band[again]]
        found, hits = np.unique(both, return_counts=True)
        of, band = found // wide, found % wide - 1
        enough = hits >= self.bound[of]
        yield from zip(of[enough].tolist(), band[enough].tolist(), strict=True)

    def found(self, raw: str) -> Iterator[tuple[int, int, int, int]]:
        """(segment, edits, start, end) of regions within the budget, in a normalised text; a segment once found literally is not looked for again."""
        p, key = self._places(codes(raw))
        if not len(p):
            return
        every = max(1, len(self.segments))
        load = np.cumsum(np.searchsorted(self.entry, (key + 1) * every) - np.searchsorted(self.entry, key * every))
        exact: set[int] = set()
        aligned: dict[tuple[int, str], tuple[int, int]] = {}
        a = 0
        while a < len(p):  # a part: a bounded number of hits, or four regions long
            b = int(np.searchsorted(load, (load[a - 1] if a else 0) + _HITS, "right"))
            b = max(b, int(np.searchsorted(p, p[a] + 4 * self.reach)))
            for k, band in self._bands(p[a:b], key[a:b], 0, every):
                if k in exact:
                    continue
                segment, budget = self.segments[k], int(self.budget[k])
                diagonal = band * BAND - self.reach
                begin = max(0, diagonal - budget)
                region = raw[begin : max(0, diagonal + len(segment) + BAND + 2 * budget)]
                if (k, region) not in aligned:
                    if len(aligned) > 100_000:
                        aligned.clear()
                    aligned[k, region] = banded(segment, region, budget)
                edits, end = aligned[k, region]
                if edits <= budget:
                    if edits == 0:
                        exact.add(k)
                    yield k, edits, begin + max(0, end - len(segment)), begin + end
            # the next part begins early enough to hold whole what this one cut
            a = max(a + 1, int(np.searchsorted(p, p[b] - 2 * self.reach))) if b < len(p) else b

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int, int]]:
        """(item number, segments found, segments, least edits, start, end) of each item found in a whole text.

        Places are characters of the normalised text: of each segment the region with the least edits, the first of
        these; start and end are the least and greatest of the item's segments.
        """
        best: dict[int, tuple[int, int, int]] = {}
        for k, *region in self.found(normalised(text)):
            best[k] = min(best.get(k, tuple(region)), tuple(region))
        items: dict[int, list[tuple[int, int, int]]] = {}
        for k, region in best.items():
            for n in self.uses[k]:
                items.setdefault(n, []).append(region)
        return [(n, len(v), self.count[n], min(e for e, *_ in v), min(b for _, b, _ in v), max(c for *_, c in v)) for n, v in sorted(items.items())]

    def any(self, text: str | None) -> bool:
        return next(self.found(normalised(text)), None) is not None


def banded(segment: str, region: str, budget: int) -> tuple[int, int]:
    """(edits, end in region) of the best alignment of the whole segment to any part of the region, or budget + 1.

    Only cells that can still end within the budget are kept, so each row of the table is a band.
    """
    at = region.find(segment)
    if at >= 0:
        return 0, at + len(segment)
    over, n = budget + 1, len(region)
    row = [0] * (n + 1)
    low, high = 0, n
    for i, c in enumerate(segment, 1):
        new = [over] * (n + 1)
        if low == 0:
            new[0] = min(over, i)
        next_low, next_high = (0 if new[0] <= budget else n + 1), -1
        for j in range(max(1, low), min(n, high + budget + 1) + 1):
            v = row[j - 1] + (region[j - 1] != c)
            if row[j] < v:
                v = row[j] + 1
            if new[j - 1] < v:
                v = new[j - 1] + 1
            if v <= budget:
                new[j] = v
                next_low, next_high = min(next_low, j), j
            elif j > high + 1 and new[j - 1] > budget:
                break
        if next_high < 0 and new[0] > budget:
            return over, 0
        row, low, high = new, next_low, max(next_high, 0)
    best = min(range(n + 1), key=lambda j: row[j])
    return row[best], best


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


def n_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> int:
    total = _items(benchmark, id_col, text_col).agg(F.sum(F.char_length("text"))).first()[0] or 0
    return max(1, -(-total * (SEGMENT - Q + 1) // (STRIDE * BLOCK_GRAMS)))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in n blocks: one at a time comes to the driver. Null ids and texts are left out."""
    items = _items(benchmark, id_col, text_col)
    for b in range(n):
        found = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).distinct().collect()
        if found:
            yield sorted((r["id"], r["text"]) for r in found)


#: The index that a worker holds, under the name of its block: the one used last.
_HELD: dict[str, Index] = {}
#: Indexes made by a worker so far.
made = 0


def held(name: str, items: Callable[[], list[tuple[int, str]]]) -> Index:
    """Index of a block, made once a worker while the block stays the same."""
    global made
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Index(items())
        made += 1
    return _HELD[name]


def _sent(spark: SparkSession, items: list[tuple[int, str]]):
    """What gives a task its index: the block is broadcast, its size is bounded by BLOCK_GRAMS."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(items)
    return lambda: held(name, lambda: sent.value)


def _reports(index_of: Callable[[], Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            rows = [(i, index.ids[m[0]], *m[1:]) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in index.matches(text.as_py())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item_id", "n_found", "n_segments", "edits", "begin", "end"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_found, n_segments, edits, begin, end): items whose segments a document holds, with the segments found, the least edits and the place.

    Every passage of ``SEGMENT + STRIDE - 1`` normalised characters of an item holds a whole segment. Items with
    fewer than q normalised characters can't be told from chance and match nothing; shorter segments get the budget
    that the lemma allows. Null and empty texts match nothing; very long and repetitive ones are read whole, in
    bounded memory; a null id is reported as null; repeated rows report again; items that share an id report apart.
    An empty table on either side gives no rows. With several blocks of benchmark each block's matches are written
    before the next is read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, n_found long, n_segments long, edits long, begin long, end long"
    n = n_blocks(benchmark, item_col, item_text)
    found = []
    for items in blocks(benchmark, item_col, item_text, n):
        here = source.mapInArrow(_reports(_sent(docs.sparkSession, items)), schema)
        found.append(written(here, "matches") if n > 1 else here)
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def _clean(index_of: Callable[[], Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            stay = pa.array([not index.any(t.as_py()) for t in batch.column(1)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(stay)], ["row"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows in which ``find`` finds an item; all columns stay.

    Rows with null or empty texts or null ids stay, repeated rows stay or go together, and with an empty benchmark all
    stay. With several blocks of benchmark what a block leaves is written before the next is read.
    """
    n, out = n_blocks(benchmark, item_col, item_text), docs
    for items in blocks(benchmark, item_col, item_text, n):
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        kept = out.select(row, F.col(text_col).alias("text")).mapInArrow(_clean(_sent(docs.sparkSession, items)), T.StructType().add("row", docs.schema))
        kept = kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
        out = written(kept, "clean") if n > 1 else kept
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_decontaminate": op4_decontaminate}
