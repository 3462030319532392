"""Quality classifier learned by Bradley-Terry pairwise ranking.

A document's score is linear in its text features; the chance that a labelled-good document is preferred to a
labelled-bad one is the logistic of their score difference (Bradley-Terry), so weights are fitted by logistic loss on
feature differences of preference pairs. The cut is a quantile of the training scores: the share of bad labels. Raw
scores are mapped to 0..1 by a logistic curve that puts the cut at the threshold.

Features come from the whole text alone, in one pass without a shuffle. The fit uses a bounded, documented sample of
labelled rows; scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.shared import table

#: Labelled rows that the fit may read (the first by a hash of their id), and preference pairs drawn from them.
SAMPLE, PAIRS = 20_000, 60_000
THRESHOLD, RIDGE = 0.7, 1e-3
FEATURES = (
    "log_words", "letters", "upper", "digits", "space", "odd", "symbol_ends", "marks", "pipes", "caps_words",
    "distinct_words", "repeat_next", "top_word", "word_length", "word_spread", "line_length", "short_lines",
    "repeat_lines", "sentence_ends", "distinct_shapes", "long_words",
)
_TABLE = np.zeros(256, np.int64)
for _kind, _chars in enumerate((b"", bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"-()?", b"!", b"|"), 0):
    _TABLE[list(_chars)] = _kind
_PART = 1 << 22


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all are zero for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = len(raw)
    if not size:
        return [0.0] * len(FEATURES)
    kinds = np.zeros(8, np.int64)
    for at in range(0, size, _PART):
        kinds += np.bincount(_TABLE[np.frombuffer(raw[at : at + _PART], np.uint8)], minlength=8)
    odd, lower, upper, digits, space, stops, marks, pipes = (kinds / size).tolist()
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ends = sum(w[-1] in _SYMBOLS for w in words)
    caps = sum(1 for w in words if w.isupper())
    lines = raw.split(b"\n")
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    per_line = len(words) / len(lines)
    return [
        float(np.log1p(len(words))), lower + upper, upper / max(1e-9, lower + upper), digits, space, odd, ends / n, marks, pipes, caps / n,
        len(counts) / n ** 0.8, again / n, max(counts.values(), default=0) / n, float(np.minimum(lengths, 40).mean()) / 10,
        float(np.minimum(lengths, 40).std()) / 10, float(np.log1p(per_line)), sum(len(x) < 20 for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines), raw.count(b".") / n, stops, float((lengths > 25).mean()),
    ]


_SYMBOLS = frozenset(b"#$%&*@^~=+<>|_\\/!")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float = THRESHOLD

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, the threshold exactly at the cut."""
        offset = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + offset, -30, 30)))


def quantile_cut(raw: np.ndarray, good: np.ndarray) -> float:
    """The quantile of the scores at the share of bad labels, half-way between two scores so that none touches it.

    Where equal scores stand on both sides of the quantile they go together: up if half or more of them are good.
    """
    order = np.unique(raw)
    ranked, at = np.sort(raw), int((~good).sum())
    low, high = ranked[at - 1], ranked[at]
    if low == high:
        tied = np.searchsorted(order, low)
        if good[raw == low].mean() >= 0.5:
            low = order[tied - 1] if tied else low - 1.0
        else:
            high = order[tied + 1] if tied + 1 < len(order) else high + 1.0
    return float((low + high) / 2)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, threshold: float = THRESHOLD, seed: int = 11) -> Model:
    """Weights by logistic loss on the feature differences of (good, bad) pairs, by Newton steps; cut by quantile.

    With only one class there are no pairs: all weights are zero and every score is that class's side of the cut.
    """
    width = len(FEATURES)
    if not len(x) or good.all() or not good.any():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if len(x) and not good.any() else -1.0, 1.0, threshold)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    d = z[rng.choice(best, pairs)] - z[rng.choice(worst, pairs)]
    w = np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    cut = quantile_cut(raw, good)
    slope = 1.0 / max(1e-6, float(np.median(raw[good]) - np.median(raw[~good])) / 6)
    return Model(mean, scale, w, cut, slope, threshold)


def _featured(docs: DataFrame) -> DataFrame:
    """(id, good, x) of (id, good, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["id", "good", "x"])

    return docs.mapInArrow(run, "id long, good boolean, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Model of the labelled rows that train (a column on labels) selects.

    At most ``sample`` labels are used, the first by a hash of their id. Null ids and null labels teach nothing; an
    id labelled both ways counts as bad; of rows that share an id one counts. Very long texts are read whole. The
    driver gets the features of the sample only. Labels that tie by hash are taken by id. An empty labels table, or none
    that meets a document, gives the model of no examples: every score is on the good side.
    """
    rows = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    one = rows.groupBy(F.col(id_col).cast("long").alias("of")).agg((F.min(label_col) > 0).alias("good"))
    chosen = one.orderBy(F.xxhash64("of"), "of").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "good", "text")
    one_each = _featured(joined).groupBy("id").agg(F.min(F.struct("good", "x")).alias("row"))
    found = sorted((r["id"], r["row"]["good"], tuple(r["row"]["x"])) for r in one_each.collect())
    return fit(np.array([r[2] for r in found]).reshape(-1, len(FEATURES)), np.array([r[1] for r in found], bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, score) of each row, or all columns of docs as struct ``row`` and score. Null and empty texts are scored by their zero features.

    Every row gives one row, repeated or not, null ids too; very long texts are read whole; equal texts have equal
    scores; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], [batch.schema.names[0], "score"])

    if carry:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        return docs.select(row, F.col(text_col).alias("text")).mapInArrow(run, T.StructType().add("row", docs.schema).add("score", "double"))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is below the model's threshold; columns stay.

    Null and empty texts are judged by their zero features like any other; null ids and repeated rows stay or go by
    their text alone; an empty table gives no rows.
    """
    scored = score(docs, model, text_col=text_col, carry=True).where(F.col("score") >= model.threshold)
    return scored.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def train_rows(id_col: str = "doc_id") -> Column:
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), train_rows())
    found = score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
