"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector binds its letters' vectors by multiplication, each
permuted by its place; a text's vector bundles (adds) those of its n-grams, and a language's prototype bundles those
of its texts. A document takes the language whose prototype has the greatest cosine with it.

Vectors come from a seed and the letter alone, so each Python worker derives the same ones. Prototypes are learned
from a bounded sample for each language; a document is scored over its whole text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.shared import table

DIM, N, SEED = 1024, 3, 7
#: Documents for each language that prototypes are learned from, the first by a hash of their id.
SAMPLE = 1500
#: Languages that prototypes may be held for; more is an error.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: N-gram vectors that a worker keeps, and characters handled at once.
_KEEP, _PART = 12_000, 1 << 20
_FIELD = 21  # bits of a code point


class Binder:
    """N-gram vectors, made when first met and kept up to a bound."""

    def __init__(self, dim: int = DIM, n: int = N, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self._letters: dict[int, np.ndarray] = {}
        self._is_letter: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, np.int64)
        self._rows = np.zeros(0, np.int64)
        self._vectors = np.zeros((1024, self.dim), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim)
            self._letters[code] = (2 * bits - 1).astype(np.float32)
        return self._letters[code]

    def ngram(self, key: int) -> np.ndarray:
        out = np.ones(self.dim, np.float32)
        for place in range(self.n):
            code = key >> (_FIELD * (self.n - 1 - place)) & ((1 << _FIELD) - 1)
            out *= np.roll(self.letter(code), self.n - 1 - place)
        return out

    def _vectors_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._keys, keys)
        known = (at < len(self._keys)) & (self._keys[np.minimum(at, len(self._keys) - 1)] == keys) if len(self._keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = keys[~known]
            if len(self._keys) + len(new) > _KEEP:
                if len(keys) > _KEEP // 2:
                    return np.stack([self.ngram(int(k)) for k in keys])
                self._clear()
                new = keys
            start = len(self._keys)
            while start + len(new) > len(self._vectors):
                self._vectors = np.concatenate([self._vectors, np.zeros_like(self._vectors)])
            for i, k in enumerate(new):
                self._vectors[start + i] = self.ngram(int(k))
            merged = np.concatenate([self._keys, new])
            order = np.argsort(merged, kind="stable")
            self._keys, self._rows = merged[order], np.concatenate([self._rows, np.arange(start, start + len(new))])[order]
            at = np.searchsorted(self._keys, keys)
        return self._vectors[self._rows[at]]

    def _coded(self, text: str) -> np.ndarray:
        """Code points of the letters, a space for anything else."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        for c in kinds:
            if int(c) not in self._is_letter:
                self._is_letter[int(c)] = chr(c).isalpha()
        letter = np.array([self._is_letter[int(c)] for c in kinds], bool)[back] if len(kinds) else np.zeros(0, bool)
        return np.where(letter, points, 32).astype(np.int64)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the n-gram vectors of a whole text in lower case; None if it is null or has no letter.

        Anything between letters is one space, and one stands at either end. Long texts are read in parts that take
        over the last n - 1 codes, so no n-gram is cut or made at a border.
        """
        text = (text or "").lower()
        total, any_letter, held = np.zeros(self.dim, np.float64), False, np.array([32], np.int64)
        for at in range(0, len(text), _PART):
            last = at + _PART >= len(text)
            codes = np.concatenate([held, self._coded(text[at : at + _PART]), np.full(int(last), 32)])
            codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
            any_letter = any_letter or bool(codes.max() > 32)
            if len(codes) >= self.n:
                keys = codes[: len(codes) - self.n + 1].copy()
                for place in range(1, self.n):
                    keys = keys << _FIELD | codes[place : len(codes) - self.n + 1 + place]
                keys, counts = np.unique(keys, return_counts=True)
                for part in range(0, len(keys), 4096):
                    total += counts[part : part + 4096].astype(np.float32) @ self._vectors_of(keys[part : part + 4096])
            held = codes[-(self.n - 1) :] if self.n > 1 else codes[:0]
        return total if any_letter else None


def _unit(vector: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vector)
    return vector / size if size else vector


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dim: int = DIM, n: int = N, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language in the rows that train selects.

    At most ``sample`` ids for a language are read, the first by a hash of the id (ties of the hash by id). What comes
    to the driver is one vector for each language. Rows with a null id or language or a text without letters teach
    nothing. An id with several languages teaches each text to its own; rows that repeat an id and a language count as
    one id of the sample and teach together. An empty table gives no prototypes.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang")).where("id is not null").distinct()
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError("too many languages to hold a prototype of each")
    # rows whose hash is low enough for about twice the sample of their language: what is ranked is bounded
    low = F.lit(False)
    for r in counts:
        low = low | ((F.col("lang") == r["lang"]) & (F.xxhash64("id").cast("double") <= -(2.0**63) + 2.0**64 * min(1.0, 2 * sample / r["count"])))
    first = rows.where(low).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("rank") <= sample)
    chosen = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    texts = chosen.join(F.broadcast(first.select("id", "lang")), ["id", "lang"]).select("lang", "text")  # sample rows a language at most

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder, found = Binder(dim, n, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = binder.bundle(text.as_py())
                if vector is not None:
                    found[lang] = found.get(lang, 0) + _unit(vector)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    parts = texts.mapInArrow(bundled, "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("vector"))
    return {r["lang"]: _unit(np.array([p["x"] for p in r["vector"]])) for r in whole.collect()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, n: int = N, seed: int = SEED) -> DataFrame:
    """(id, lang_pred, score) of each row: the language of the greatest cosine (ties to the first by name), cosine in 0 to 1.

    Null texts, texts without a letter and all texts when nothing was learned are ``und`` with score 0. Every row
    gives one row, repeated or not; very long texts are read whole, a part at a time; other columns are ignored; an
    empty table gives no rows.
    """
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]) if langs else np.zeros((0, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder = Binder(dim, n, seed)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                vector = binder.bundle(text.as_py()) if langs else None
                if vector is None:
                    names.append(UNKNOWN), scores.append(0.0)
                else:
                    cosine = matrix @ _unit(vector)
                    best = int(np.argmax(cosine))
                    names.append(langs[best]), scores.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    prototypes = learn(docs, ~held_out)
    found = predict(docs, prototypes).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language": op10_language}
