"""BPE encoding by backtracking over longest matches, decoding by an offset table.

Encoding a pre-token walks an Aho-Corasick automaton over the vocabulary to the longest token at each place, and
keeps a token only if it is compatible with the token before it: the pair must be what BPE itself would leave side
by side (no merge of lower rank across their border). When no token fits, the last one is taken back and its next
shorter prefix is tried; places from which no encoding is possible are remembered, so a pre-token takes linear time.
The result is exactly that of applying merges in rank order. Decoding slices one buffer of all token strings.

The vocabulary file is a parameter; it is read once in each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.shared import table

#: White space and pre-token patterns of the vocabulary's own pipeline.
_WHITE = regex.compile(r"[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s0-9a-z]+", re.ASCII)
_END = 0x10000  # added to the last character of a pre-token: it is a symbol of its own
#: Bounds of a worker's memory of words already encoded.
_CACHE_WORDS, _CACHE_LENGTH = 200_000, 64
#: Pairs that the compatibility table may hold before it is filled anew, and rows whose results are held at once.
_CACHE_PAIRS, _ROWS = 1 << 18, 1024


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, the match automaton, the pair-compatibility test and the decoder's offset table of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._symbols = byte_symbols()
        self._table = str.maketrans({b: s for b, s in self._symbols.items() if chr(b) != s})
        ids = dict(model["vocab"]) | self.special
        size = max(ids.values()) + 1
        names = [""] * size
        for name, i in ids.items():
            names[i] = name
        self._buffer = "".join(names)
        self._offsets = [0]
        for name in names:
            self._offsets.append(self._offsets[-1] + len(name))

        def packed(name: str) -> str:
            """Token as a string of symbols; a word end is folded into its last symbol."""
            return name[: -len(suffix) - 1] + chr(ord(name[-len(suffix) - 1]) + _END) if suffix and name.endswith(suffix) and len(name) > len(suffix) else name

        self._id = {packed(name): i for name, i in model["vocab"].items()}
        self._name = {i: name for name, i in self._id.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = model["vocab"][a], model["vocab"][b]
            made = self._id[packed(a + b)]
            self._merge.setdefault((left, right), (rank, made))
            self._halves.setdefault(made, (left, right))
        self._rank_of = {made: self._merge[pair][0] for made, pair in self._halves.items()}
        self._fits: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._reachable = reachable = {name: i for name, i in self._id.items() if len(name) == 1 or self._whole(i)}
        for name, i in reachable.items():  # the next shorter token that starts the same way
            for n in range(len(name) - 1, 0, -1):
                if name[:n] in reachable:
                    self._shorter[i] = reachable[name[:n]]
                    break
        matcher = ahocorasick.Automaton()
        for name, i in reachable.items():
            matcher.add_word(name, i)
        matcher.make_automaton()
        self._longest = matcher.iter_long
        self._size = [len(self._name.get(i, "")) for i in range(size)]
        # words seen of late, and those of the time before
        self._words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _whole(self, token: int) -> bool:
        """Whether BPE makes this token from its own symbols."""
        return token in self._halves and self._apply_merges(self._name[token]) == [token]

    def _apply_merges(self, symbols: str) -> list[int]:
        """Merges in rank order, for single tokens when the vocabulary is read."""
        ids = [self._id[s] for s in symbols]
        while len(ids) > 1:
            best = min(((self._merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self._merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self._merge[ids[k], ids[k + 1]][1]]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as pairs turn up: may BPE leave these two tokens side by side?

        Both tokens are taken apart, latest merge first; the pair is wrong once a merge across the border would have
        come before the merge just undone.
        """
        a, b, limit, good = left, right, 1 << 60, True
        while True:
            across = self._merge.get((a, b))
            if across is not None and across[0] < limit:
                good = False
                break
            rank_a, rank_b = self._rank_of.get(a, -1), self._rank_of.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:  # the right end of a was made last
                limit, a = rank_a, self._halves[a][1]
            else:
                limit, b = rank_b + 1, self._halves[b][0]
        if len(self._fits) >= _CACHE_PAIRS:
            self._fits.clear()
        self._fits[left << 20 | right] = good
        return good

    def encode_symbols(self, word: str) -> list[int]:
        """Tokens of one pre-token, given as symbols with the word end folded into the last."""
        if (whole := self._reachable.get(word)) is not None:
            return [whole]
        n, longest, sizes, table = len(word), self._longest, self._size, self._fits
        blocked: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, next(longest(word))[1]
        while True:
            size = sizes[token]
            if at + size not in blocked:
                if last < 0:
                    good = True
                elif (good := table.get(last << 20 | token)) is None:
                    good = self.fits(last, token)
                if good:
                    out.append(token)
                    at += size
                    if at == n:
                        return out
                    last, token = token, next(longest(word, at))[1]
                    continue
            shorter = self._shorter.get(token)
            while shorter is None:  # nothing fits from here: take the last token back
                blocked.add(at)
                taken = out.pop()
                at -= sizes[taken]
                last = out[-1] if out else -1
                shorter = self._shorter.get(taken)
            token = shorter

    def encode_word(self, word: str) -> tuple[int, ...]:
        known = self._words.get(word) or self._older.get(word)
        if known is None:
            symbols = word.translate(self._table) if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self._table)
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END)
            known = tuple(self.encode_symbols(symbols))
        if len(word) <= _CACHE_LENGTH:
            if len(self._words) >= _CACHE_WORDS:
                self._older = dict(self._words)
                self._words.clear()
            self._words[word] = known
        return known

    def _plain(self, text: str, out: list[int]) -> None:
        known = self._words
        if text.isascii():
            words = _ASCII_WORDS.findall(text.lower())
        else:
            text = _WHITE.sub(" ", unicodedata.normalize("NFC", text))
            words = _WORDS.findall(text.replace("Σ", "σ").lower())
        for w in words:
            out.extend(known.get(w) or self.encode_word(w))

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; strings of special tokens in the text become those tokens."""
        out: list[int] = []
        if not text:
            return out
        if "<|" in text and self.special:
            for part in re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    self._plain(part, out)
        else:
            self._plain(text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings one after the other, joined by a space: the file names no decoder, so word ends stay."""
        buffer, offsets = self._buffer, self._offsets
        return " ".join([buffer[offsets[i] : offsets[i + 1]] for i in ids])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of each whole text; a null text is empty and gives an empty list. No shuffle.

    Every row gives one row, repeated or not, null ids too; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            ids = pa.array([known.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids); null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            text = pa.array([known.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): encoding and decoding of each whole text in one pass.

    A null text is empty; empty texts have no tokens and the digests of an empty string. Every row gives one row,
    repeated or not, null ids too; other columns are ignored; an empty table gives no rows. A very long text takes
    memory in proportion to its tokens, others are held a thousand rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            out: list[list] = [[], [], [], []]
            for text in batch.column(1):
                ids = known.encode(text.as_py())
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(known.decode(ids).encode("utf-8")).hexdigest())
                if with_ids:
                    out[3].append(np.array(ids, np.int32))
            cols = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(out[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path()).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_bpe": op9_bpe}
