import hashlib
import random
import unicodedata

import pytest

from factgraph.llm import bpe as B

tokenizers = pytest.importorskip("tokenizers")
PATH = B.default_path()


@pytest.fixture(scope="module")
def pair():
    return B.vocabulary(PATH), tokenizers.Tokenizer.from_file(PATH)


def same(pair, text):
    mine, theirs = pair
    want = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == want, text[:200]
    assert mine.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_every_code_point(pair):
    for at in range(0, 0x20000, 1):
        if unicodedata.category(chr(at)) not in ("Cn", "Cs"):  # what this Python's Unicode tables know
            same(pair, f"a{chr(at)}b {chr(at)}")


def test_edges(pair):
    for text in ("", " ", "It's we'll I'D 've 're''s", "a<|endoftext|>B <|startoftext|><|endoftext|", "ΑΣ ΣΑΣ. İstanbul ǅ ﬁ é é", "x" * 5000, "ab" * 3000, "!" * 4000, "é" * 3000, "1234567", "\x1c\x1d\x85  a", "aA1!‍👩‍👩‍👧", "日本語のテキスト" * 200):
        same(pair, text)


def test_random_words(pair):
    rng = random.Random(5)
    for letters in ("aeinrst", "abcdefghijklmnopqrstuvwxyz'", "aé ß€👍", "01. -#'", "theionrs"):
        for _ in range(400):
            same(pair, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))


def test_documents_and_edges_on_spark(spark):
    schema = "doc_id long, text string, id string, ids string"
    docs = spark.createDataFrame([(1, "Hello, World!", "a", ""), (1, "Hello, World!", "a", ""), (2, None, "b", ""), (None, "", "", ""), (3, "word " * 40_000, "", "")], schema)
    theirs = tokenizers.Tokenizer.from_file(PATH)
    got = sorted(B.round_trip(docs, PATH).collect(), key=repr)
    want = []
    for i, t, *_ in docs.collect():
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    back = B.decode(B.encode(docs, PATH), PATH).collect()
    assert sorted(((r["id"], r["text"]) for r in back), key=repr) == sorted(((i, theirs.decode(theirs.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in docs.collect()), key=repr)
    assert B.round_trip(spark.createDataFrame([], schema), PATH).count() == 0
