import hashlib
import itertools
import random
import re
import zlib

import pytest

from factgraph.llm import conversation_repair as C

SCHEMA = "text string, conv_id long, turn long, role string, cost int, of string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    out = []
    for n, (_, role, text) in enumerate(rows):
        words = text.strip(SPACE)
        out.append("blank" if not words else "duplicate" if (role, text) in [(r, t) for _, r, t in rows[:n]] else "truncated" if words[-1] not in ".!?" else "")
    return out


def cheapest(rows):
    """(cost, audit, lines) over every way to edit the rows, insertions of up to two before each row and at the end."""
    kinds = faults(rows)
    ins = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    ways = []
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        extra = 1 if kind == "truncated" else 0
        own = [(3, "D", None)]
        if kind not in ("blank", "duplicate"):
            own += [(extra, "K", (role, text)), (2 + extra, "R", ("user", text)), (2 + extra, "R", ("assistant", text))]
        ways.append([(2 * len(i) + c, "I" * len(i) + e, [(r, "") for r in i] + ([x] if x else [])) for i in ins for c, e, x in own])
    ways.append([(2 * len(i), "I" * len(i), [(r, "") for r in i]) for i in ins])
    best = None
    for chosen in itertools.product(*ways):
        lines = [x for w in chosen for x in w[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) and all(r for r, _ in lines):
            found = (sum(w[0] for w in chosen), "".join(w[1] for w in chosen), "\n".join(f"{r}:{t}" for r, t in lines))
            best = found if best is None or found < best else best
    return best


def plain(rows):
    """One conversation's row, from rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def frame(spark, rows):
    return spark.createDataFrame([(x, c, t, r, 7, "y") for c, t, r, x in rows], SCHEMA)


def run(spark, rows, held=C.HELD):
    return {r["conv_id"]: tuple(r)[1:] for r in C.repair(frame(spark, rows), held=held).collect()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(13)
    rows = []
    for conv in range(120):
        for n in range(3 if conv % 12 else 4):
            turn = rng.choice([n, n, n, n + 2, None, 0])
            rows.append((conv or None, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(["Yes.", "No!", "Why", "", " \t", "ok. \n", None, "é?"])))
    return rows


def grouped(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


def test_same_as_all_edits(spark, talks):
    assert run(spark, talks) == {c: plain(rs) for c, rs in grouped(talks).items()}


def test_spilled_conversations_are_the_same(spark, talks):
    long = [(10**17 + 1, n, "user" if n % 3 else "assistant", f"text {n % 50}" + "." * (n % 2)) for n in range(300)]
    whole = run(spark, talks + long)
    assert run(spark, talks + long, 1) == whole
    assert run(spark, talks + long, 7) == whole


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b!") for c in (1, 2, None) for t in (*range(40), None)] + [(3, 0, None, None)]
    got = sorted(map(tuple, C.damaged(frame(spark, rows)).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, r, x = zlib.crc32(key.encode()) % 20, " " if r is None else r, " " if x is None else x
        if kind:
            row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
            want += [row] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)


def test_empty_and_lost_conversations(spark):
    assert run(spark, []) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = frame(spark, [(lost, 0, "user", "x.")])
    got = [tuple(r) for r in C.whole(rows, C.repair(C.damaged(rows))).collect()]
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repeats_across_turns_and_very_long_texts(spark):
    text = "word " * 200_000 + "."
    rows = [(1, 0, "user", text), (1, 1, "assistant", "Fine."), (1, 2, "user", text), (1, 2, "user", text), (1, 3, "assistant", "Well.")]
    assert run(spark, rows)[1][2] == 2 and run(spark, rows)[1] == plain([r[1:] for r in rows])
