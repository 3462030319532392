"""Repair of conversation structure: the cheapest edits that make the roles of a conversation alternate.

Rows are repartitioned by conversation and sorted by turn. A task walks them once, over Arrow batches, with the state
of a shortest-path search over four places in the pattern (nothing yet, after the system turn, after a user, after an
assistant) and one byte a row and place to trace the way back. A conversation that ends within ``HELD`` rows is finished
on the spot. A longer one is spilled: its rows and back pointers leave in chunks, as rows of the written table, and are
traced from the last chunk to the first and then hashed from the first to the last by two more walks of the same kind,
so that no task ever holds more than a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.shared import SPACES, table, written

#: Rows of a conversation, and characters of them, that a task holds before it spills them as a chunk.
HELD, HELD_CHARS = 4096, 4_000_000
#: Places in the pattern; a conversation may end at the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of an edit, and what leaving a truncated row in adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 60


@cache
def _inserted(place: int) -> list[tuple[int, int]]:
    """(number of inserted rows, place after them); two at most, as a third would only come back to where one leads."""
    out, at = [(0, place)], place
    for n in (1, 2):
        at = _NEXT[at, "a" if at == USER else "u"]
        if at != place:
            out.append((n, at))
    return out


@cache
def _moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, str, int]]:
    """(from, to, cost, edits, code) of every way to pass one row: insertions before it, then keep, rerole or delete."""
    out = []
    for place in range(4):
        for n, at in _inserted(place):
            ways = [("D", at, DELETE)]
            if not must_go:
                extra = TRUNCATED if truncated else 0
                kept = _NEXT.get((at, initial))
                ways += [("K", kept, extra)] if kept is not None else []
                ways += [("R", _NEXT[at, role], REROLE + extra) for role in "ua" if (at, role) in _NEXT]
            out += [(place, to, INSERT * n + cost, "I" * n + edit, place | n << 2 | "DKR".index(edit) << 4) for edit, to, cost in ways]
    return out


class Search:
    """Cheapest edits up to the row read last, for each place: cost and rank of the edit strings by ASCII order.

    No edit string is kept: strings that pass the same rows and end with a row's edit are no beginnings of each other
    (two such places never have equal ones), so the order of the longer strings follows from the ranks and what is added.
    """

    def __init__(self) -> None:
        self.cost = [0, _NEVER, _NEVER, _NEVER]
        self.rank = [0, 0, 0, 0]

    def row(self, initial: str, must_go: bool, truncated: bool) -> bytes:
        """Takes in a row; one byte for each place: the place before, the number of insertions and the edit."""
        best: list = [None] * 4
        for place, to, cost, edits, code in _moves(initial, must_go, truncated):
            total = self.cost[place] + cost
            if total < _NEVER:
                found = (total, self.rank[place], edits, code)
                if best[to] is None or found < best[to]:
                    best[to] = found
        order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        for n, (_, _, to) in enumerate(order):
            self.rank[to] = n
        self.cost = [b[0] if b else _NEVER for b in best]
        return bytes(b[3] if b else 255 for b in best)

    def end(self) -> tuple[int, int, int]:
        """(cost, place, insertions after the last row) of the cheapest whole repair."""
        ways = [(self.cost[place] + INSERT * n, self.rank[place], "I" * n, place) for place in range(4) for n, at in _inserted(place) if at in (START, ASSISTANT)]
        cost, _, tail, place = min(w for w in ways if w[0] < _NEVER)
        return cost, place, len(tail)


def trace(back: bytes, place: int) -> tuple[list[str], int]:
    """Edits of a run of rows that ends at a place, a string for each row (insertions before it first), and the place before."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        code = back[at + place]
        out.append("I" * (code >> 2 & 3) + "DKR"[code >> 4])
        place = code & 3
    return out[::-1], place


def repaired(edits: list[str], tail: int, roles: list[str], texts: list[str], place: int) -> tuple[list[str], int]:
    """``role:text`` lines after edits of rows from a place on, and ``tail`` insertions; the place reached."""
    out = []

    def put(text: str) -> None:
        nonlocal place
        place = _NEXT[place, "a" if place == USER else "u"]
        out.append(f"{_NAMES[place]}:{text}")

    for edit, role, text in zip(edits, roles, texts, strict=True):
        for _ in edit[:-1]:
            put("")
        if edit[-1] == "R":
            put(text)
        elif edit[-1] == "K":
            place = _NEXT[place, role[:1]]
            out.append(f"{role}:{text}")
    for _ in range(tail):
        put("")
    return out, place


class _Conversation:
    """What a task knows of the conversation that it reads: counts, the search, and the rows since the last chunk."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.search, self.chunk, self.chars = conv, Search(), 0, 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.turn = self.last = None
        self.rows: list[tuple[str, str]] = []
        self.back = bytearray()

    def take(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        words = text.strip(SPACES)
        seen = seen or self.last == (turn, role, text)
        fault = "blank" if not words else "duplicate" if seen else "truncated" if words[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None:
            self.counts["turns"] += turn != self.turn  # rows come by turn
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
        self.back += self.search.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        self.rows.append((role, text))
        self.last, self.chars = (turn, role, text), self.chars + len(text) + len(role)

    def full(self, held: int) -> bool:
        return len(self.rows) >= held or self.chars > HELD_CHARS

    def out(self, done: bool) -> dict:
        """The finished conversation, or the chunk that leaves: the last chunk carries the counts and the end of the search."""
        row: dict = {"conv_id": self.conv, "chunk": self.chunk}
        if done:
            turns = self.counts.pop("turns")
            cost, place, tail = self.search.end()
            row |= self.counts | {"gaps": 0 if self.least is None else self.most - self.least + 1 - turns, "cost": cost}
            if not self.chunk:
                edits, before = trace(bytes(self.back), place)
                lines, _ = repaired(edits, tail, *(list(c) for c in zip(*self.rows, strict=True)), before)
                return row | {"audit": "".join(edits) + "I" * tail, "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()}
            row |= {"place": place, "tail": tail}
        row |= {"back": bytes(self.back), "roles": [r for r, _ in self.rows], "texts": [t for _, t in self.rows]}
        self.rows, self.back, self.chars, self.chunk = [], bytearray(), 0, self.chunk + 1
        return row


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WALKED = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string, chunk long, place int, tail int, back binary, roles array<string>, texts array<string>"
_WALKED_NAMES = [f.split(" ")[0] for f in _WALKED.split(", ")]


def _number(x: str | None) -> int | None:
    """Numbers come to pandas as text, as columns with nulls would be floats there."""
    return None if x is None else int(x)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in _WALKED_NAMES})


def _walk(held: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Conversation | None = None
        for frame in frames:
            out = []
            for conv, turn, role, text, seen in frame.itertuples(index=False):
                conv, turn = _number(conv), _number(turn)
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.out(True))
                    now = _Conversation(conv)
                if now.full(held):
                    yield _frame([*out, now.out(False)])
                    out = []
                now.take(turn, role, text, bool(seen))
                if len(out) >= 512:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame([now.out(True)])

    return run


def _backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of each chunk of spilled conversations, chunks from the last to the first: the place is carried over."""
    conv, place = object(), 0
    for frame in frames:
        out = []
        for c, chunk, back, end, tail in frame.itertuples(index=False):
            c = _number(c)
            if c != conv:
                conv, place, tail = c, int(end), int(tail)
            else:
                tail = 0
            edits, place = trace(bytes(back), place)
            out.append((c, int(chunk), edits, tail))
        yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(("of", "at", "edits", "after"))})


def _forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and edits of each spilled conversation, from its rows and their edits in order: the digest is carried on."""
    now, place, digest, parts, lines = None, START, hashlib.sha256(), [], 0

    def done() -> pd.DataFrame:
        return pd.DataFrame({"of": pd.Series(now, dtype=object), "audit": ["".join(parts)], "repaired_sha256": [digest.hexdigest()]})

    for frame in frames:
        for conv, edit, tail, role, text in frame.itertuples(index=False):
            if now != [_number(conv)]:
                if now is not None:
                    yield done()
                now, place, digest, parts, lines = [_number(conv)], START, hashlib.sha256(), [], 0
            found, place = repaired([edit], int(tail), [role], [text], place)
            for line in found:
                digest.update(("\n" * bool(lines) + line).encode("utf-8", "surrogatepass"))
                lines += 1
            parts.append(edit + "I" * int(tail))
    if now is not None:
        yield done()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 names; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("r"))
    kept = rows.select("conv_id", "turn", blank("role").alias("r"), blank("text").alias("t"), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation with rows.

    Rows go by turn, nulls first, rows of one turn by role and text. Whether a role and text were seen in an earlier
    turn is told by an aggregation over their hashes, so no task remembers a conversation's texts. Null roles and texts
    are one space; a role whose first letter is not s, u or a can't be kept. Rows with a null conversation are one
    conversation. Repeated rows are duplicates. Very long texts are walked one by one. Conversations of any length are
    walked by one task each, in bounded memory. An empty table gives no rows; other columns are left out.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    given = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    given = given.withColumn("h", F.xxhash64("role", "text")).withColumn("g", F.xxhash64(F.lit(1), "role", "text"))
    # the least turn of each role and text said more than once (a null turn comes first); bounded partial aggregates
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    said = given.groupBy("conv_id", "h", "g").agg(F.min(turn).alias("first"), F.max(turn).alias("newest")).where("first <> newest")
    said = said.select(F.col("conv_id").alias("of"), F.col("h").alias("of_h"), F.col("g").alias("of_g"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")) & (F.col("g") == F.col("of_g"))
    marked = given.join(said.hint("merge"), same, "left").withColumn("seen", F.coalesce(turn > F.col("first"), F.lit(False)))
    as_text = {c: F.col(c).cast("string") for c in ("conv_id", "turn")}
    ordered = marked.select("conv_id", "turn", "role", "text", "seen").repartition("conv_id").sortWithinPartitions(*map(F.asc_nulls_first, ("conv_id", "turn", "role", "text")))
    walked = written(ordered.withColumns(as_text).mapInPandas(_walk(held), _WALKED), "walked")
    result = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    short = walked.where("audit is not null").select(*result)
    spilled = walked.where("audit is null")
    back = spilled.select("conv_id", "chunk", "back", "place", "tail").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("chunk"))
    edits = written(back.withColumn("conv_id", as_text["conv_id"]).mapInPandas(_backwards, "of long, at long, edits array<string>, after int"), "edits")
    joined = spilled.select("conv_id", "chunk", "roles", "texts").join(edits.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")))
    again = joined.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "chunk")
    each = again.select("conv_id", "after", F.size("edits").alias("n"), F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("pos", "row"))
    tail = F.when(F.col("pos") == F.col("n") - 1, F.col("after")).otherwise(0)
    digest = each.select(as_text["conv_id"].alias("conv_id"), "row.edits", tail.alias("tail"), "row.roles", "row.texts").mapInPandas(_forwards, "of long, audit string, repaired_sha256 string")
    ends = spilled.where("cost is not null").drop("audit", "repaired_sha256")
    long = ends.join(digest.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of"))).select(*result)
    return short.unionByName(long)


def whole(ids: DataFrame, found: DataFrame) -> DataFrame:
    """found with a row of zeros for each id that has no rows left."""
    ids = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(found.hint("merge"), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS]
    return joined.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return whole(rows, repair(damaged(rows)))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)), lambda r, b: list_reduce(list_prepend(xor(r, b), [0::UBIGINT FOR i IN range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)))"
#: What inserted rows may stand before an edit, and where each leads: written out for the SQL search.
_STEPS = ", ".join(f"({place}, {n}, {at})" for place in range(4) for n, at in _inserted(place))
_TO = ", ".join(f"({a}, '{r}', {b})" for (a, r), b in _NEXT.items())
ORACLE = {
    "op13_conversation_repair": rf"""
    WITH RECURSIVE given AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
             {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
      FROM conversations),
    hurt AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS text
      FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM given WHERE kind <> 0)),
    placed AS (
      SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
      FROM hurt),
    flagged AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
      FROM (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth FROM placed)),
    counts AS (
      SELECT conv_id, c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
             count(*) FILTER (WHERE fault = 't') AS truncated,
             count(*) FILTER (WHERE i > 1 AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM flagged GROUP BY conv_id, c),
    ins(place, k, mid) AS (VALUES {_STEPS}),
    go(place, role, dest) AS (VALUES {_TO}),
    -- every way to pass one row of a kind: place before and after, cost, edits, and what is written for the row
    ways AS (
      SELECT ins.place, ins.k, ins.mid, ins.mid AS to_place, 'D' AS edit, 3 AS cost, '' AS by FROM ins
      UNION ALL SELECT ins.place, k, ins.mid, go.dest, 'K', 0, go.role FROM ins JOIN go ON go.place = ins.mid
      UNION ALL SELECT ins.place, k, ins.mid, go.dest, 'R', 2, go.role FROM ins JOIN go ON go.place = ins.mid WHERE go.role <> 's'),
    put(place, k, text) AS (
      SELECT place, k, CASE k WHEN 0 THEN '' WHEN 1 THEN a ELSE a || b END
      FROM (SELECT place, k, CASE WHEN place = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END AS a,
                   CASE WHEN place = 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END AS b FROM ins)),
    search AS (
      SELECT c, 0::BIGINT AS i, 0 AS place, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM counts
      UNION ALL
      SELECT c, i, to_place, best.cost, best.audit, best.lines FROM (
        SELECT s.c, f.i, w.to_place,
               min({{'cost': s.cost + 2 * w.k + w.cost + CASE WHEN w.edit <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END,
                    'audit': s.audit || repeat('I', w.k::INT) || w.edit,
                    'lines': s.lines || p.text || CASE w.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
                             ELSE chr(10) || CASE w.by WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text END}}) AS best
        FROM search s JOIN flagged f ON f.c = s.c AND f.i = s.i + 1
        JOIN ways w ON w.place = s.place AND (w.edit = 'D' OR (f.fault NOT IN ('b', 'd') AND (w.edit = 'R' OR w.by = substr(f.role, 1, 1))))
        JOIN put p ON p.place = w.place AND p.k = w.k
        GROUP BY s.c, f.i, w.to_place)),
    ended AS (
      SELECT s.c, min({{'cost': s.cost + 2 * p.k, 'audit': s.audit || repeat('I', p.k::INT), 'lines': s.lines || p.text}}) AS best
      FROM search s JOIN counts USING (c) JOIN ins ON ins.place = s.place AND ins.mid IN (0, 3)
      JOIN put p ON p.place = ins.place AND p.k = ins.k WHERE s.i = counts.n GROUP BY s.c)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
           coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.lines, ''), 2)) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN ended USING (c)"""
}
