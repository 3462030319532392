"""Merkle manifest of a dataset and multiproofs of its rows.

Leaves are hashes of rows; those of each group (language) form a tree of ``ARITY`` children a node, the roots of the
groups one more tree. Leaves are numbered within their group by range-partitioned counts, so a group of any size is
spread over blocks of ``ARITY ** DEPTH`` neighbours; a block hashes its own levels in a task, and what is left of each
group is dealt into blocks again until one node a group remains.

Proofs follow the Octopus multiproof: a task with leaves of one block computes the least set of nodes that its leaves
need and can't derive from each other, all tasks fetch theirs from the table of nodes by one join, each node once a
task, and the task derives the nodes that its leaves share and expands the proof of every leaf by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions.places import numbered
from factgraph.llm.shared import lower_ascii, table, written

ARITY, DEPTH = 8, 3
#: The tree of the groups' roots; names of groups begin with "+", and "" is the null group, so that it sorts first.
TOP = "^"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def missing(places: Iterable[int], n: int, arity: int = ARITY) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes from which, with the given leaves of a tree of n, the root can be derived."""
    out, level, known = [], 0, sorted(set(places))
    while n > 1:
        have, parents = set(known), sorted({p // arity for p in known})
        out += [(level, p) for up in parents for p in range(up * arity, min(n, up * arity + arity)) if p not in have]
        known, n, level = parents, -(-n // arity), level + 1
    return out


def derive(nodes: dict[tuple[int, int], str], places: Iterable[int], n: int, arity: int = ARITY) -> str:
    """Root of a tree of n leaves; nodes has the leaves at places and what they miss, and gets all nodes above them."""
    level, known = 0, sorted(set(places))
    while n > 1:
        known = sorted({p // arity for p in known})
        for up in known:
            nodes[level + 1, up] = digest(nodes[level, p] for p in range(up * arity, min(n, up * arity + arity)))
        n, level = -(-n // arity), level + 1
    return nodes[level, 0]


def siblings(nodes: dict[tuple[int, int], str], place: int, n: int, arity: int = ARITY) -> list[tuple[list[str], list[str]]]:
    """Hashes left and right of the way up from a leaf, level by level."""
    out, level = [], 0
    while n > 1:
        first = place - place % arity
        run = range(first, min(n, first + arity))
        out.append(([nodes[level, p] for p in run if p < place], [nodes[level, p] for p in run if p > place]))
        place, n, level = place // arity, -(-n // arity), level + 1
    return out


def fold(leaf: str, way: list[tuple[list[str], list[str]]]) -> str:
    """Root that a leaf and the hashes beside its way give."""
    for left, right in way:
        leaf = digest([*left, leaf, *right])
    return leaf


@dataclass
class Manifest:
    """leaves (tree, place, n, and the given columns), nodes (tree, level, place, hash) and groups (tree, n, no, n_groups, hash)."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: DataFrame


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of a row: each value as UTF-8 byte count, ``:`` and text, ``-`` for null."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def _levels(depth: int, arity: int):
    """Nodes above each block (tree, block) of neighbours: up to its own root, or the tree's if it is the only block."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, base = key[0].as_py(), key[1].as_py() * arity**depth
        level = rows.column("level")[0].as_py()
        at = sorted(zip(rows.column("place").to_pylist(), rows.column("hash").to_pylist(), strict=True))
        now, alone, out = [h for _, h in at], base == 0 and len(at) < arity**depth, []
        for up in range(1, depth + 1):
            if alone and len(now) == 1:
                break
            base //= arity
            now = [digest(now[i : i + arity]) for i in range(0, len(now), arity)]
            out += [(tree, level + up, base + i, h, up == depth or len(now) == 1 and alone) for i, h in enumerate(now)]
        if not out:
            out = [(tree, level, 0, now[0], True)]
        return pa.table(dict(zip(_NODE_NAMES, map(list, zip(*out, strict=True)), strict=True)), _NODE)

    return run


_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("hash", pa.string()), ("top", pa.bool_())])
_NODE_NAMES = _NODE.names
_NODE_DDL = "tree string, level int, place long, hash string, top boolean"


def trees(leaves: DataFrame, depth: int = DEPTH, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of leaves (tree, place, hash): all nodes above the leaves, and (tree, hash) of each tree's root.

    Places of each tree count from 0 without gaps. Rounds of ``depth`` levels, each a table: a round has one row for
    ``arity ** depth`` of the one before, so a tree of 10 ** 12 leaves takes five.
    """
    rows = leaves.select("tree", F.lit(0).alias("level"), "place", "hash")
    nodes, roots = [], []
    while True:
        blocks = rows.withColumn("block", F.floor(F.col("place") / arity**depth).cast("long"))
        found = written(blocks.groupBy("tree", "block").applyInArrow(_levels(depth, arity), _NODE_DDL), "nodes")
        nodes.append(found)
        top = found.where("top")
        more = top.groupBy("tree").agg(F.count("*").alias("n"), F.first("hash").alias("hash"))
        more = written(more, "tops")
        roots.append(more.where("n = 1").select("tree", "hash"))
        rest = more.where("n > 1").select(F.col("tree").alias("of"))
        if rest.isEmpty():
            break
        rows = top.join(rest.hint("merge"), F.col("tree") == F.col("of"), "left_semi").select("tree", "level", "place", "hash")
    every, ends = nodes[0], roots[0]
    for more, end in zip(nodes[1:], roots[1:], strict=True):
        every, ends = every.unionByName(more), ends.unionByName(end)
    return every.where("level > 0").select("tree", "level", "place", "hash").distinct(), ends


def build(rows: DataFrame, group: Column, order: list[Column], leaf: Column, carry: list[Column], depth: int = DEPTH, arity: int = ARITY) -> Manifest:
    """Manifest of a table: one tree for each value of group, leaves in order, and the tree of the groups' roots.

    A null group is a group and comes first. Rows that tie in order go by hash; rows equal in both are interchangeable.
    An empty table has no leaves, no groups and no root. carry has aliased columns that leaves keep.
    """
    names = [f"o{i}" for i in range(len(order))]
    tree = F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group.cast("string")))
    hashed = rows.select(tree.alias("tree"), leaf.alias("hash"), *(c.alias(n) for c, n in zip(order, names, strict=True)), *carry)
    given = numbered(hashed, ["tree"], [*map(F.asc_nulls_first, names), F.asc("hash")]).withColumn("place", F.col("rn") - 1).drop("rn", *names)
    given = written(given, "leaves")
    sizes = given.groupBy("tree").agg(F.count("*").alias("n"))
    nodes, roots = trees(given, depth, arity)
    ranked = numbered(roots, [], [F.asc("tree")], "no").join(sizes.withColumnRenamed("tree", "of").hint("merge"), F.col("tree") == F.col("of"))
    groups = written(ranked.select("tree", "n", (F.col("no") - 1).alias("no"), "hash"), "groups")
    upper = written(groups.select(F.lit(TOP).alias("tree"), F.col("no").alias("place"), "hash"), "subroots")
    above, root = trees(upper, depth, arity)
    total = groups.agg(F.count("*").alias("n_groups"))
    leaf_nodes = given.select("tree", F.lit(0).alias("level"), "place", "hash")
    every = leaf_nodes.unionByName(nodes).unionByName(upper.select("tree", F.lit(0).alias("level"), "place", "hash")).unionByName(above)
    return Manifest(given, every, groups.crossJoin(F.broadcast(total)), root.select("hash"))


def _wanted(arity: int):
    """Nodes that the leaves of a block miss in their own tree and in the tree of the groups."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        n, no, n_groups = (rows.column(c)[0].as_py() for c in ("n", "no", "n_groups"))
        out = [(tree, level, place) for level, place in missing(rows.column("place").to_pylist(), n, arity)]
        out += [(TOP, level, place) for level, place in missing([no], n_groups, arity)]
        columns = [list(c) for c in zip(*out, strict=True)] or [[], [], []]
        return pa.table([pa.array([tree] * len(out), pa.string()), pa.array([block] * len(out), pa.int64()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["by_tree", "by_block", "tree", "level", "place"])

    return run


_PROOF = pa.schema([("place", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("n_siblings", pa.int32())])


def _expand(arity: int, keep: pa.Schema):
    """Proof of every leaf of a block from its leaves and the nodes fetched for it."""
    schema = pa.schema([*keep, *_PROOF])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, fetched: pa.Table) -> pa.Table:
        own: dict[tuple[int, int], str] = {}
        top: dict[tuple[int, int], str] = {}
        for tree, level, place, value in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "place", "hash")), strict=True):
            (top if tree == TOP else own)[level, place] = value
        n, no, n_groups = (rows.column(c)[0].as_py() for c in ("n", "no", "n_groups"))
        places = rows.column("place").to_pylist()
        own |= {(0, p): h for p, h in zip(places, rows.column("hash").to_pylist(), strict=True)}
        subroot = derive(own, places, n, arity)
        top[0, no] = subroot
        root = derive(top, [no], n_groups, arity)
        above = siblings(top, no, n_groups, arity)
        ways = [siblings(own, p, n, arity) + above for p in places]
        flat = [[h for left, right in way for h in left + right] for way in ways]
        claimed = rows.column("claim").to_pylist()
        new = [places, [subroot] * len(places), [root] * len(places), [digest(f) for f in flat], [fold(c, w) for c, w in zip(claimed, ways, strict=True)], [len(f) for f in flat]]
        return pa.table([*(rows.column(f.name).cast(f.type) for f in keep), *(pa.array(c, f.type) for c, f in zip(new, _PROOF, strict=True))], schema=schema)

    return run


def prove(manifest: Manifest, leaves: DataFrame, claim: Column, keep: list[str], depth: int = DEPTH, arity: int = ARITY) -> DataFrame:
    """Proofs of leaves, any part of those of the manifest: (keep…, place, subroot, root, proof_sha256, folded_root, n_siblings).

    subroot and root are derived from the leaves and the nodes fetched; folded_root is what the claimed hash gives in
    the leaf's place with the same siblings. Blocks of neighbours are the parts that fetch and derive together; keep
    names columns of leaves.
    """
    types = {f.name: f for f in leaves.schema}
    named = {c: f"k{i}" for i, c in enumerate(keep)}
    chosen = leaves.select("tree", F.floor(F.col("place") / arity**depth).cast("long").alias("block"), "place", "hash", claim.alias("claim"), *(F.col(c).alias(k) for c, k in named.items()))
    # a group's size comes by way of its blocks, so that no task joins all leaves of a group
    blocks = chosen.select("tree", "block").distinct().join(manifest.groups.select("tree", "n", "no", "n_groups").hint("merge"), "tree")
    ready = written(chosen.join(blocks.hint("merge"), ["tree", "block"]), "claims")
    asked = ready.select("tree", "block", "place", "n", "no", "n_groups").groupBy("tree", "block").applyInArrow(_wanted(arity), "by_tree string, by_block long, tree string, level int, place long")
    asked = written(asked, "wanted")
    fetched = asked.join(manifest.nodes.hint("merge"), ["tree", "level", "place"])
    fields = ", ".join(f"{k} {types[c].dataType.simpleString()}" for c, k in named.items())
    arrow = pa.schema([(k, pa.string() if types[c].dataType.simpleString() == "string" else pa.int64()) for c, k in named.items()])
    out = ready.groupBy("tree", "block").cogroup(fetched.groupBy("by_tree", "by_block")).applyInArrow(_expand(arity, arrow), f"{fields}, place long, subroot string, root string, proof_sha256 string, folded_root string, n_siblings int")
    return out.withColumnsRenamed({k: c for c, k in named.items()})


def documents_manifest(docs: DataFrame, depth: int = DEPTH, arity: int = ARITY) -> Manifest:
    """Manifest of documents: leaves of doc_id, source, lang, n_chars and text, a tree for each language, by doc_id.

    Leaves also carry ``claim``, the hash that the row has after tampering: where 3 divides the crc32 of the decimal
    doc_id, A-Z of the text are in lower case. Nulls in any column are hashed as ``-``; a null id comes first and is
    never tampered with. Texts never leave the scan: only hashes are shuffled. Extra columns are no part of a leaf.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    hashed = docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash([F.col(c) for c in [*fields, "text"]]).alias("leaf"), leaf_hash([*map(F.col, fields), text]).alias("claim"))
    return build(hashed, F.col("group"), [F.col("doc_id")], F.col("leaf"), [F.col("doc_id"), F.col("claim")], depth, arity)


def verify(docs: DataFrame, depth: int = DEPTH, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document; an empty table gives no rows."""
    manifest = documents_manifest(docs, depth, arity)
    leaves = manifest.leaves.withColumn("leaf", F.col("hash"))
    found = prove(manifest, leaves, F.col("claim"), ["doc_id", "leaf"], depth, arity)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
_PART = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _PART + ")"
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda r, b: list_reduce(list_prepend(xor(r, b), [0::UBIGINT FOR i IN range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)))"
ORACLE = {
    "op12_merkle_manifest": rf"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, coalesce('+' || lang, '') AS tree, {_LEAF.format("text")} AS leaf,
             CASE WHEN coalesce({_CRC} % 3 = 0, false)
                  THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                  ELSE {_LEAF.format("text")} END AS claim
      FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
    low AS (
      SELECT tree, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM placed
      UNION ALL
      SELECT tree, level + 1, place // 8, sha256(string_agg(hash, '' ORDER BY place)), (n + 7) // 8
      FROM low WHERE n > 1 GROUP BY tree, level, place // 8, n),
    subroots AS (SELECT tree, level AS height, hash, row_number() OVER (ORDER BY tree) - 1 AS no FROM low WHERE n = 1),
    high AS (
      SELECT 0 AS level, no AS place, hash, count(*) OVER () AS n FROM subroots
      UNION ALL
      SELECT level + 1, place // 8, sha256(string_agg(hash, '' ORDER BY place)), (n + 7) // 8
      FROM high WHERE n > 1 GROUP BY level, place // 8, n),
    tops AS (SELECT hash AS root, level AS height FROM high WHERE n = 1),
    -- nodes of both trees by the level counted from the leaf: a group's levels, then those above its subroot
    ways AS (
      SELECT p.tree, p.place, l.level, l.place AS side, l.hash, l.place = (p.place // (8 ** l.level)::BIGINT) AS own
      FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.place // 8 = p.place // (8 ** (l.level + 1))::BIGINT
      UNION ALL
      SELECT p.tree, p.place, s.height + h.level, h.place, h.hash, h.place = (s.no // (8 ** h.level)::BIGINT)
      FROM placed p JOIN subroots s USING (tree) JOIN high h ON h.n > 1 AND h.place // 8 = s.no // (8 ** (h.level + 1))::BIGINT),
    runs AS (
      SELECT tree, place, level, coalesce(string_agg(hash, '' ORDER BY side) FILTER (WHERE NOT own), '') AS beside,
             coalesce(string_agg(hash, '' ORDER BY side) FILTER (WHERE side < mine), '') AS before,
             coalesce(string_agg(hash, '' ORDER BY side) FILTER (WHERE side > mine), '') AS after
      FROM (SELECT *, max(CASE WHEN own THEN side END) OVER (PARTITION BY tree, place, level) AS mine FROM ways)
      GROUP BY tree, place, level),
    proofs AS (SELECT tree, place, sha256(string_agg(beside, '' ORDER BY level)) AS proof, count(*) AS levels FROM runs GROUP BY tree, place),
    folds AS (
      SELECT tree, place, 0::BIGINT AS level, claim AS hash FROM placed
      UNION ALL
      SELECT f.tree, f.place, f.level + 1, sha256(r.before || f.hash || r.after)
      FROM folds f JOIN runs r ON r.tree = f.tree AND r.place = f.place AND r.level = f.level)
    SELECT p.doc_id, p.leaf, s.hash AS subroot, t.root, coalesce(q.proof, sha256('')) AS proof_sha256,
           f.hash AS folded_root, f.hash = t.root AS verified
    FROM placed p JOIN subroots s USING (tree) CROSS JOIN tops t
    LEFT JOIN proofs q ON q.tree = p.tree AND q.place = p.place
    JOIN folds f ON f.tree = p.tree AND f.place = p.place AND f.level = coalesce(q.levels, 0)"""
}
