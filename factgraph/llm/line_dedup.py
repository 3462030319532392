"""Line deduplication across documents.

Lines are exploded and normalised, hashed, the distinct documents of each hash are told apart (least and greatest id,
pre-aggregated before the shuffle), and lines whose key is held by several documents go from all but the first.
Kept lines are put together again by position. Whole texts are shuffled once, to meet the keys that they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.shared import LOWER, SPACES, UPPER, lower_ascii, table, written

MIN_CHARS = 10
_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: str) -> str:
    """A line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACES).translate(_FOLD)


def keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h, g): both 64-bit halves of a hash of each line key of at least min_chars code points."""
    lines = docs.where("id is not null and text is not null").select("id", F.explode(F.split("text", "\n")).alias("line"))
    key = lower_ascii(F.btrim("line", F.lit(SPACES)))
    return lines.select("id", key.alias("key")).where(F.char_length("key") >= min_chars).select("id", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def repeated(lines: DataFrame) -> DataFrame:
    """(h, g, first) of keys in at least two documents; first is the smallest id that holds the key."""
    found = lines.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return found.where("first <> last").drop("last")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, lost in zip(batch.column("text"), batch.column("lost"), strict=True):
            whole = text.as_py() or ""
            n_lines.append(whole.count("\n") + 1)
            if lost.is_valid:
                gone = {x & 0xFFFFFFFFFFFFFFFF for x in lost.as_py()}
                lines = whole.split("\n")
                stay = [x for x in lines if digest(line_key(x).encode("utf-8", "surrogatepass"), 42) not in gone]
                whole = "\n".join(stay)
                n_dropped.append(len(lines) - len(stay))
            else:
                n_dropped.append(0)
            kept.append(whole)
        fixed = [n for n in batch.schema.names if n not in ("text", "lost")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in fixed), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*fixed, "kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each input row: id, the columns named in carry, kept (text), n_lines, n_dropped.

    A key of at least min_chars code points found in two or more documents loses all its lines except in the
    smallest id that holds it. Null and empty texts are one empty line; kept is then empty. Very long texts and lines are read whole, a
    document's lines in one task. Rows that share an id
    are one document. A row with a null id keeps all its lines and counts for no key. An empty table gives no rows.
    Carried columns come back under c0, c1, ..., so their names cannot clash; others are left out.
    """
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry or [])]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *own)
    lines = written(keys(source.select("id", "text"), min_chars), "lines")  # read twice, split and hashed once
    known = written(repeated(lines), "repeated_lines")
    hit = lines.join(known.hint("merge"), ["h", "g"]).where("id > first")
    lost = hit.groupBy(F.col("id").alias("of")).agg(F.collect_set("h").alias("lost"))
    joined = source.join(lost.hint("merge"), F.col("id") == F.col("of"), "left").drop("of")
    fields = T.StructType().add("id", "long")
    for i, c in enumerate(carry or []):
        fields = fields.add(f"c{i}", docs.schema[c].dataType)
    fields = fields.add("kept", "string").add("n_lines", "long").add("n_dropped", "long")
    ordered = joined.select("id", *(f"c{i}" for i in range(len(own))), "text", "lost")
    return ordered.mapInArrow(_assemble, fields)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {
    "op2_line_dedup": r"""
    WITH lines AS (
      SELECT doc_id, line, pos,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
    repeated AS (
      SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
      GROUP BY key HAVING min(doc_id) <> max(doc_id))
    SELECT l.doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE r.key IS NOT NULL AND l.doc_id > r.first_doc) AS n_dropped,
           sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
                  FILTER (WHERE r.key IS NULL OR l.doc_id <= r.first_doc), '')) AS kept_sha256
    FROM lines l LEFT JOIN repeated r ON l.key = r.key
    GROUP BY l.doc_id"""
}
