"""Column expressions that the operators share; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factgraph.functions import vocabulary as V


def normal_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def normal_text(c: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def normal_relation(c: Column) -> Column:
    return F.upper(F.replace(F.trim(c), F.lit(" "), F.lit("_")))


def known_relation(c: Column) -> Column:
    return c.isin(*V.RELATION_TYPES) & c.rlike("^[A-Z][A-Z0-9_]*$")


def blocked_name(c: Column) -> Column:
    """Names of under three characters and names of the blocklist."""
    name = normal_name(c)
    return (F.length(name) < 3) | name.isin(*V.BLOCKED_NAMES)


def normal_source(c: Column) -> Column:
    source = normal_name(F.coalesce(c, F.lit("manual")))
    return F.when(source.isin(*V.SOURCES), source).otherwise("manual")


def min_confidence(source: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in V.MIN_CONFIDENCE.items() for x in pair))
    return F.coalesce(F.try_element_at(known, source), F.lit(V.DEFAULT_MIN_CONFIDENCE))


def safe_id(c: Column) -> Column:
    """Letters, digits, _ and - in lower case; anything else as _; ``unknown`` if empty or null."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.trim(c), "[^a-zA-Z0-9_-]", "_")), F.lit("")), F.lit("unknown"))


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open interval start <= t < end; a null bound is open."""
    return (F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (F.col(end) > t))


def half_life(rel_type: Column) -> Column:
    """Days in which an edge of this type loses half its strength."""
    out = F.lit(float(V.HALF_LIVES[V.DEFAULT_TIER]))
    for tier, types in V.TIERS.items():
        out = F.when(rel_type.isin(*types), F.lit(float(V.HALF_LIVES[tier]))).otherwise(out)
    return out


def decayed_strength(count: Column, days: Column, rel_type: Column) -> Column:
    return F.log(1.0 + count) * F.exp(-F.log(F.lit(2.0)) / half_life(rel_type) * days)


def recency(days: Column) -> Column:
    return F.exp(F.lit(-0.03) * days)


def similarity(distance: Column) -> Column:
    return F.exp(-F.greatest(F.lit(0.0), distance))


def clamp(c: Column, low: float = 0.0, high: float = 1.0, default: float = 0.0) -> Column:
    """A number or a text of one, within bounds; anything else is the default."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(c.try_cast("double"), F.lit(default))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fitted(v: Column, size: int) -> Column:
    """A vector cut or padded with zeros to a size."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of each trimmed, non-empty text, in order."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    step = lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(clean, F.array().cast("array<string>"), step)


def last_n(items: Column, n: int) -> Column:
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def floor_percentile(values: Column, p: float) -> Column:
    """Element at floor(n * p / 100) of the sorted values, the last at most; null for none."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    return F.get(ordered, F.least(F.floor(n * p / 100.0), n - 1).cast("int"))


def hash_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))
