"""Reading facts and neighbourhoods of many entities at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions.places import dealt_like, met_by_part, written, written_by
from factgraph.functions.sizes import containing, small


def names_of(entities: DataFrame) -> DataFrame:
    """(key, id, exact): normalised names and aliases (alias or aliases), the exact name preferred and the least id of each key."""
    key = lambda c, rank: F.struct(C.normal_name(c).alias("key"), F.lit(rank).alias("rank"))
    others = F.transform("aliases", lambda a: key(a, 1)) if "aliases" in entities.columns else F.array(key(F.col("alias"), 1))
    each = entities.select("id", F.explode(F.concat(F.array(key(F.col("name"), 0)), others)).alias("k"))
    best = each.select("id", "k.key", "k.rank").groupBy("key").agg(F.min(F.struct("rank", "id")).alias("best"))
    return best.select("key", F.col("best.id").alias("id"), (F.col("best.rank") == 0).alias("exact"))


def resolve(mentions: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """mentions with the id that their name or alias stands for (null if none)."""
    return mentions.join(names_of(entities).hint("merge"), C.normal_name(F.col(name)) == F.col("key"), "left").drop("key")


def current_facts(edges: DataFrame, as_of: Column, top: int | None = None, exclude_quarantined: bool = False) -> DataFrame:
    """Edges valid at as_of with their decayed strength; the strongest of each source if top is given."""
    kept = edges.where(C.valid_at(as_of))
    if exclude_quarantined:
        kept = kept.where("coalesce(audit_status, '') not in ('quarantined', 'deleted')")
    days = F.datediff(as_of, F.col("last_day"))
    facts = kept.withColumn("strength", F.round(C.decayed_strength(F.col("mention_count"), days, F.col("rel_type")), 6))
    if top is None:
        return facts
    best = Window.partitionBy("src").orderBy(F.desc("strength"), F.desc("valid_from"), "rel_type", "dst")
    return facts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


#: Days are counted from here in blocks of powers of two; 2 ** SPAN of them hold every date there is.
FIRST_DAY, SPAN = "0001-01-01", 22


def _cover(first: Column, end: Column) -> Column:
    """Aligned blocks (level, place) of 1, 2, 4, … days that make up the days from first to end (not included): no day twice."""
    low = lambda level: F.ceil(first / F.pow(F.lit(2), level)).cast("long")
    high = lambda level: F.floor(end / F.pow(F.lit(2), level)).cast("long")
    block = lambda level, place, wanted: F.when(wanted, F.struct(level.alias("level"), place.alias("place")))
    each = lambda level: F.array(
        block(level, low(level), (low(level) < high(level)) & (low(level) % 2 == 1)),
        block(level, high(level) - 1, (low(level) < high(level)) & (high(level) % 2 == 1)),
    )
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SPAN)), each)), lambda b: b.isNotNull())


def _number(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


#: Distinct days that are looked through for each edge; more are met by blocks.
FEW_DAYS = 128


def facts_at(edges: DataFrame, instants: DataFrame) -> DataFrame:
    """Edges valid at each of a table of days (t): the bulk form of the as-of filter.

    Where the distinct days are few, an edge takes those in its interval from the list of them. Else it brings the few
    aligned blocks of days that make up its interval (open ends reach the first or last day there is), a day the blocks
    that it lies in, and they meet by an equi-join on the block. Either way an edge meets a day once, and only if valid.
    """
    asked = instants.where("t is not null")
    first, end = F.coalesce(_number(F.col("valid_from")), F.lit(0)), F.coalesce(_number(F.col("valid_to")), F.lit(1 << SPAN))
    days = [r[0] for r in asked.select(_number(F.col("t"))).distinct().limit(FEW_DAYS + 1).collect()]
    if 0 < len(days) <= FEW_DAYS:
        listed = edges.withColumn("_first", first).withColumn("_end", end)
        within = F.filter(F.array(*map(F.lit, sorted(days))), lambda d: (d >= F.col("_first")) & (d < F.col("_end")))
        spread = listed.withColumn("_day", F.explode(within)).drop("_first", "_end")
        return spread.join(small(asked.withColumn("_at", _number(F.col("t")))), F.col("_day") == F.col("_at")).drop("_day", "_at")
    spread = edges.withColumn("_block", F.explode(_cover(F.greatest(first, F.lit(0)), end)))
    levels = F.transform(F.sequence(F.lit(0), F.lit(SPAN)), lambda level: F.struct(level.alias("level"), F.floor(_number(F.col("t")) / F.pow(F.lit(2), level)).cast("long").alias("place")))
    asked = asked.select("*", F.explode(levels).alias("_in"))
    return spread.join(small(asked), F.col("_block") == F.col("_in")).drop("_block", "_in")


def counts_at(edges: DataFrame, instants: DataFrame, by: list[str]) -> DataFrame:
    """(t, by…, n): how many edges of each kind are valid at each day, kinds with none left out.

    Starts and ends are counted a day and kind, and summed up to each day asked for: no edge meets a day.
    """
    starts = edges.groupBy(*by, F.coalesce("valid_from", F.lit(FIRST_DAY).cast("date")).alias("day")).agg(F.count("*").alias("change"))
    ends = edges.where("valid_to is not null and (valid_from is null or valid_to > valid_from)").groupBy(*by, F.col("valid_to").alias("day")).agg((-F.count("*")).alias("change"))
    empty = edges.where("valid_to <= valid_from").groupBy(*by, F.col("valid_from").alias("day")).agg((-F.count("*")).alias("change"))
    changes = reduce(DataFrame.unionByName, [starts, ends, empty]).withColumn("asked", F.lit(False))
    kinds = changes.select(*by).distinct()
    asked = kinds.crossJoin(small(instants.where("t is not null").select(F.col("t").alias("day")).distinct())).withColumn("change", F.lit(0).cast("long")).withColumn("asked", F.lit(True))
    so_far = F.sum("change").over(Window.partitionBy(*by).orderBy("day"))  # a row a kind and day
    return changes.unionByName(asked).withColumn("n", so_far).where("asked and n > 0").select(F.col("day").alias("t"), *by, "n")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: (id, other, rel_type, strength, direction)."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel_type", "strength", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel_type", "strength", F.lit("in").alias("direction")))


def direct_context(edges: DataFrame, ids: DataFrame, top: int = 20, min_strength: float = 0.3) -> DataFrame:
    """Strongest edges of each id in each direction."""
    near = both_ways(edges.where(F.coalesce("strength", F.lit(0.0)) >= min_strength)).join(ids, "id")
    best = Window.partitionBy("id", "direction").orderBy(F.desc("strength"), "rel_type", "other")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _that_can_be_best(second: DataFrame, first: DataFrame, strongest: DataFrame, top: int) -> DataFrame:
    """Second edges without those too weak for the ``top`` best paths of any id, by a bound that each id is known to reach.

    The strongest edge (mid, s2) of a middle entity to one that is no id makes a path for each id next to it, a different one for
    each middle entity: the ``top``-th best of them is a bound. The strongest first edge of all, with an edge that is to
    be kept, must reach the least bound; if an id has too few such paths, no edge goes.
    """
    firsts = first.groupBy("id", F.col("via").alias("mid")).agg(F.max("s1").alias("s1"))
    paths = firsts.join(strongest.hint("merge"), "mid").select("id", (F.col("s1") + F.col("s2")).alias("sum")).where("sum is not null")
    by_id = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sum")))
    reached = paths.withColumn("rank", by_id).where(F.col("rank") <= top).groupBy("id").agg(F.min("sum").alias("bound"), F.count("*").alias("n"))
    least, n = reached.where(F.col("n") == top).agg(F.min("bound"), F.count("*")).first()
    of, most = first.agg(F.count_distinct("id"), F.max("s1")).first()
    if least is None or n < of or not math.isfinite(least - most):
        return second
    return second.where(F.col("s2") >= least - most - ROUNDED)


#: More than the rounding of a path's strength, in the sum of both its edges.
ROUNDED = 1e-5


def two_hop(edges: DataFrame, ids: DataFrame, top: int = 10) -> DataFrame:
    """Entities two steps away (not the start): (id, target, rel_type, via, strength), the mean of both edges, rounded to 6 digits before.

    Edges too weak for any start's best go first, by a bound that all starts reach; so few are moved. A middle entity,
    such as a hub, passes on only its strongest edges: by the order of the result, those after its
    first ``top`` and as many as can lead back to one start can't be among the best of any start.
    """
    way = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), "rel_type", F.round("strength", 6).alias("strength"))
    near = edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("n")).select("n.*")  # edges are read once for both ways
    # one pass for the edges at a start, seen from the other end, and for the strongest other edge of each entity
    starts = small(ids.where("id is not null").select(F.col("id").alias("start")).distinct())
    at = near.join(starts, F.col("other") == F.col("start"), "left")
    kept = at.groupBy(F.col("id").alias("via"), "start", F.when(F.col("start").isNotNull(), F.col("strength")).alias("s1")).agg(F.max("strength").alias("most"))
    kept = written(kept, "beside")
    first, strongest = kept.where("start is not null").select(F.col("start").alias("id"), "via", "s1"), kept.where("start is null").select(F.col("via").alias("mid"), F.col("most").alias("s2"))
    second = near.select(F.col("id").alias("mid"), F.col("other").alias("target"), "rel_type", F.col("strength").alias("s2"))
    second = _that_can_be_best(second, first, strongest, top)
    second = second.join(first.select(F.col("via").alias("mid")).distinct().hint("merge"), "mid", "left_semi").distinct()
    second = written(second, "second")
    back = second.groupBy("mid", "target").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    best = F.row_number().over(Window.partitionBy("mid").orderBy(F.desc("s2"), "target", "rel_type"))
    kept = second.withColumn("rank", best).where(F.col("rank") <= top + back).drop("rank")
    paths = first.join(kept.hint("merge"), F.col("via") == F.col("mid")).where("target <> id").select("id", "target", "rel_type", "via", F.round((F.col("s1") + F.col("s2")) / 2, 7).alias("strength")).distinct()
    order = Window.partitionBy("id").orderBy(F.desc("strength"), "target", "rel_type", "via")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Middle entities of a pair that are looked at first for a third hop, those with most neighbours.
FIRST_LOOKED = 4


def _joined_by_edge(wanted: DataFrame, step: DataFrame, degree: DataFrame) -> DataFrame:
    """Of (via, end), those with an edge from a neighbour of one to the other: the one with fewer neighbours lists them, the other is probed."""
    sized = lambda c: degree.select(F.col("x").alias(c), F.col("degree").alias(f"d_{c}")).hint("merge")
    both = wanted.join(sized("via"), "via").join(sized("end"), "end")
    swap = F.col("d_via") > F.col("d_end")
    both = both.select("via", "end", F.when(swap, F.col("end")).otherwise(F.col("via")).alias("few"), F.when(swap, F.col("via")).otherwise(F.col("end")).alias("many"))
    listed = dealt_like(both, "few").join(step.hint("merge"), F.col("few") == F.col("x")).select("via", "end", "many", F.col("y").alias("at"))
    return dealt_like(listed, "many").join(step.hint("merge"), (F.col("many") == F.col("x")) & (F.col("at") == F.col("y")), "left_semi").select("via", "end").distinct()


#: Entities with most neighbours that third hops are sought by first, a bit of a long each.
HUBS = 64


def _by_hubs(left: DataFrame, step: DataFrame, degree: DataFrame) -> DataFrame:
    """Pairs (a, b) of which one end is next to a hub and the other two steps from it: a row an entity, whatever the number of pairs."""
    most = degree.orderBy(F.desc("degree"), "x").limit(HUBS)
    bit = F.row_number().over(Window.orderBy(F.desc("degree"), "x")) - 1
    hubs = most.withColumn("bit", bit).select(F.col("x").alias("y"), F.expr("shiftleft(1L, bit)").alias("beside"))
    beside = written(step.join(F.broadcast(hubs), "y").groupBy("x").agg(F.bit_or("beside").alias("beside")), "beside")
    # steps go both ways: an entity tells its neighbours what it is next to, so that steps are read where they are
    behind = step.join(dealt_like(beside, "x").hint("merge"), "x").groupBy("y").agg(F.bit_or("beside").alias("behind")).withColumnRenamed("y", "x")
    seen = written(behind.join(beside.hint("merge"), "x", "left").select("x", F.coalesce("beside", F.lit(0).cast("long")).alias("beside"), "behind"), "seen")
    of = lambda c: seen.select(F.col("x").alias(c), F.col("beside").alias(f"beside_{c}"), F.col("behind").alias(f"behind_{c}")).hint("merge")
    met = F.col("beside_a").bitwiseAND(F.col("behind_b")).bitwiseOR(F.col("behind_a").bitwiseAND(F.col("beside_b")))
    return left.join(of("a"), "a").join(of("b"), "b").where(met != 0).select("a", "b")


def _shared_ends(left: DataFrame, step: DataFrame, degree: DataFrame) -> DataFrame:
    """(a, b, end, other) of pairs with an end that is cheaper to look around once than to ask each of its pairs about."""
    sized = lambda c: degree.select(F.col("x").alias(c), F.col("degree").alias(f"d_{c}")).hint("merge")
    cost = left.join(sized("a"), "a").join(sized("b"), "b").select("a", "b", (F.col("d_a") * F.col("d_b")).alias("cost"))
    each = cost.select("cost", F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.sum("cost").alias("asked"))
    near = dealt_like(each, "end").join(step.hint("merge"), F.col("end") == F.col("x")).select("end", "asked", "y")
    around = near.join(degree.select(F.col("x").alias("y"), "degree").hint("merge"), "y").groupBy("end", "asked").agg(F.sum("degree").alias("around"))
    cheap = written(around.where("around <= asked").select("end", F.col("around")), "ends")
    of = lambda c: cheap.select(F.col("end").alias(c), F.col("around").alias(f"around_{c}")).hint("merge")
    both = left.join(of("a"), "a", "left").join(of("b"), "b", "left").where("around_a is not null or around_b is not null")
    by_a = F.col("around_b").isNull() | (F.col("around_a") <= F.col("around_b"))
    by_a = F.coalesce(by_a, F.lit(False))
    return both.select("a", "b", F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("end"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("other"))


def _by_ends(shared: DataFrame, step: DataFrame) -> DataFrame:
    """Pairs (a, b) of (a, b, end, other): what is two steps from an end is listed once for all its pairs."""
    near = dealt_like(shared.select("end").distinct(), "end").join(step.hint("merge"), F.col("end") == F.col("x")).select("end", F.col("y").alias("via"))
    around = dealt_like(near, "via").join(step.hint("merge"), F.col("via") == F.col("x")).select("end", F.col("y").alias("at")).distinct()
    asked = dealt_like(shared, "other").join(step.hint("merge"), F.col("other") == F.col("x")).select("a", "b", "end", F.col("y").alias("at"))
    return asked.join(around.hint("merge"), ["end", "at"], "left_semi").select("a", "b").distinct()


def _third_hop(left: DataFrame, step: DataFrame, degree: DataFrame) -> DataFrame:
    """Pairs (a, b) three steps apart, of pairs that are no fewer.

    Most meet at a hub. Of those left, pairs that share an end ask what lies two steps around it, which is listed once;
    the others are asked one by one.
    """
    hubs = written(_by_hubs(left, step, degree), "hop")
    left = written(left.join(hubs.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    shared = written(_shared_ends(left, step, degree), "shared")
    ends = written(_by_ends(shared, step), "hop")
    single = written(left.join(shared.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "pairs")
    return hubs.union(ends).union(_one_by_one(single, step, degree))


def _one_by_one(left: DataFrame, step: DataFrame, degree: DataFrame) -> DataFrame:
    """Pairs (a, b) three steps apart, of pairs that are no fewer.

    The end with fewer neighbours lists them; each of these and the far end are two steps apart if they have a
    neighbour in common, which is asked once for all pairs that share them. The neighbours with most neighbours are
    asked first, since they settle most pairs; the others only for pairs that are left.
    """
    sized = lambda c: degree.select(F.col("x").alias(c), F.col("degree").alias(f"d_{c}")).hint("merge")
    ends = left.join(sized("a"), "a").join(sized("b"), "b")
    swap = F.col("d_a") > F.col("d_b")
    ends = ends.select("a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("end"))
    out = dealt_like(ends, "few").join(step.hint("merge"), F.col("few") == F.col("x")).select("a", "b", "end", F.col("y").alias("via")).join(sized("via"), "via")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("d_via"), "via"))
    out = written(out.withColumn("rank", rank), "third")
    hits = []
    for part in (F.col("rank") <= FIRST_LOOKED, F.col("rank") > FIRST_LOOKED):
        asked = out.where(part)
        for hit in hits:
            asked = asked.join(hit.hint("merge"), ["a", "b"], "left_anti")
        asked = written(asked.select("a", "b", "via", "end"), "asked")
        met = _joined_by_edge(asked.select("via", "end").distinct(), step, degree)
        hits.append(written(asked.join(met.hint("merge"), ["via", "end"]).select("a", "b").distinct(), "hop"))
    return hits[0].union(hits[1])


def _found(edges: DataFrame, pairs: DataFrame, max_hops: int) -> list[DataFrame]:
    """(a, b, hops) of the distinct pairs with a path, by hops."""
    left = written(pairs.select("a", "b").where("a is not null and b is not null").distinct(), "pairs")
    way = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    step = edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("s")).select("s.*").where("x <> y")  # edges are read once for both ways
    if max_hops < 3:  # up to two hops every edge of a path is at an end of the pair
        ends = left.select(F.col("a").alias("x")).union(left.select("b")).distinct()
        step = written(step.join(small(ends), "x", "left_semi").distinct(), "steps")  # few ends go to the edges, which need not move
    else:
        step = written_by(step, "x", "steps")  # dealt once: whatever asks for neighbours comes to them
    degree = written(step.groupBy("x").agg(F.count("*").alias("degree")), "degrees")
    found = [left.where("a = b").withColumn("hops", F.lit(0))]
    left = left.where("a <> b")
    reached = {"a": [], "b": []}

    def grown(side: str, depth: int) -> DataFrame:
        """(side, at): entities at just that depth from the ends of the pairs left when it was first asked for."""
        while len(reached[side]) <= depth:
            if not reached[side]:
                reached[side].append(left.select(side).distinct().withColumn("at", F.col(side)))
                continue
            more = dealt_like(reached[side][-1], "at").join(step.hint("merge"), F.col("at") == F.col("x")).select(side, F.col("y").alias("at")).distinct()
            for before in reached[side][-2:]:
                more = more.join(before.hint("merge"), [side, "at"], "left_anti")
            reached[side].append(written(more, "reached"))
        return reached[side][depth]

    for hop in range(1, max_hops + 1):
        if hop == 1:
            hit = dealt_like(left, "a").join(step.hint("merge"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("a", "b")
        elif hop == 2:
            ends = left.join(degree.select(F.col("x").alias("a"), F.col("degree").alias("da")).hint("merge"), "a").join(degree.select(F.col("x").alias("b"), F.col("degree").alias("db")).hint("merge"), "b")
            swap = F.col("da") > F.col("db")
            ends = ends.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("many"), "a", "b")
            out = dealt_like(ends, "few").join(step.hint("merge"), F.col("few") == F.col("x")).select("a", "b", "many", F.col("y").alias("at"))
            hit = dealt_like(out, "many").join(step.hint("merge"), (F.col("many") == F.col("x")) & (F.col("at") == F.col("y")), "left_semi").select("a", "b").distinct()
        elif hop == 3:
            hit = _third_hop(left, step, degree)
        else:
            from_a, from_b = grown("a", hop - hop // 2), grown("b", hop // 2)
            hit = left.join(from_a.hint("merge"), "a").join(from_b.hint("merge"), ["b", "at"]).select("a", "b").distinct()
        hit = written(hit, "hop")
        found.append(hit.withColumn("hops", F.lit(hop)))
        if hop < max_hops:
            left = written(left.join(hit.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    return found


def path_lengths(edges: DataFrame, pairs: DataFrame, max_hops: int = 2) -> DataFrame:
    """(a, b, hops): shortest undirected path of each pair, null beyond max_hops, one row for each pair given.

    Pairs meet in the middle: only ends of pairs are expanded, each once whatever the number of its pairs, and pairs
    found leave before the next hop. Up to two hops a middle entity (such as a hub) is a key to meet at; for the third
    pairs meet at the greatest hubs, then around ends that many of them share, and what is left asks one by one, a hub
    listing its neighbours only for a hub with more. Beyond three hops the entities reached from
    either end grow in turn, each end and entity once.
    """
    if max_hops < 0:
        raise ValueError("hops can't be negative")
    with met_by_part(edges.sparkSession):  # all that is found is written inside
        found = _found(edges, pairs, max_hops)
    return pairs.select("a", "b").join(reduce(DataFrame.union, found).hint("merge"), ["a", "b"], "left").select("a", "b", "hops")


#: Parts that the neighbours of an entity are dealt into: a hub is counted by as many tasks.
PARTS = 8


def neighbourhood(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, neighbors, avg_strength) of every entity; an isolated one has 0 and 0.0.

    Edges are read once for both ways and dealt once, by entity and a part of its neighbours: a neighbour's edges meet in
    one task, and what moves after that is a row a part.
    """
    way = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
    valued = edges.select("src", "dst", F.round(F.col("strength") * 1_000_000).cast("bigint").alias("millionths"))
    near = valued.select("millionths", F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("n")).select("n.id", "n.other", "millionths")
    part = F.pmod(F.xxhash64("other"), F.lit(PARTS))
    dealt = near.where("id is not null").repartition("id", part)  # the part is made again where rows arrive, so it does not move
    met = dealt.groupBy("id", part.alias("part"), "other").agg(F.sum("millionths").alias("total"), F.count("*").alias("n"))
    stats = met.groupBy("id").agg(F.count("other").alias("neighbors"), (F.sum("total") / F.sum("n") / 1_000_000).alias("avg_strength"))
    return entities.select("id").join(stats, "id", "left").fillna({"neighbors": 0, "avg_strength": 0.0})


def contains_search(entities: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """Entities whose name or alias contains each query (query_id, q): exact names first."""
    hits = containing(entities, [F.concat_ws(" ", "name", "alias")], queries, F.col("q"), "query_id")
    best = Window.partitionBy("query_id").orderBy((F.lower("name") == F.lower("q")).desc(), "name", "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "id", "name")


def cards(entities: DataFrame, edges: DataFrame, ids: DataFrame, top: int = 5) -> DataFrame:
    """One text for each id: its name and type, then its strongest edges in and out."""
    near = direct_context(edges, ids, top, 0.0).join(entities.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")
    line = F.format_string("%s %s %s", F.col("direction"), F.col("rel_type"), F.col("other_name"))
    lines = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("direction", "rank", line.alias("line")))).alias("rows"))
    head = F.concat(F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")"))
    return entities.join(ids, "id").join(lines, "id", "left").select("id", F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("card"), F.coalesce(F.size("rows"), F.lit(0)).alias("n_edges"))


def episode_links(mentions: DataFrame) -> DataFrame:
    """(entity_id, episodes, last_seen) of mentions (entity_id, episode_id, day): each episode of an entity once."""
    return mentions.groupBy("entity_id").agg(F.countDistinct("episode_id").alias("episodes"), F.max("day").alias("last_seen"))


def node_search(entities: DataFrame, part: str, entity_type: str | None = None, limit: int = 100) -> DataFrame:
    """Entities of a type whose name contains a text (case ignored), by name: a top-k report."""
    found = entities.where(F.lower("name").contains(part.lower()))
    if entity_type is not None:
        found = found.where(F.col("entity_type") == entity_type)
    return found.orderBy("name", "id").limit(limit)


def latest_relationships(edges: DataFrame, limit: int = 200) -> DataFrame:
    """The edges seen last: a top-k report."""
    return edges.orderBy(F.desc("last_day"), "src", "rel_type", "dst").limit(limit)
