"""Traces held against modules without listing their variants, and long logs aligned with calls.

The accesses of a module are positions. Which can come first, last and after one another
is put together from the leaves of its op tree up, so a module with any number of
conditions stays as large as its accesses and their pairs, although its variants are
2 to the number of conditions. A trace moves a frontier over the positions: for each, the
most accesses matched on a way that ends there.

Calls are aligned with the segments of a log by next occurrences: for each place of the
call before, where the name comes next. Places are looked up in blocks, and jumps over
1, 2, 4, ... calls are composed, so no log is gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.syntax import intervals
from tracewell.session import staged, staged_by

_INTS = "array<int>"
_PART = f"struct<first:{_INTS},last:{_INTS},empty:boolean,pairs:array<struct<a:int,b:int>>>"
_NOTHING = f"cast(named_struct('first', array(), 'last', array(), 'empty', true, 'pairs', array()) AS {_PART})"


def _sequence(children: Column) -> Column:
    """What a list of parts in order comes to: firsts, lasts, whether it can be empty, and which follow which."""

    def then(acc: Column, c: Column) -> Column:
        pairs = F.flatten(F.transform(acc["last"], lambda p: F.transform(c["first"], lambda q: F.struct(p.alias("a"), q.alias("b")))))
        return F.struct(
            F.when(acc["empty"], F.concat(acc["first"], c["first"])).otherwise(acc["first"]).alias("first"), F.when(c["empty"], F.concat(acc["last"], c["last"])).otherwise(c["last"]).alias("last"),
            (acc["empty"] & c["empty"]).alias("empty"), F.concat(acc["pairs"], c["pairs"], pairs).alias("pairs"),
        )

    return F.aggregate(children, F.expr(_NOTHING), then)


def automata(nodes: DataFrame, module: list[str]) -> DataFrame:
    """(module..., positions, empty, shortest, traceable) of each module of a node table.

    The nodes are those of ``variants.branch_variants``. ``positions`` are in order of the
    source: (kind, offset), ``before``, the places of what can come right before, whether it
    can be first (``start``) and last (``stop``), and ``rest``, the fewest accesses still to
    come after it. Nodes are dealt by module once; what follows from the staged ones moves no row. ``shortest`` is the length of the shortest variant that has accesses,
    null if there is none. A loop counts as empty.
    """
    key = F.struct(*module)
    beside = Window.partitionBy("_u", "parent").orderBy(F.coalesce(F.col("branch") == "else", F.lit(False)), "ord", "node")
    tree = nodes.select(key.alias("_u"), F.col("node_id").cast("long").alias("node"), F.col("parent_id").cast("long").alias("parent"), "branch", "ord", "kind", F.col("offset").cast("long").alias("offset"))
    dealt = tree.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_u")
    at = intervals(dealt.withColumn("ord", F.row_number().over(beside)), "_u")
    access = F.col("kind").isin("Read", "Write", "ReadModifyWrite")
    p, both = (F.col("pre") * 2).cast("int"), F.col("kind") == "ReadModifyWrite"
    leaf = F.when(access & F.col("offset").isNotNull(), F.struct(F.array(p).alias("first"), F.array(F.when(both, p + 1).otherwise(p)).alias("last"), F.lit(False).alias("empty"), F.when(both, F.array(F.struct(p.alias("a"), (p + 1).alias("b")))).otherwise(F.expr("cast(array() AS array<struct<a:int,b:int>>)")).alias("pairs")))
    base = at.select("_u", "node", "parent", "depth", "branch", "pre", "kind", F.coalesce(leaf.cast(_PART), F.expr(_NOTHING)).alias("v"), (~F.coalesce(access, F.lit(False)) | F.col("offset").isNotNull()).alias("ok"))
    deepest = at.agg(F.max("depth")).first()[0] or 0

    def folded(level: DataFrame, by: list[str]) -> DataFrame:
        row, other = F.struct("pre", "v"), F.coalesce(F.col("branch") == "else", F.lit(False))
        parts = level.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(~other, row))).alias("_t"), F.array_sort(F.collect_list(F.when(other, row))).alias("_e"), F.bool_and("ok").alias("_ok"))
        return parts.select(*by, _sequence(F.col("_t.v")).alias("_t"), _sequence(F.col("_e.v")).alias("_e"), "_ok")

    level = base.where(F.col("depth") == deepest)
    for d in range(deepest - 1, -1, -1):
        inner = folded(level, ["_u", "parent"]).withColumnRenamed("parent", "node")
        here = base.where(F.col("depth") == d).join(inner, ["_u", "node"], "left")
        nothing = F.expr(_NOTHING)
        t, e = F.coalesce("_t", nothing), F.coalesce("_e", nothing)
        choice = F.struct(*[F.concat(t[c], e[c]).alias(c) if c != "empty" else (t[c] | e[c]).alias(c) for c in ("first", "last", "empty", "pairs")])
        v = F.when(F.col("kind") == "Cond", choice).when(F.col("kind") == "Seq", t).otherwise(F.col("v"))
        inside = F.when(F.col("kind").isin("Cond", "Seq"), F.coalesce("_ok", F.lit(True))).otherwise(F.lit(True))
        level = here.select("_u", "node", "parent", "depth", "branch", "pre", "kind", v.alias("v"), (F.col("ok") & inside).alias("ok"))
    whole = staged_by(folded(level, ["_u"]).select("_u", F.col("_t").alias("v"), F.col("_ok").alias("traceable")), "wholes", "_u")
    rw = F.when(both, F.array(F.struct(p.alias("p"), F.lit("R").alias("kind")), F.struct((p + 1).alias("p"), F.lit("W").alias("kind")))).otherwise(F.array(F.struct(p.alias("p"), F.substring("kind", 1, 1).alias("kind"))))
    places = at.where(access & F.col("offset").isNotNull()).select("_u", "offset", F.explode(rw).alias("x")).select("_u", F.col("x.p").alias("p"), F.struct(F.col("x.kind").alias("kind"), "offset").alias("item"))
    pairs = whole.select("_u", F.explode("v.pairs").alias("x")).select("_u", "x.a", "x.b").distinct()
    before = pairs.groupBy("_u", F.col("b").alias("p")).agg(F.collect_list("a").alias("before"))
    after = pairs.groupBy("_u", F.col("a").alias("p")).agg(F.collect_list("b").alias("after"))
    ends = whole.select("_u", "v.first", "v.last")
    none = F.expr("cast(array() AS array<int>)")
    # accesses inside a loop are in no variant: they are neither first nor last, nor do they follow anything
    full = places.join(before, ["_u", "p"], "left").join(after, ["_u", "p"], "left").join(ends, "_u").select("_u", "p", "item", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"), F.array_contains("first", F.col("p")).alias("start"), F.array_contains("last", F.col("p")).alias("stop"))
    full = full.where(F.col("start") | F.col("stop") | (F.size("before") > 0) | (F.size("after") > 0))
    rows = full.groupBy("_u").agg(F.array_sort(F.collect_list(F.struct("p", "item", "before", "after", "start", "stop"))).alias("r"))
    # from the end: what follows a position comes later, so its rest is known
    rest = F.aggregate(F.reverse("r"), F.expr("cast(map() AS map<int, int>)"), lambda m, x: F.map_concat(m, F.create_map(x["p"], F.when(x["stop"], 0).otherwise(F.array_min(F.transform(x["after"], lambda q: m[q])) + 1))))
    rows = rows.withColumn("_rest", rest).withColumn("_places", F.col("r.p"))
    positions = F.transform("r", lambda x: F.struct(x["item"].alias("item"), F.transform(x["before"], lambda q: F.array_position("_places", q).cast("int") - 1).alias("before"), x["start"].alias("start"), x["stop"].alias("stop"), F.col("_rest")[x["p"]].alias("rest")))
    rows = rows.select("_u", positions.alias("positions"))
    got = whole.join(rows, "_u", "left").select(*[F.col(f"_u.{m}").alias(m) for m in module], "positions", F.col("v.empty").alias("empty"), "traceable")
    shortest = F.array_min(F.transform(F.filter("positions", lambda x: x["start"]), lambda x: x["rest"] + 1))
    return got.select(*module, "positions", "empty", shortest.alias("shortest"), "traceable")


def matched(actual: Column, positions: Column, shortest: Column) -> Column:
    """(complete, matched, missing) of the variant that a trace fits best; items of ``actual`` are (kind, offset).

    Complete first, then most matched, then fewest missing: as over all variants with
    accesses, each matched greedily.
    """
    start = F.transform(positions, lambda x: F.lit(-1))

    def step(best: Column, item: Column) -> Column:
        def moved(x: Column, i: Column) -> Column:
            come = F.greatest(F.when(x["start"], F.lit(0)).otherwise(F.lit(-1)), F.coalesce(F.array_max(F.transform(x["before"], lambda q: F.get(best, q))), F.lit(-1)))
            return F.when((x["item"]["kind"] == item["kind"]) & (x["item"]["offset"] == item["offset"]) & (come >= 0), F.greatest(F.get(best, i), come + 1)).otherwise(F.get(best, i))

        return F.transform(positions, moved)

    best = F.aggregate(actual, start, step)
    rated = F.transform(F.filter(F.arrays_zip(best.alias("m"), positions.alias("x")), lambda z: z["m"] >= 0), lambda z: F.struct(z["x"]["stop"].alias("complete"), z["m"].alias("matched"), F.when(z["x"]["stop"], 0).otherwise(-z["x"]["rest"]).alias("left")))
    none = F.struct(F.lit(False).alias("complete"), F.lit(0).alias("matched"), (-shortest).alias("left"))
    top = F.coalesce(F.array_max(F.concat(rated, F.array(none))), none)
    return F.struct(top["complete"].alias("complete"), top["matched"].alias("matched"), (-top["left"]).alias("missing"))


def next_occurrence(points: DataFrame, postings: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """``points`` (keys, at) with ``next``: the least place of ``postings`` (keys, at) after it, or null.

    Only places of one block meet in a window; over blocks it is their least places.
    """
    both = points.select(*keys, "at", F.lit(True).alias("_p")).distinct().unionByName(postings.select(*keys, "at", F.lit(False).alias("_p"))).withColumn("_b", F.expr(f"at div {block}"))
    posted = F.when(~F.col("_p"), F.col("at"))
    within = F.min(posted).over(Window.partitionBy(*keys, "_b").orderBy("at").rangeBetween(1, Window.unboundedFollowing))
    blocks = both.groupBy(*keys, "_b").agg(F.min(posted).alias("_m"))
    later = blocks.select(*keys, "_b", F.min("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    return both.withColumn("_in", within).where("_p").join(later, [*keys, "_b"]).select(*keys, "at", F.coalesce("_in", "_later").alias("next"))


def aligned(calls: DataFrame, segments: DataFrame, log: str) -> DataFrame:
    """(log, call_no, name, seg): for each call (log, call_no, name) the next unused segment (log, seg, name) of its name.

    Calls are numbered from 1 without gaps, segments from 1. The first call that finds none
    leaves nothing for those after it; the same as ``traces.align_calls`` on gathered logs.
    """
    calls = staged(calls.select(log, F.col("call_no").cast("long").alias("k"), "name"), "calls")
    seg = staged(segments.select(log, "name", F.col("seg").cast("long").alias("at")), "segments")
    previous = calls.select(log, (F.col("k") + 1).alias("k"), F.col("name").alias("_from"))
    steps = calls.join(previous, [log, "k"], "left")
    # the places after which a name is looked for: those of the call before, or the start
    points = steps.where("_from IS NULL").select(log, "k", "name", F.lit(0).cast("long").alias("at")).unionByName(steps.where("_from IS NOT NULL").join(seg.withColumnRenamed("name", "_from"), [log, "_from"]).select(log, "k", "name", "at"))
    found = next_occurrence(points.select(log, "name", "at").distinct(), seg, [log, "name"])
    jump = staged(points.join(found, [log, "name", "at"]).where("next IS NOT NULL").select(log, "k", "at", F.col("next").alias("to")), "jumps")
    known = staged(jump.where("k = 1").select(log, "k", F.col("to").alias("at")), "known")
    longest = calls.agg(F.max("k")).first()[0] or 0
    width = 1
    while width < longest:
        more = known.select(log, (F.col("k") + 1).alias("k"), "at").join(jump, [log, "k", "at"]).select(log, (F.col("k") + width - 1).alias("k"), F.col("to").alias("at"))
        known = staged(known.unionByName(more), "known")
        again = jump.select(log, (F.col("k") - width).alias("k"), F.col("at").alias("to"), F.col("to").alias("_to"))
        jump = staged(jump.join(again, [log, "k", "to"]).select(log, "k", "at", F.col("_to").alias("to")), "jumps")
        width *= 2
    return calls.join(known, [log, "k"], "left").select(log, F.col("k").alias("call_no"), "name", F.col("at").alias("seg"))
