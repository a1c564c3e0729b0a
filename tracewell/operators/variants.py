"""Branch variants of op trees, and the verdict of a trace against them.

A variant is the array of (kind, offset) accesses on one way through a module. Trees are
node tables; they are folded from the deepest level up, one grouped aggregate per level,
so a module costs what its own variants cost and modules are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.traces import align_calls, greedy_prefix
from tracewell.session import staged

VARIANTS = "array<array<struct<kind:string,offset:bigint>>>"
#: Variants multiply with every condition; a module with more is only marked, and ``automata`` serves it.
MOST_VARIANTS = 65_536
_ONE_EMPTY = f"CAST(array(array()) AS {VARIANTS})"
_NODES = "array<struct<ord:int,node_id:int,v:{}>>".format(VARIANTS)


def _product(children: Column) -> Column:
    """All concatenations of one variant of each child, in order, the first of equal ones kept."""
    ordered = F.array_sort(F.coalesce(children, F.expr(f"CAST(array() AS {_NODES})")))

    def joined_with(acc: Column, c: Column) -> Column:
        every = F.flatten(F.transform(acc, lambda p: F.transform(c["v"], lambda s: F.concat(p, s))))
        # null from here on
        return F.when(F.size(acc).cast("long") * F.size(c["v"]) <= MOST_VARIANTS, every)

    joined = F.aggregate(ordered, F.expr(_ONE_EMPTY), joined_with)
    return F.array_distinct(joined)


def _leaf() -> Column:
    def access(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col("offset").cast("bigint").alias("offset"))

    known = F.col("offset").isNotNull()
    rmw = F.when(known & (F.col("kind") == "ReadModifyWrite"), F.array(F.array(access("R"), access("W"))))
    one = F.when(known & F.col("kind").isin("Read", "Write"), F.array(F.array(access("X").withField("kind", F.substring("kind", 1, 1)))))
    return F.coalesce(rmw.cast(VARIANTS), one.cast(VARIANTS), F.expr(_ONE_EMPTY))


def branch_variants(nodes: DataFrame, module: list[str]) -> DataFrame:
    """(module..., variants, traceable, too_many) for each module of a node table.

    Needs node_id, parent_id, depth (0 at the top), branch, ord, kind and offset. Cond is
    the variants of ``then`` followed by those of ``else`` (a branch without ops is one
    empty variant); Seq is its body; Loop counts as empty, whatever is in it; a
    read-modify-write is a read and a write; an access without an offset is empty and
    makes the module untraceable. Variants that are empty at the end are left out. A module
    with over ``MOST_VARIANTS`` variants has ``too_many`` and null variants; ``automata``
    matches traces against it without listing them.
    """
    access = F.col("kind").isin("Read", "Write", "ReadModifyWrite")
    base = nodes.select(*module, "node_id", "parent_id", "depth", "branch", F.col("ord").cast("int").alias("ord"), "kind", _leaf().alias("v"), F.lit(False).alias("many"), (~F.coalesce(access, F.lit(False)) | F.col("offset").isNotNull()).alias("ok"))
    base = staged(base, "variants")
    deepest = base.agg(F.max("depth")).first()[0] or 0

    def grouped(level: DataFrame, by: list[str]) -> DataFrame:
        row = F.struct("ord", F.col("node_id").cast("int").alias("node_id"), "v")
        is_else = F.col("branch") == "else"
        return level.groupBy(*by).agg(_product(F.collect_list(F.when(~is_else, row))).alias("_then"), _product(F.collect_list(F.when(is_else, row))).alias("_else"), F.bool_and("ok").alias("_ok"), F.bool_or("many").alias("_many"))

    level = base.where(F.col("depth") == deepest)
    for d in range(deepest - 1, -1, -1):
        inner = grouped(level, [*module, "parent_id"]).withColumnRenamed("parent_id", "node_id")
        joined = base.where(F.col("depth") == d).join(inner, [*module, "node_id"], "left")
        empty = F.expr(_ONE_EMPTY)
        v = F.when(F.col("kind") == "Cond", F.concat(F.coalesce("_then", empty), F.coalesce("_else", empty))).when(F.col("kind") == "Seq", F.coalesce("_then", empty)).otherwise(F.col("v"))
        ok = F.col("ok") & F.when(F.col("kind").isin("Cond", "Seq"), F.coalesce("_ok", F.lit(True))).otherwise(F.lit(True))
        # a group without a product has too many; one without a group has no children
        many = F.col("_ok").isNotNull() & (F.coalesce("_many", F.lit(False)) | F.col("_then").isNull() | F.col("_else").isNull()) & F.col("kind").isin("Cond", "Seq")
        level = joined.withColumn("many", many).withColumn("v", F.when(F.col("many"), empty).otherwise(v)).withColumn("ok", ok).drop("_then", "_else", "_ok", "_many")
    too_many = F.coalesce("_many", F.lit(False)) | F.col("_then").isNull()
    return grouped(level, module).select(*module, F.when(~too_many, F.filter("_then", lambda x: F.size(x) > 0)).alias("variants"), F.col("_ok").alias("traceable"), too_many.alias("too_many"))


def match_calls(events: DataFrame, calls: DataFrame, variants: DataFrame, log: str) -> DataFrame:
    """One row per expected call: the segment it takes, the variant it fits best, and how far.

    ``events`` is what ``sources.logs.trace_events`` returns; ``calls`` has (log, call_no,
    formal, runtime); ``variants`` has (module, variants). A call takes the next unused
    segment of exactly its runtime name, and the variant that is complete, then matches
    most, then misses least, then comes first. Without a segment its shortest variant is
    missing as a whole. Calls of unknown modules, or of modules without variants, have a null ``expected``.
    """
    access = F.when(F.col("kind").isNotNull(), F.struct("line_no", F.struct("kind", "offset").alias("a")))
    seg = events.where("seg_id > 0").groupBy(log, "seg_id").agg(F.max("fn").alias("fn"), F.array_sort(F.collect_list(access))["a"].alias("actual"))
    names = seg.groupBy(log).agg(F.array_sort(F.collect_list(F.struct("seg_id", "fn")))["fn"].alias("_names"))
    asked = calls.groupBy(log).agg(F.array_sort(F.collect_list(F.struct("call_no", "formal", "runtime"))).alias("_calls"))
    empty = F.expr("CAST(array() AS array<string>)")
    placed = asked.join(names, log, "left").withColumn("_at", align_calls(F.col("_calls.runtime"), F.coalesce("_names", empty)))
    each = placed.select(log, F.inline(F.arrays_zip(F.col("_calls").alias("c"), F.col("_at").alias("seg_id")))).select(log, "c.*", F.col("seg_id").cast("bigint").alias("seg_id"))
    seg = seg.select(log, F.col("seg_id").cast("bigint").alias("seg_id"), "actual")
    known = variants.select(F.col("module").alias("formal"), "variants").where(F.size("variants") > 0)
    full = each.join(seg, [log, "seg_id"], "left").join(known, "formal", "left")

    def rated(v: Column, i: Column) -> Column:
        m = F.when(F.col("actual").isNull(), F.lit(0)).otherwise(greedy_prefix(F.col("actual"), v))
        first = F.when(F.col("seg_id").isNull(), -F.size(v)).otherwise(F.lit(0))
        return F.struct(first.alias("short"), (m == F.size(v)).alias("complete"), m.alias("matched"), (m - F.size(v)).alias("lack"), (-i).alias("place"), v.alias("expected"))

    best = full.withColumn("_b", F.array_max(F.transform("variants", rated)))
    return best.select(log, "call_no", "formal", "runtime", "seg_id", F.col("_b.expected").alias("expected"), F.col("_b.matched").alias("matched"), (-F.col("_b.lack")).alias("missing"))


def verdicts(matched: DataFrame, variants: DataFrame, events: DataFrame, log: str) -> DataFrame:
    """(log, verdict, calls, passed, ops, ops_matched, registers, registers_matched): one row per log.

    ``verdict`` is the first that holds of ``too many variants`` (see ``branch_variants``),
    ``unknown module``, ``untraceable``, ``no segments``, ``missing`` (a call lacks accesses)
    and ``ok``. A register counts as
    matched if it is in the variant of a call that lacks nothing.
    """
    many = F.col("too_many") if "too_many" in variants.columns else F.lit(False)
    bad = variants.where(~F.col("traceable") | many).select(F.col("module").alias("formal"), (~F.col("traceable")).alias("_bad"), many.alias("_many"))
    seen = events.where("seg_id > 0").select(log, F.lit(True).alias("_seen")).distinct()
    passed = F.col("missing") == 0
    offsets = F.transform("expected", lambda a: a["offset"])
    per = matched.join(bad, "formal", "left").groupBy(log).agg(
        F.bool_or(F.col("expected").isNull()).alias("_unknown"),
        F.coalesce(F.bool_or("_bad"), F.lit(False)).alias("_untraceable"),
        F.coalesce(F.bool_or("_many"), F.lit(False)).alias("_too_many"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(passed).alias("passed"),
        F.coalesce(F.sum(F.size("expected")), F.lit(0)).alias("ops"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("ops_matched"),
        F.size(F.array_distinct(F.flatten(F.collect_set(offsets)))).alias("registers"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(passed, offsets))))).alias("registers_matched"),
    )
    verdict = (
        F.when(F.col("_too_many"), "too many variants").when(F.col("_unknown"), "unknown module").when(F.col("_untraceable"), "untraceable").when(F.col("_seen").isNull(), "no segments")
        .when(F.col("passed") < F.col("calls"), "missing").otherwise("ok")
    )
    return per.join(seen, log, "left").select(log, verdict.alias("verdict"), "calls", "passed", "ops", "ops_matched", "registers", "registers_matched")
