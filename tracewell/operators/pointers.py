"""What pointers may point to, by inclusion, over assignments as rows.

Assignments are of four kinds: p = &o (``address``), p = q (``copy``), p = *q (``load``)
and *p = q (``store``). A copy makes p point to all that q does; loads and stores become
copies of the objects that are pointed to. The fixpoint is semi-naive: a round joins what
the round before added, facts or copies, with the rest, and never repeats a join of old
rows. Variables that copy each other in a cycle point to the same, so they are one from
the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.graphs import components
from tracewell.session import staged


def points_to(assignments: DataFrame, rounds: int | None = None) -> DataFrame:
    """(pointer, object) for every object that a pointer may point to.

    ``assignments`` has (kind, left, right), names that are distinct program-wide; rows
    with a null are left out. Variables and objects share one space of names, as an
    object is what a load or store through it reads or sets.

    With ``rounds`` it is what so many rounds find that each take one step along the copies
    known before it, and no fixpoint where that takes more; cycles are then no one variable.
    """
    if rounds is not None:
        return _stepped(assignments, rounds)
    rows = staged(assignments.where("left IS NOT NULL AND right IS NOT NULL").select("kind", "left", "right").distinct(), "assignments")
    of = lambda kind, *names: rows.where(F.col("kind") == kind).select(F.col("left").alias(names[0]), F.col("right").alias(names[1]))
    same = staged(components(of("copy", "p", "q"), "q", "p").where("node <> component"), "same")
    name = lambda df, c: df.join(same.select(F.col("node").alias(c), F.col("component").alias("_c")), c, "left").withColumn(c, F.coalesce("_c", F.col(c))).drop("_c")
    merged = lambda df, a, b: name(name(df, a), b).select(a, b).distinct()
    loads, stores = staged(merged(of("load", "p", "q"), "p", "q"), "loads"), staged(merged(of("store", "p", "q"), "p", "q"), "stores")
    # objects keep their names; where one is copied as a variable it goes by its component's
    facts = new_facts = staged(name(of("address", "p", "o"), "p").select("p", "o").distinct(), "facts")
    copies = new_copies = staged(merged(of("copy", "p", "q"), "p", "q").where("p <> q"), "copies")
    first = True
    while first or not (new_facts.isEmpty() and new_copies.isEmpty()):
        first = False
        by_load = loads.join(new_facts.select(F.col("p").alias("q"), "o"), "q").select("p", F.col("o").alias("q"))
        by_store = stores.join(new_facts, "p").select(F.col("o").alias("p"), "q")
        more = merged(by_load.unionByName(by_store), "p", "q").where("p <> q")
        made = staged(more.join(copies, ["p", "q"], "left_anti"), "copies")
        every = staged(copies.unionByName(made), "copies")
        # old copies of new facts, and new copies of all facts
        moved = every.join(new_facts.select(F.col("p").alias("q"), "o"), "q").select("p", "o").union(new_copies.unionByName(made).join(facts.select(F.col("p").alias("q"), "o"), "q").select("p", "o")).distinct()
        new_facts = staged(moved.join(facts, ["p", "o"], "left_anti"), "facts")
        facts, copies, new_copies = staged(facts.unionByName(new_facts), "facts"), every, made
    members = same.select(F.col("component").alias("p"), F.col("node").alias("pointer"))
    return facts.select(F.col("p").alias("pointer"), F.col("o").alias("object")).union(facts.join(members, "p").select("pointer", "o")).distinct()


def _stepped(assignments: DataFrame, rounds: int) -> DataFrame:
    """(pointer, object) after that many rounds of one step each, all on what was known before the round."""
    rows = staged(assignments.where("left IS NOT NULL AND right IS NOT NULL").select("kind", "left", "right").distinct(), "assignments")
    of = lambda kind, *names: rows.where(F.col("kind") == kind).select(F.col("left").alias(names[0]), F.col("right").alias(names[1]))
    loads, stores = of("load", "p", "q"), of("store", "p", "q")
    facts = new_facts = staged(of("address", "p", "o"), "facts")
    copies = new_copies = staged(of("copy", "p", "q"), "copies")
    for k in range(rounds):
        if k and new_facts.isEmpty() and new_copies.isEmpty():
            break
        told = new_facts.select(F.col("p").alias("q"), "o")
        moved = copies.join(told, "q").select("p", "o")
        if k:  # in the first round all copies and facts are new
            moved = moved.union(new_copies.join(facts.select(F.col("p").alias("q"), "o"), "q").select("p", "o"))
        by_load = loads.join(told, "q").select("p", F.col("o").alias("q"))
        by_store = stores.join(new_facts, "p").select(F.col("o").alias("p"), "q")
        made = staged(by_load.unionByName(by_store).distinct().join(copies, ["p", "q"], "left_anti"), "copies")
        new_facts = staged(moved.distinct().join(facts, ["p", "o"], "left_anti"), "facts")
        facts, copies, new_copies = facts.unionByName(new_facts), copies.unionByName(made), made
    return facts.select(F.col("p").alias("pointer"), F.col("o").alias("object"))


def aliases(pointed: DataFrame, origins: DataFrame) -> DataFrame:
    """(pointer, origin): pointers that may point to what a given one does, other than itself."""
    named = origins.select(F.col("pointer").alias("origin")).distinct()
    own = pointed.join(named.withColumnRenamed("origin", "pointer"), "pointer", "left_semi").select(F.col("pointer").alias("origin"), "object")
    return pointed.join(own, "object").where("pointer <> origin").select("pointer", "origin").distinct()
