"""Syntax trees as node tables: interval labels, enclosing nodes, control flow, guards.

A node row is (unit, node, parent, ord, kind, ...); a tree of any depth is labelled
without recursion, by pointer doubling: pre-order numbers are sums of sibling offsets
along the chains of ancestors. After that an ancestor is a node whose interval [pre, last]
holds a position, and everything that asks for the nearest one (of a kind) is one binned
range join. Labelled nodes are staged in buckets of the unit, so the joins that follow,
which all have the unit among their keys, move nothing.

Statements are nodes whose ``branch`` says in which list of its parent they stand
(then, else, body); ``ord`` orders siblings. Where one file or parent has very many
nodes (over ``GATHERED``), no step gathers them: chains come from log d joins and are as
long as the nesting, and running sums are made over blocks of siblings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import ship, staged, staged_by

LOOPS = ("for", "while", "do")
#: Node numbers that stand for where a function is entered and left.
ENTRY, EXIT = -1, -2
#: Units of up to so many nodes are labelled in one array each; larger ones by joins.
GATHERED = 100_000


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over rows of equal keys before this one in ``order``, an integer.

    Sums are made within blocks of ``order`` and over the blocks' totals, so a key of any
    number of rows is no single task's work. Rows of equal ``order`` do not count each other.
    """
    cut = df.withColumn("_block", F.expr(f"{order} div {block}"))
    totals = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return cut.join(start, same).select(*df.columns, (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(name))


def ancestors(nodes: DataFrame, unit: str) -> DataFrame:
    """(unit, node, chain): the nodes above each node, its parent first. Parents in a cycle are an error."""
    parent = F.when(F.col("parent").isNull(), F.expr("cast(array() AS array<bigint>)")).otherwise(F.array(F.col("parent").cast("long")))
    at = staged_by(nodes.select(unit, F.col("node").cast("long").alias("node"), parent.alias("chain")), "chains", unit)
    while True:
        up = at.select(unit, F.col("node").alias("_top"), F.col("chain").alias("_more")).where("size(_more) > 0")
        longer = at.withColumn("_top", F.when(F.size("chain") > 0, F.element_at("chain", -1))).join(up, [unit, "_top"], "left")
        new = staged_by(longer.select(unit, "node", F.when(F.col("_more").isNull(), F.col("chain")).otherwise(F.concat("chain", "_more")).alias("chain"), F.col("_more").isNotNull().alias("grew")), "chains", unit)
        grew, cyclic = new.agg(F.coalesce(F.max("grew"), F.lit(False)), F.coalesce(F.max(F.array_contains("chain", F.col("node"))), F.lit(False))).first()
        if cyclic:
            raise ValueError("parents form a cycle")
        at = new.drop("grew")
        if not grew:
            return at


def intervals(nodes: DataFrame, unit: str, gathered: int = GATHERED) -> DataFrame:
    """The nodes with ``pre``, their place in pre-order from 0, ``last``, that of the last node below, and ``depth``.

    Siblings are in the order of ``ord``, whole numbers that are distinct under one parent;
    several nodes without a parent are siblings. Node numbers are distinct in a unit. A
    parent that is no node of the unit counts as one above it, and its children as roots.
    Rows without a unit or node are left out. The result is staged in buckets of the unit.
    """
    ship(nodes.sparkSession)
    known = staged_by(nodes.where(F.col(unit).isNotNull() & F.col("node").isNotNull()), "nodes", unit)
    large = known.groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > gathered).select(unit)
    rest = [c for c in known.columns if c != unit]
    units = known.groupBy(unit).agg(F.collect_list(F.struct(*rest)).alias("_r")).where(F.size("_r") <= gathered)
    labels = F.arrow_udf(_labels, "array<struct<pre: bigint, last: bigint, depth: int>>")
    each = units.withColumn("_l", labels(*[F.col(f"_r.{c}").cast("array<bigint>") for c in ("node", "parent", "ord")])).select(unit, F.inline(F.arrays_zip("_r", "_l")))
    columns = [unit, "node", *[c for c in rest if c != "node"]]
    out = each.select(unit, *[F.col(f"_r.{c}").alias(c) for c in columns[1:]], "_l.*")
    if not large.isEmpty():
        out = out.unionByName(_joined_intervals(staged(known.join(large, unit, "left_semi"), "large"), unit).select(*out.columns))
    out = staged_by(out, "labelled", unit)
    if not out.where("pre < 0").isEmpty():
        raise ValueError("parents form a cycle")
    return out


def _labels(nodes: pa.Array, parents: pa.Array, ords: pa.Array) -> pa.Array:
    """(pre, last, depth) of each node of each unit; pre is -1 for what a cycle of parents holds."""
    ends = np.concatenate([[0], np.cumsum(nodes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    n = int(ends[-1])
    number = lambda a: a.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    unit = np.repeat(np.arange(len(nodes)), np.diff(ends))
    _, names = np.unique(np.concatenate([number(nodes), number(parents)]), return_inverse=True)
    none = parents.flatten().is_null().to_numpy(zero_copy_only=False)
    own = unit * (2 * n + 1) + names[:n]
    above = unit * (2 * n + 1) + np.where(none, 2 * n, names[n:])
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], above), max(0, n - 1))
    parent = np.where(own[order][at] == above, order[at], -1) if n else np.empty(0, np.int64)

    def along(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of values of a node and all above it, and which nodes have a cycle above."""
        total, up = values.copy(), parent.copy()
        for _ in range(n.bit_length() + 1):
            has = np.flatnonzero(up >= 0)
            if not len(has):
                break
            total[has] += total[up[has]]
            up[has] = up[up[has]]
        return total, up >= 0

    depth, cyclic = along((parent >= 0).astype(np.int64))
    size = np.ones(n, np.int64)
    levels = np.argsort(np.where(cyclic, 0, depth), kind="stable")
    starts = np.searchsorted(np.where(cyclic, 0, depth)[levels], np.arange(1, (depth[~cyclic].max() if (~cyclic).any() else 0) + 2))
    for k in range(len(starts) - 2, -1, -1):
        level = levels[starts[k] : starts[k + 1]]
        np.add.at(size, parent[level], size[level])
    # what stands before a node under its parent; equal places do not count each other
    order_of = number(ords)
    beside = np.lexsort((order_of, above))
    before = np.empty(n, np.int64)
    if n:
        sums = np.cumsum(size[beside]) - size[beside]
        group = np.concatenate([[True], above[beside][1:] != above[beside][:-1]])
        tie = group | np.concatenate([[True], order_of[beside][1:] != order_of[beside][:-1]])
        first = lambda marks: np.maximum.accumulate(np.where(marks, np.arange(n), 0))
        before[beside] = sums[first(tie)] - sums[first(group)]
    pre = np.where(cyclic, -1, along(before + (parent >= 0))[0])
    rows = pa.StructArray.from_arrays([pa.array(pre), pa.array(pre + size - 1), pa.array(depth.astype(np.int32))], ["pre", "last", "depth"])
    return pa.ListArray.from_arrays(pa.array(ends), rows)


def _joined_intervals(nodes: DataFrame, unit: str) -> DataFrame:
    """As ``intervals``, by joins that gather no unit."""
    chains = ancestors(nodes, unit)
    below = chains.select(unit, F.explode("chain").alias("node")).groupBy(unit, "node").agg(F.count(F.lit(1)).alias("_below"))
    sized = nodes.join(below, [unit, "node"], "left").withColumn("_size", F.coalesce("_below", F.lit(0)) + 1)
    before = staged(running_total(sized.select(unit, "node", "parent", "ord", "_size"), [unit, "parent"], "ord", "_size", "_before").select(unit, "node", "_size", "_before"), "sizes")
    steps = chains.select(unit, F.col("node").alias("_of"), F.explode(F.concat(F.array("node"), "chain")).alias("node")).join(before, [unit, "node"])
    place = steps.groupBy(unit, F.col("_of").alias("node")).agg((F.sum("_before") + F.count(F.lit(1)) - 1).alias("pre"), (F.count(F.lit(1)) - 1).cast("int").alias("depth"))
    return nodes.join(place.join(before.select(unit, "node", "_size"), [unit, "node"]).select(unit, "node", "pre", (F.col("pre") + F.col("_size") - 1).alias("last"), "depth"), [unit, "node"])


def enclosing(points: DataFrame, scopes: DataFrame, unit: str, values: dict[str, Column], own: bool = False, width: int = 64) -> DataFrame:
    """(unit, node, values) of the innermost scope around each point, for those that have one.

    Points have (unit, node, pre), scopes (unit, pre, last, depth); ``own`` lets a point be
    its own scope. Intervals are cut into bins of ``width`` places, so both sides of the
    join are spread evenly and a point only meets scopes that are near.
    """
    return _around(points, scopes, unit, values, own, width).groupBy(unit, "node").agg(F.max_by("_v", "_d").alias("_v")).select(unit, "node", *[F.col(f"_v.{n}").alias(n) for n in values])


def _around(points: DataFrame, scopes: DataFrame, unit: str, values: dict[str, Column], own: bool, width: int = 64) -> DataFrame:
    """(unit, node, _d, _v): each point with every scope around it, its depth and values."""
    binned = scopes.select(unit, F.col("pre").alias("_a"), F.col("last").alias("_z"), F.col("depth").alias("_d"), F.struct(*[v.alias(n) for n, v in values.items()]).alias("_v"), F.explode(F.expr(f"sequence(pre div {width}, last div {width})")).alias("_bin"))
    inside = (F.col("_a") <= F.col("pre") if own else F.col("_a") < F.col("pre")) & (F.col("pre") <= F.col("_z"))
    return points.select(unit, "node", "pre", F.expr(f"pre div {width}").alias("_bin")).join(binned, [unit, "_bin"]).where(inside)


#: The shape of an assignment, as the text of the node that makes it.
_ASSIGNS = r"(?s)^\s*(.+?)\s*(=|\+=|-=|\|=|&=|\^=|<<=|>>=)\s*(?!=)"


def ancestor_access_kind(labelled: DataFrame, unit: str) -> DataFrame:
    """(unit, node, access_kind) of the dereferences: write, rmw or read by what stands above them.

    Needs ``text`` and the labels. A dereference is written if some binary operator above
    it assigns to exactly it, with or without parentheses around; otherwise it is read and
    written if its parent or the node above that has ++ or --; otherwise read.
    """
    derefs = labelled.where("kind = 'deref'")
    bare = lambda c: F.regexp_replace(c, r"^[()]+|[()]+$", "")
    operators = labelled.where("kind = 'binary'").withColumn("_lhs", bare(F.trim(F.regexp_extract(F.trim("text"), _ASSIGNS, 1)))).where("_lhs <> ''")
    written = _around(derefs, operators, unit, {"lhs": F.col("_lhs")}, False).join(derefs.select(unit, "node", bare(F.trim("text")).alias("_own")), [unit, "node"])
    written = written.where(F.col("_v.lhs") == F.col("_own")).select(unit, "node", F.lit("write").alias("_w")).distinct()
    steps = labelled.where("text LIKE '%++%' OR text LIKE '%--%'")
    stepped = _around(derefs, steps, unit, {"depth": F.col("depth")}, False)
    stepped = stepped.join(derefs.select(unit, "node", F.col("depth").alias("_own")), [unit, "node"]).where("_own - _d <= 2").select(unit, "node", F.lit("rmw").alias("_m")).distinct()
    return derefs.select(unit, "node").join(written, [unit, "node"], "left").join(stepped, [unit, "node"], "left").select(unit, "node", F.coalesce("_w", "_m", F.lit("read")).alias("access_kind"))


def control_scopes(labelled: DataFrame, unit: str) -> DataFrame:
    """(unit, pre, last, depth, kind, guard, branch): the parts of the tree that a condition or loop governs.

    Statements need ``branch`` and ``text``, the condition. The branches of an ``if`` are
    governed by it or its negation, a loop by its own condition, statements after a
    ``case`` or ``default``, up to a ``break`` beside them, by the switch having its values
    (``text`` joined by `` | ``). Without a condition there is no scope.
    """
    parents = labelled.select(unit, F.col("node").alias("parent"), F.col("kind").alias("_pk"), F.trim(F.coalesce("text", F.lit(""))).alias("_pt"))
    child = labelled.join(parents, [unit, "parent"])
    taken = child.where("_pk = 'if' AND branch IN ('then', 'else') AND _pt <> ''").select(
        unit, "pre", "last", "depth", F.lit("cond").alias("kind"), F.when(F.col("branch") == "then", F.col("_pt")).otherwise(F.concat(F.lit("!("), "_pt", F.lit(")"))).alias("guard"), "branch"
    )
    loops = labelled.where(F.col("kind").isin(*LOOPS) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select(unit, "pre", "last", "depth", F.lit("loop").alias("kind"), F.trim("text").alias("guard"), F.col("kind").alias("branch"))
    body = child.where("_pk = 'switch' AND branch = 'body'")
    order = Window.partitionBy(unit, "parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("kind").isin("case", "default", "break"), F.struct("kind", "text"))
    values = body.where("kind = 'case'").groupBy(unit, "parent").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.split(x["text"], r" \| ")))).alias("_all"))
    test = lambda vs: F.array_join(F.transform(vs, lambda v: F.concat(F.lit("(("), "_pt", F.lit(") == ("), v, F.lit("))"))), " || ")
    cased = body.withColumn("_at", F.last(mark, ignorenulls=True).over(order)).where("kind NOT IN ('case', 'default') AND _at.kind IN ('case', 'default')").join(values, [unit, "parent"], "left")
    none = F.when(F.col("_all").isNull(), "1").otherwise(F.concat(F.lit("!("), test(F.col("_all")), F.lit(")")))
    cases = cased.select(unit, "pre", "last", "depth", F.lit("cond").alias("kind"), F.when(F.col("_at.kind") == "case", test(F.split("_at.text", r" \| "))).otherwise(none).alias("guard"), F.col("_at.kind").alias("branch"))
    return taken.unionByName(loops).unionByName(cases)


def control_frames(labelled: DataFrame, unit: str, of: Column) -> DataFrame:
    """(unit, node, frames) of the nodes for which ``of`` holds: what governs them, outermost first.

    A frame is (kind, guard, branch). A loop governs itself as well; nodes that nothing
    governs have no frames.
    """
    points = labelled.where(of)
    around = _around(points, control_scopes(labelled, unit), unit, {n: F.col(n) for n in ("kind", "guard", "branch")}, True)
    stacks = around.groupBy(unit, "node").agg(F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_s"))
    empty = F.expr("cast(array() AS array<struct<kind: string, guard: string, branch: string>>)")
    return points.select(unit, "node").join(stacks, [unit, "node"], "left").select(unit, "node", F.coalesce(F.transform("_s", lambda x: x["_v"]), empty).alias("frames"))


def _successors(labelled: DataFrame, unit: str) -> DataFrame:
    """(unit, node, _next): the statement that runs when a statement is done, from the innermost enclosing list that goes on."""
    beside = Window.partitionBy(unit, "parent", "branch").orderBy("ord")
    kinds = labelled.select(unit, F.col("node").alias("parent"), F.col("kind").alias("_pk"))
    known = labelled.withColumn("_beside", F.lead("node").over(beside)).join(kinds, [unit, "parent"], "left")
    goes = F.coalesce(F.col("_beside"), F.when(F.col("_pk").isNull(), F.lit(EXIT)), F.when(F.col("_pk").isin(*LOOPS), F.col("parent")))
    return enclosing(labelled, known.withColumn("_goes", goes).where("_goes IS NOT NULL"), unit, {"_next": F.col("_goes").cast("long")}, own=True)


def cfg_edges(labelled: DataFrame, unit: str) -> DataFrame:
    """(unit, src, dst, kind, guard) of the control-flow graph of each unit's statements.

    Each statement is a block. Needs the labels, ``branch``, and ``text``: the condition,
    the label's name, or where a goto goes. ``ENTRY`` leads to the first statement and
    what ends leads to ``EXIT``. A transfer whose target is not there has a null dst.
    Statements inside a ``case`` row are not looked at; those beside it are.
    """
    nodes = staged_by(labelled.join(_successors(labelled, unit), [unit, "node"], "left").withColumn("_next", F.coalesce("_next", F.lit(EXIT).cast("long"))), "statements", unit)
    ranked = Window.partitionBy(unit, "parent", "branch").orderBy("ord")
    firsts = nodes.withColumn("_r", F.row_number().over(ranked)).where("_r = 1")
    first = lambda b: firsts.where(F.col("branch") == b).select(unit, F.col("parent").alias("node"), F.col("node").alias(f"_{b}"))
    loops = F.col("kind").isin(*LOOPS)
    ends = enclosing(nodes.where("kind = 'break'"), nodes.where(loops | (F.col("kind") == "switch")), unit, {"_break": F.col("_next")})
    again = enclosing(nodes.where("kind = 'continue'"), nodes.where(loops), unit, {"_again": F.col("node")})
    labels = nodes.where("kind = 'label'").groupBy(unit, F.col("text").alias("_label")).agg(F.max_by(F.struct("node", "pre"), "pre").alias("_l"))
    full = nodes
    for b in ("then", "else", "body"):
        full = full.join(first(b), [unit, "node"], "left")
    full = full.join(ends, [unit, "node"], "left").join(again, [unit, "node"], "left").withColumn("_label", F.when(F.col("kind") == "goto", F.col("text"))).join(labels, [unit, "_label"], "left")
    cond = F.coalesce(F.trim("text"), F.lit(""))
    edge = lambda dst, kind, guard=None: F.struct(dst.cast("long").alias("dst"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (F.lit(None).cast("string") if guard is None else guard).alias("guard"))
    no = F.concat(F.lit("!("), cond, F.lit(")"))
    after = F.col("_next")
    out = (
        F.when(F.col("kind") == "if", F.array(edge(F.coalesce("_then", after), "branch-true", cond), edge(F.coalesce("_else", after), "branch-false", no)))
        .when(loops, F.array(edge(F.coalesce("_body", F.col("node")), "loop-body", cond), edge(after, "loop-exit", no)))
        .when(F.col("kind") == "switch", F.array(edge(F.coalesce("_body", after), "switch-dispatch", cond), edge(after, "switch-exit")))
        .when(F.col("kind") == "label", F.array(edge(F.coalesce("_body", after), "label-fallthrough")))
        .when(F.col("kind") == "return", F.array(edge(F.lit(EXIT), "return")))
        .when(F.col("kind") == "break", F.array(edge(F.col("_break"), "break")))
        .when(F.col("kind") == "continue", F.array(edge(F.col("_again"), "continue")))
        .when(F.col("kind") == "goto", F.array(edge(F.col("_l.node"), F.when(F.col("_l.pre") > F.col("pre"), "goto-forward").when(F.col("_l.pre").isNotNull(), "goto-backward").otherwise("goto"))))
        .otherwise(F.array(edge(after, "fallthrough")))
    )
    entries = nodes.where("pre = 0").select(unit, F.lit(ENTRY).cast("long").alias("src"), F.col("node").cast("long").alias("dst"), F.lit("entry").alias("kind"), F.lit(None).cast("string").alias("guard"))
    return full.select(unit, F.col("node").cast("long").alias("src"), F.explode(out).alias("e")).select(unit, "src", "e.*").distinct().unionByName(entries)


def negated(condition: str) -> str:
    """SQL of a condition's negation: a leading ! goes, with the parentheses around the rest."""
    inner = f"trim(substr({condition}, 2))"
    return f"CASE WHEN {condition} LIKE '!%' AND {condition} NOT LIKE '!=%' THEN CASE WHEN {inner} LIKE '(%' AND {inner} LIKE '%)' THEN trim(substr({inner}, 2, length({inner}) - 2)) ELSE {inner} END ELSE concat('!(', {condition}, ')') END"


def provable(condition: Column, params: Column) -> Column:
    """Whether a condition only has parameters, constants in capitals and true or false: no members, elements, calls or dereferences."""
    plain = ~condition.rlike(r"->|\.|\[|\]|\*\s*[A-Za-z_]\w*|\b[A-Za-z_]\w*\s*\(")
    names = F.regexp_extract_all(condition, F.lit(r"\b([A-Za-z_]\w*)\b"), 1)
    return plain & F.forall(names, lambda n: F.array_contains(params, n) | (n.rlike("[A-Z]") & ~n.rlike("[a-z]")) | n.isin("true", "false"))


def terminating(labelled: DataFrame, unit: str) -> DataFrame:
    """(unit, parent, branch) of the statement lists that always return: with a return in them, or an if both of whose branches do."""
    done = staged_by(labelled.where("kind = 'return'").select(unit, "parent", "branch").distinct(), "ends", unit)
    ifs = labelled.where("kind = 'if'").select(unit, F.col("node").alias("_if"), "parent", "branch")
    while True:
        both = done.where("branch IN ('then', 'else')").groupBy(unit, F.col("parent").alias("_if")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
        more = ifs.join(both, [unit, "_if"], "left_semi").select(unit, "parent", "branch").distinct()
        on = (F.col(unit) == F.col("_u")) & F.col("parent").eqNullSafe(F.col("_p")) & F.col("branch").eqNullSafe(F.col("_b"))
        new = staged_by(more.join(done.select(F.col(unit).alias("_u"), F.col("parent").alias("_p"), F.col("branch").alias("_b")), on, "left_anti"), "ends", unit)
        if new.isEmpty():
            return done
        done = staged_by(done.unionByName(new), "ends", unit)


def _cascades(labelled: DataFrame, params: DataFrame, unit: str) -> DataFrame:
    """(unit, node, last, s, b) of the if cascades at the top of a unit that rest on parameters only and some branch of which returns.

    ``s`` are the ifs in order with what they test and whether their branches return, ``b``
    the branches' guards, the last one for none of the tests.
    """
    ends = terminating(labelled, unit)
    ended = lambda b: ends.where(F.col("branch") == b).select(unit, F.col("parent").alias("node"), F.lit(True).alias(f"_{b}_ends"))
    lists = labelled.where("branch = 'else'").groupBy(unit, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("node", "kind")).alias("_e"))
    single = lists.where("_n = 1 AND _e.kind = 'if'").select(unit, F.col("_e.node").alias("node"), F.col("node").alias("parent"))
    ifs = labelled.where("kind = 'if'").select(unit, "node", "last", F.trim(F.coalesce("text", F.lit(""))).alias("_c"), F.col("parent").isNull().alias("_top"))
    chains = ancestors(ifs.select(unit, "node").join(single, [unit, "node"], "left"), unit)
    steps = ifs.join(chains, [unit, "node"]).join(ended("then"), [unit, "node"], "left").join(ended("else"), [unit, "node"], "left")
    steps = steps.join(single.select(unit, F.col("parent").alias("node"), F.lit(True).alias("_goes_on")), [unit, "node"], "left").join(params, unit, "left")
    root = F.when(F.size("chain") > 0, F.element_at("chain", -1)).otherwise(F.col("node"))
    no = F.lit(False)
    step = F.struct(F.size("chain").alias("k"), F.col("node").alias("n"), F.col("_c").alias("c"), F.coalesce("_then_ends", no).alias("t"), (F.coalesce("_else_ends", no) & ~F.coalesce("_goes_on", no)).alias("e"), provable(F.col("_c"), F.coalesce("params", F.expr("cast(array() AS array<string>)"))).alias("ok"))
    cascades = steps.groupBy(unit, root.alias("node")).agg(F.array_sort(F.collect_list(step)).alias("s"))
    cascades = cascades.join(ifs.where("_top").select(unit, "node", "last"), [unit, "node"]).where("forall(s, x -> x.ok)")
    not_ = negated("x.c")
    lead = f"transform(slice(s, 1, i), x -> concat('(', {not_}, ')'))"
    taken = f"transform(sequence(0, size(s) - 1), i -> named_struct('g', array_join(concat({lead}, array(concat('(', s[i].c, ')'))), ' && '), 'x', s[i].t))"
    rest = f"array(named_struct('g', array_join(transform(s, x -> concat('(', {not_}, ')')), ' && '), 'x', element_at(s, -1).e))"
    return cascades.withColumn("b", F.expr(f"concat({taken}, {rest})")).where("exists(b, x -> x.x)")


def continuation_guards(labelled: DataFrame, params: DataFrame, unit: str) -> DataFrame:
    """(unit, after, before, guard, branch, source): what holds after an early exit, in pre-order places.

    A guard holds for nodes whose ``pre`` is over ``after`` and, unless ``before`` is null,
    under it. Statements at the top of a unit are looked at: an if cascade some branches of
    which return leaves the condition of those that do not (0 if none is left), a switch
    with returning cases that of the others, a return leaves nothing. ``params``
    (unit, params) has the names that a condition may rest on; one on anything else says
    nothing. A forward goto negates what governs it, up to its label.

    An else whose list is a single if continues the cascade.
    """
    left = F.expr("filter(b, x -> NOT x.x)")
    guard = F.when(F.size(left) == 0, "0").otherwise(F.array_join(F.transform(left, lambda x: F.concat(F.lit("("), x["g"], F.lit(")"))), " || "))
    row = lambda after, before, g, branch, source: [F.col(unit), after.alias("after"), before.cast("long").alias("before"), g.alias("guard"), F.lit(branch).alias("branch"), F.lit(source).alias("source")]
    none = F.lit(None)
    by_if = _cascades(labelled, params, unit).select(*row(F.col("last"), none, guard, "continuation", "early-exit"))
    by_return = labelled.where("kind = 'return' AND parent IS NULL").select(*row(F.col("last"), none, F.lit("0"), "unreachable", "early-exit"))
    by_switch = _switch_exits(labelled, params, unit).select(*row(F.col("last"), none, F.col("guard"), "continuation", "switch-exit"))
    held = control_frames(labelled, unit, F.col("kind") == "goto")
    taken_guard = F.when(F.size("frames") == 0, "1").otherwise(F.array_join(F.transform("frames", lambda f: F.concat(F.lit("("), f["guard"], F.lit(")"))), " && "))
    by_goto = _forward_gotos(labelled, unit).join(held, [unit, "node"]).withColumn("_g", taken_guard).select(*row(F.col("last"), F.col("_to"), F.expr(negated("_g")), "fallthrough", "forward-goto"))
    return by_if.unionByName(by_return).unionByName(by_switch).unionByName(by_goto)


def _forward_gotos(labelled: DataFrame, unit: str) -> DataFrame:
    """(unit, node, last, _to): the gotos whose label comes later, and its place."""
    gotos = labelled.where("kind = 'goto'").select(unit, "node", "pre", "last", F.col("text").alias("_label"))
    labels = labelled.where("kind = 'label'").groupBy(unit, F.col("text").alias("_label")).agg(F.max("pre").alias("_to"))
    return gotos.join(labels, [unit, "_label"]).where("_to > pre").select(unit, "node", "last", "_to")


def modeled_transfers(labelled: DataFrame, params: DataFrame, unit: str) -> DataFrame:
    """(unit, node) of the returns and gotos that continuation guards speak for."""
    steps = _cascades(labelled, params, unit).select(unit, F.explode("s").alias("x")).select(unit, F.col("x.n").alias("parent"), F.explode(F.array(F.when(F.col("x.t"), F.lit("then")), F.when(F.col("x.e"), F.lit("else")))).alias("branch")).where("branch IS NOT NULL")
    returns = labelled.where("kind = 'return'")
    out = _around(returns, labelled.join(steps, [unit, "parent", "branch"], "left_semi"), unit, {"_x": F.col("node")}, True).select(unit, "node")
    switches = labelled.join(_switch_exits(labelled, params, unit).select(unit, F.col("node")), [unit, "node"], "left_semi")
    out = out.union(_around(returns, switches, unit, {"_x": F.col("node")}, False).select(unit, "node"))
    return out.union(returns.where("parent IS NULL").select(unit, "node")).union(_forward_gotos(labelled, unit).select(unit, "node")).distinct()


def control_facts(labelled: DataFrame, params: DataFrame, unit: str) -> DataFrame:
    """(unit, node, kind, modeled, in_register_loop, in_switch, guarded_by_parameters, before_register, resolved) of gotos, continues, breaks and returns.

    Needs ``access``: whether a statement reads or writes a register. A transfer is in a
    register loop if the innermost loop around it has such a statement; in a switch if that
    is nearer than any loop; before a register if one comes later in the unit. It is guarded
    by parameters if nothing but they decide the innermost if around it, or there is none.
    """
    points = labelled.where(F.col("kind").isin("goto", "continue", "break", "return"))
    loops = labelled.where(F.col("kind").isin(*LOOPS))
    touched = _around(labelled.where("access"), loops, unit, {"_loop": F.col("node")}, False).select(unit, F.col("_v._loop").alias("_loop")).distinct()
    loop = enclosing(points, loops, unit, {"_loop": F.col("node")}).join(touched.withColumn("_touched", F.lit(True)), [unit, "_loop"], "left")
    inner = enclosing(points, labelled.where(F.col("kind").isin(*LOOPS, "switch")), unit, {"_inner": F.col("kind")})
    tests = enclosing(points, labelled.where("kind = 'if'"), unit, {"_test": F.trim(F.coalesce("text", F.lit("")))})
    last = labelled.where("access").groupBy(unit).agg(F.max("pre").alias("_last"))
    labels = labelled.where("kind = 'label'").select(unit, "text", F.lit(True).alias("_label")).distinct()
    full = points
    for part, on in ((loop, [unit, "node"]), (inner, [unit, "node"]), (tests, [unit, "node"]), (modeled_transfers(labelled, params, unit).withColumn("_m", F.lit(True)), [unit, "node"]), (last, unit), (labels, [unit, "text"]), (params, unit)):
        full = full.join(part, on, "left")
    no = F.lit(False)
    return full.select(
        unit, "node", "kind", F.coalesce("_m", no).alias("modeled"), F.coalesce("_touched", no).alias("in_register_loop"), F.coalesce(F.col("_inner") == "switch", no).alias("in_switch"),
        F.coalesce(provable(F.col("_test"), F.coalesce("params", F.expr("cast(array() AS array<string>)"))), F.lit(True)).alias("guarded_by_parameters"), F.coalesce(F.col("_last") > F.col("pre"), no).alias("before_register"), F.coalesce("_label", no).alias("resolved"),
    )


def _switch_exits(labelled: DataFrame, params: DataFrame, unit: str) -> DataFrame:
    """(unit, node, last, guard) of the switches at the top of a unit with cases that return or go elsewhere."""
    top = labelled.where("kind = 'switch' AND parent IS NULL").select(unit, "node", "pre", "last", "depth", F.trim("text").alias("_sel"))
    top = top.join(params, unit, "left").where(provable(F.col("_sel"), F.coalesce("params", F.expr("cast(array() AS array<string>)"))))
    below = enclosing(labelled.where("kind IN ('case', 'default', 'return', 'goto')"), top, unit, {"_sw": F.col("node"), "_sel": F.col("_sel"), "_last": F.col("last")}).join(labelled.select(unit, "node", "pre", "kind", "text"), [unit, "node"])
    # a label's part is what follows it up to the next label
    order = Window.partitionBy(unit, "_sw").orderBy("pre")
    parts = below.withColumn("_part", F.sum(F.when(F.col("kind").isin("case", "default"), 1).otherwise(0)).over(order)).where("_part > 0")
    part = parts.groupBy(unit, "_sw", "_sel", "_last", "_part").agg(F.min_by(F.struct("kind", "text"), "pre").alias("l"), F.max(F.col("kind").isin("return", "goto")).alias("x"))
    sides = part.groupBy(unit, "_sw", "_sel", "_last").agg(
        F.max((F.col("l.kind") == "default") & F.col("x")).alias("d"),
        F.array_sort(F.collect_list(F.when((F.col("l.kind") == "case") & F.col("x"), F.struct("_part", "l.text")))).alias("gone"),
        F.array_sort(F.collect_list(F.when((F.col("l.kind") == "case") & ~F.col("x"), F.struct("_part", "l.text")))).alias("stay"),
    )
    test = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("("), "_sel", F.lit(" == "), x["text"], F.lit(")"))), " || ")
    guard = F.when(F.col("d"), F.when(F.size("stay") > 0, test("stay"))).when(F.size("gone") > 0, F.concat(F.lit("!("), test("gone"), F.lit(")")))
    return sides.select(unit, F.col("_sw").alias("node"), F.col("_last").alias("last"), guard.alias("guard")).where("guard IS NOT NULL")
