"""Graph fixpoints on edge tables: reachability, propagation by depth, dominators.

Loops run on the driver but only ever look at counts; every round is staged in the
shared folder, so a lost executor does not repeat earlier rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tracewell.session import ship, staged


def reach(edges: DataFrame, src: str, dst: str, rounds: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, depth) for all nodes reachable from each root, at their least depth.

    ``roots`` (root) are where to start; the result has at most one row for a root and a
    node. Without it every node with an edge is a root, which only suits small graphs or
    few ``rounds``. Backward reachability is the same with ``src`` and ``dst`` exchanged.
    Edges run within a graph key if they have one folded into the node ids. Cycles are
    safe: a frontier holds only pairs that were not seen before.
    """
    step = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where(F.col("_s").isNotNull() & F.col("_d").isNotNull()).distinct()
    first = step if roots is None else step.join(roots.select(F.col("root").alias("_s")).distinct(), "_s", "left_semi")
    seen = frontier = staged(first.select(F.col("_s").alias("root"), F.col("_d").alias("node"), F.lit(1).alias("depth")), "reach")
    depth = 1
    while rounds is None or depth < rounds:
        depth += 1
        ahead = frontier.join(step, F.col("node") == F.col("_s")).select("root", F.col("_d").alias("node")).distinct()
        frontier = staged(ahead.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def propagation(edges: DataFrame, src: str, dst: str, rounds: int) -> DataFrame:
    """(depth, new_pairs, total_pairs): how many pairs each round of propagation adds."""
    per = reach(edges, src, dst, rounds).groupBy("depth").agg(F.count(F.lit(1)).alias("new_pairs"))
    # one row per depth, at most ``rounds`` of them
    return per.withColumn("total_pairs", F.sum("new_pairs").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the strongly connected components of the edges' nodes, named by their greatest node.

    Colouring: the greatest number moves forward along edges until it settles; the nodes
    that reach the one of their colour backwards, within the colour, are its component.
    They leave, and the rest is coloured anew. Nodes without a way in or out leave first,
    as components of their own.
    """
    left = staged(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    nodes = staged(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), "nodes")
    done = None
    while True:
        while True:  # what no edge enters, or none leaves, is in no cycle
            inner = staged(left.where("a <> b").join(left.where("a <> b").select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.where("a <> b").select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "edges")
            same = inner.count() == left.where("a <> b").count()
            left = inner
            if same:
                break
        if left.isEmpty():
            break
        colour = staged(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("c", F.col("node")), "colours")
        while True:
            told = left.join(colour, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.max("c").alias("_m"))
            new = staged(colour.join(told, "node", "left").select("node", F.greatest("c", "_m").alias("c"), (F.col("_m") > F.col("c")).alias("_moved")), "colours")
            colour = new.select("node", "c")
            if new.where("_moved").isEmpty():
                break
        ca, cb = colour.select(F.col("node").alias("a"), "c"), colour.select(F.col("node").alias("b"), F.col("c").alias("_c"))
        within = staged(left.join(ca, "a").join(cb, "b").where("c = _c").select("a", "b", "c"), "within")
        frontier = staged(colour.where("node = c"), "back")
        found = frontier
        while True:
            more = within.join(frontier.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "c").distinct()
            frontier = staged(more.join(found, ["node", "c"], "left_anti"), "back")
            if frontier.isEmpty():
                break
            found = staged(found.unionByName(frontier), "back")
        found = found.select("node", F.col("c").alias("component"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        left = staged(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "edges")
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


_SITE = "array<struct<param:int,text:string>>"


def _symbols(functions: DataFrame) -> DataFrame:
    """The distinct symbols, staged: as a column of a wide file they count as far smaller than they are, and millions would be broadcast."""
    return staged(functions.select("symbol").distinct(), "symbols")


def summaries(functions: DataFrame, ops: DataFrame, calls: DataFrame, rounds: int | None = 3) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The operations of functions with those of their callees, and (depth, new_ops, total_ops) of each round.

    ``ops`` has (symbol, pos, kind, param, text): an operation on what the parameter of
    that number means, or on ``text`` if ``param`` is null; ``calls`` (caller, pos, callee,
    args), an array of (param, text) in the caller's terms. The result has (symbol, path,
    kind, param, text), ``path`` being the places from the function down: sorting by it
    gives the order. A round puts the callee's operations of the round before in the place
    of each call, with parameters replaced by the arguments; a missing argument leaves a
    text of ``?``. A function does not take in itself.

    A round only makes the callers of functions that changed anew, and rounds end when no
    function's fingerprint, a sum of hashes of its operations, changes. A cycle would grow
    for ever, so without a limit of ``rounds`` calls within a component are not followed.
    """
    symbols = _symbols(functions)
    known = calls.where("caller <> callee").join(symbols.select(F.col("symbol").alias("callee")), "callee", "left_semi").join(symbols.select(F.col("symbol").alias("caller")), "caller", "left_semi")
    sites = known.select("caller", F.col("pos").cast("int").alias("_pos"), "callee", F.col("args").cast(_SITE).alias("args"))
    sites = staged(sites if rounds is not None else _between(sites), "sites")
    own = staged(ops.join(symbols, "symbol", "left_semi").select("symbol", F.array(F.col("pos").cast("int")).alias("path"), "kind", F.col("param").cast("int").alias("param"), "text"), "summaries")
    now, changed, totals = own, own.select("symbol").distinct(), []
    total = own.count()
    totals.append((0, total, total))
    prints = lambda df: df.groupBy("symbol").agg(F.sum(F.xxhash64("path", "kind", "param", "text").cast("decimal(20,0)")).alias("print"), F.count(F.lit(1)).alias("n"))
    before = staged(prints(now), "prints")
    depth = 0
    while rounds is None or depth < rounds:
        depth += 1
        again = staged(sites.join(changed.select(F.col("symbol").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("symbol")).distinct(), "again")
        brought = sites.join(again.select(F.col("symbol").alias("caller")), "caller", "left_semi").join(now.select(F.col("symbol").alias("callee"), "path", "kind", "param", "text"), "callee")
        argument = F.get("args", F.col("param"))
        mapped = brought.select(
            F.col("caller").alias("symbol"), F.concat(F.array("_pos"), "path").alias("path"), "kind",
            F.when(F.col("param").isNotNull(), argument["param"]).alias("param"), F.when(F.col("param").isNull(), F.col("text")).otherwise(F.when(argument["param"].isNull(), F.coalesce(argument["text"], F.lit("?")))).alias("text"),
        )
        made = own.join(again, "symbol", "left_semi").unionByName(mapped)
        now = staged(now.join(again, "symbol", "left_anti").unionByName(made), "summaries")
        after = staged(prints(now), "prints")
        changed = staged(after.join(before.select("symbol", F.col("print").alias("_p"), F.col("n").alias("_n")), "symbol", "left").where("NOT (print <=> _p AND n <=> _n)").select("symbol"), "changed")
        last, total = total, now.count()
        totals.append((depth, max(0, total - last), total))
        before = after
        if changed.isEmpty():
            break
    return now, totals


def summary_propagation(functions: DataFrame, calls: DataFrame, rounds: int | None) -> DataFrame:
    """(depth, new_ops, total_ops): how many operations summaries of callees add, round by round.

    ``functions`` has (symbol, own_ops), ``calls`` one (caller, callee) row for each call
    site. In each round a call brings the operations that its callee had in the round
    before; a function does not take in itself. Rounds end when no count changes; without
    a limit of ``rounds``, calls within a component are not followed, so they do end.
    ``summaries`` carries the operations themselves.
    """
    own = functions.select("symbol", F.col("own_ops").cast("long").alias("own"))
    sites = calls.where("caller <> callee").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n")).join(own.select(F.col("symbol").alias("callee")), "callee", "left_semi")
    sites = staged(sites if rounds is not None else _between(sites), "sites")
    now = staged(own.withColumn("ops", F.col("own")), "summaries")
    total = int(now.agg(F.sum("ops")).first()[0] or 0)
    rows = [(0, total, total)]
    depth = 0
    while rounds is None or depth < rounds:
        depth += 1
        brought = sites.join(now.select(F.col("symbol").alias("callee"), "ops"), "callee").groupBy(F.col("caller").alias("symbol")).agg(F.sum(F.col("n") * F.col("ops")).alias("_b"))
        after = staged(now.join(brought, "symbol", "left").select("symbol", "own", (F.col("own") + F.coalesce("_b", F.lit(0))).alias("ops"), F.col("ops").alias("before")), "summaries")
        before, (total, changed) = total, after.agg(F.coalesce(F.sum("ops"), F.lit(0)), F.count_if(F.col("ops") != F.col("before"))).first()
        rows.append((depth, max(0, total - before), total))
        now = after.drop("before")
        if not changed:
            break
    return functions.sparkSession.createDataFrame(rows, "depth int, new_ops long, total_ops long")


def _between(sites: DataFrame) -> DataFrame:
    """The call sites (caller, callee, ...) whose two ends are in different components."""
    c = staged(components(sites, "caller", "callee"), "components")
    ends = sites.join(c.select(F.col("node").alias("caller"), F.col("component").alias("_a")), "caller").join(c.select(F.col("node").alias("callee"), F.col("component").alias("_b")), "callee")
    return ends.where("_a <> _b").select(*sites.columns)


def pure_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol, name) of the functions that only compute a value from pure functions.

    ``functions`` has (symbol, name, return_expr, n_ops), ``calls`` (caller, callee): names
    of what a function calls. To start with, functions count that return an expression,
    have no operations and share their name with no other such function. Those go that
    call what is not pure, or call it outside the returned expression, until none does.
    """
    some = functions.where("return_expr IS NOT NULL AND return_expr <> '' AND n_ops = 0")
    once = some.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.first("symbol").alias("symbol"), F.first("return_expr").alias("return_expr")).where("_n = 1")
    pure = staged(once.select("symbol", "name", "return_expr"), "pure")
    outside = ~F.expr(r"return_expr RLIKE concat('\\b', callee, '\\s*\\(')")
    left = pure.count()
    while left:
        asked = calls.select(F.col("caller").alias("symbol"), "callee").join(pure, "symbol")
        bad = asked.join(pure.select(F.col("name").alias("callee"), F.lit(True).alias("_p")), "callee", "left").where(F.col("_p").isNull() | outside).select("symbol").distinct()
        pure = staged(pure.join(bad, "symbol", "left_anti"), "pure")
        before, left = left, pure.count()
        if left == before:
            break
    return pure.select("symbol", "name")


def inlined(ops: DataFrame, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(root, path, op, level): the operations of each function with those of what it calls, in order.

    ``ops`` has (symbol, pos, op), ``calls`` (caller, pos, callee): where in the caller the
    callee's operations belong. ``path`` is the array of places from the root down; sorting
    by it gives the order. Calls are followed ``depth`` deep, and never into a function
    that is being expanded already.
    """
    at = staged(ops.select(F.col("symbol").alias("root")).union(calls.select("caller")).distinct().select("root", F.col("root").alias("symbol"), F.expr("cast(array() AS array<int>)").alias("path"), F.array("root").alias("chain")), "inline")
    out = None
    for level in range(depth + 1):
        here = at.join(ops, "symbol").select("root", F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"), "op", F.lit(level).alias("level"))
        out = here if out is None else out.unionByName(here)
        if level == depth:
            break
        down = at.join(calls, F.col("symbol") == F.col("caller")).where(~F.array_contains("chain", F.col("callee")))
        at = staged(down.select("root", F.col("callee").alias("symbol"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"), F.concat("chain", F.array("callee")).alias("chain")), "inline")
        if at.isEmpty():
            break
    return out


def called_helpers(calls: DataFrame, with_ops: DataFrame, entries: DataFrame) -> DataFrame:
    """(symbol) of functions with operations that another one calls and that are no callback entries."""
    other = calls.where("caller <> callee").select(F.col("callee").alias("symbol")).distinct()
    return other.join(with_ops.select("symbol"), "symbol", "left_semi").join(entries.select("symbol"), "symbol", "left_anti")


def target_calls(call_sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee) for every call among the functions, each pair once."""
    return call_sites.join(functions.select(F.col("symbol").alias("callee")), "callee", "left_semi").select("caller", "callee").distinct()


def propagating_edges(edges: DataFrame, with_ops: DataFrame) -> DataFrame:
    """The edges whose callee has operations."""
    return edges.join(with_ops.select(F.col("symbol").alias("callee")), "callee", "left_semi").select("caller", "callee")


def goto_kind(source_offset: Column, target_offset: Column) -> Column:
    """goto-forward or goto-backward, by where the target lies; null if the target is unknown."""
    return F.when(target_offset.isNotNull(), F.when(target_offset > source_offset, "goto-forward").otherwise("goto-backward"))


def join_blocks(edges: DataFrame, graph: list[str], src: str, dst: str) -> DataFrame:
    """Nodes with more than one predecessor."""
    return edges.groupBy(*graph, dst).agg(F.count_distinct(src).alias("n_pred")).where("n_pred > 1")


def _dominator_tree(pairs: set[tuple[str, str]], entry: str) -> list[tuple[str, str | None, int, int, int]]:
    """(node, immediate dominator, depth from 1, place, last place below) of the nodes reachable from ``entry``, in order of the tree.

    Dominators are found as nearest common ancestors in reverse post-order until nothing
    changes, so memory is that of the edges.
    """
    succ: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        succ.setdefault(a, []).append(b)
    order, state, stack = [], {entry}, [(entry, iter(succ.get(entry, ())))]
    while stack:
        node, rest = stack[-1]
        for b in rest:
            if b not in state:
                state.add(b)
                stack.append((b, iter(succ.get(b, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    order.reverse()
    number = {n: i for i, n in enumerate(order)}
    pred: list[list[int]] = [[] for _ in order]
    for a, b in pairs:
        if a in number:
            pred[number[b]].append(number[a])
    idom = [0] + [-1] * (len(order) - 1)
    changed = True
    while changed:
        changed = False
        for n in range(1, len(order)):
            new = -1
            for p in pred[n]:
                if idom[p] < 0:
                    continue
                if new < 0:
                    new = p
                while new != p:
                    if new > p:
                        new = idom[new]
                    else:
                        p = idom[p]
            if new != idom[n]:
                idom[n], changed = new, True
    size, depth = [1] * len(order), [1] * len(order)
    for n in range(len(order) - 1, 0, -1):
        size[idom[n]] += size[n]
    place, free = [0] * len(order), [1] * len(order)
    for n in range(1, len(order)):
        # a node's dominator comes before it in reverse post-order
        depth[n] = depth[idom[n]] + 1
        place[n] = place[idom[n]] + free[idom[n]]
        free[idom[n]] += size[n]
    return [(order[n], order[idom[n]] if n else None, depth[n], place[n], place[n] + size[n] - 1) for n in range(len(order))]


def _by_graph(rows: DataFrame, graph: str, run, schema: str) -> DataFrame:
    """``run`` of the rows of each graph, lists of their columns without the graph's, one at a time; it returns such lists.

    Rows are sorted by graph within partitions, and a task holds those of one graph and a batch.
    """
    ship(rows.sparkSession)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], ([], [])

        def close() -> None:
            got = run(*zip(*held))
            done[0].extend([key] * len(got))
            done[1].extend(got)

        def full() -> pa.RecordBatch:
            columns = [done[0], *(zip(*done[1]) if done[1] else [()] * (len(kinds) - 1))]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds)], schema=kinds)
            done[0].clear()
            done[1].clear()
            return out

        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and g != key:
                    close()
                    held = []
                    if len(done[0]) >= 1 << 14:
                        yield full()
                key = g
                held.append(row)
        if held:
            close()
        yield full()

    return rows.repartition(graph).sortWithinPartitions(graph).mapInArrow(each, schema)


def dominators(edges: DataFrame, graph: str, src: str, dst: str, entry: str) -> DataFrame:
    """(graph, node, idom, dom_size, header, place, last) of the nodes reachable from each graph's entry.

    One Python call per graph: control-flow graphs are small, and there are many; its
    memory is that of the graph's edges. ``entry`` is a column with the graph's entry
    node. ``header`` marks targets of edges whose source they dominate. A node dominates
    those with a ``place`` from its own to its ``last``. Post-dominators are the same with
    ``src`` and ``dst`` exchanged and the exit for the entry.
    """
    schema = f"{graph} {dict(edges.dtypes)[graph]}, node string, idom string, dom_size int, header boolean, place int, last int"

    def run(a: tuple, b: tuple, entries: tuple) -> list[tuple]:
        pairs = {(str(x), str(y)) for x, y in zip(a, b)}
        tree = _dominator_tree(pairs, str(entries[0]))
        span = {n: (p, z) for n, _, _, p, z in tree}
        headers = {y for x, y in pairs if x in span and y in span and span[y][0] <= span[x][0] <= span[y][1]}
        return [(n, d, k, n in headers, p, z) for n, d, k, p, z in sorted(tree, key=lambda t: t[0])]

    return _by_graph(edges.select(graph, src, dst, entry), graph, run, schema)


def backedges(edges: DataFrame, tree: DataFrame, graph: str, src: str, dst: str) -> DataFrame:
    """(graph, src, dst): the edges whose target dominates their source; ``tree`` is what ``dominators`` returns."""
    a = tree.select(graph, F.col("node").alias("_s"), F.col("place").alias("_at"))
    b = tree.select(graph, F.col("node").alias("_d"), F.col("place").alias("_from"), F.col("last").alias("_to"))
    each = edges.select(graph, F.col(src).cast("string").alias("_s"), F.col(dst).cast("string").alias("_d")).distinct()
    return each.join(a, [graph, "_s"]).join(b, [graph, "_d"]).where("_from <= _at AND _at <= _to").select(graph, F.col("_s").alias("src"), F.col("_d").alias("dst"))


def natural_loops(edges: DataFrame, back: DataFrame, graph: str, src: str, dst: str) -> DataFrame:
    """(graph, header, node): the nodes of each loop, found backwards from its backedges without passing the header.

    Backedges to one header make one loop. One Python call per graph, as for dominators.
    Only graphs with a backedge are looked at; a body costs its edges.
    """
    pred = edges.select(graph, F.col(src).cast("string").alias("_a"), F.col(dst).cast("string").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL").distinct()
    ends = back.select(graph, F.col("src").cast("string").alias("_a"), F.col("dst").cast("string").alias("_b")).distinct()
    rows = pred.join(ends.select(graph).distinct(), graph, "left_semi").withColumn("_back", F.lit(False)).unionByName(ends.withColumn("_back", F.lit(True)))

    def run(a: tuple, b: tuple, is_back: tuple) -> list[tuple]:
        into: dict[str, list[str]] = {}
        todo: dict[str, list[str]] = {}
        for x, y, z in zip(a, b, is_back):
            (todo if z else into).setdefault(y, []).append(x)
        out = []
        for header, found in todo.items():
            body = {header}
            while found:
                node = found.pop()
                if node not in body:
                    body.add(node)
                    found.extend(into.get(node, ()))
            out.extend((header, n) for n in sorted(body))
        return out

    return _by_graph(rows, graph, run, f"{graph} {dict(edges.dtypes)[graph]}, header string, node string")


def callback_entries(refs: DataFrame, callees: DataFrame, targets: DataFrame, place: list[str], symbol: str) -> DataFrame:
    """The target symbols that some reference names other than as what is called, one row each."""
    return refs.join(callees.select(*place), place, "left_anti").join(targets.select(symbol), symbol, "left_semi").select(symbol).distinct()


def resolved_edges(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee, unit, target_unit, how) for each call site (caller, callee, symbol, unit).

    ``functions`` has (symbol, name, unit), names and symbols once per unit. A site goes to
    the function of its symbol; without one, to the only function of its name; ``how`` is
    ``same unit``, ``other unit`` or, without either, ``unresolved``.
    """
    by_symbol = functions.groupBy("symbol").agg(F.min("unit").alias("_s"))
    by_name = functions.groupBy(F.col("name").alias("callee")).agg(F.min("unit").alias("_n"), F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    joined = sites.join(by_symbol, "symbol", "left").join(by_name, "callee", "left").withColumn("target_unit", F.coalesce("_s", "_n"))
    how = F.when(F.col("target_unit").isNull(), "unresolved").when(F.col("target_unit") == F.col("unit"), "same unit").otherwise("other unit")
    return joined.select("caller", "callee", "unit", "target_unit", how.alias("how"))


def pruned(nodes: DataFrame, module: list[str], keep) -> DataFrame:
    """The leaves of op trees for which ``keep`` is true, and the conditions and sequences that lead to one.

    Needs node_id, parent_id, depth and kind. What is in a loop goes with the loop. One
    join for each level of nesting, up and then down.
    """
    inner = F.col("kind").isin("Cond", "Seq")
    leaf = F.coalesce(keep, F.lit(False)) & ~F.col("kind").isin("Cond", "Seq", "Loop")
    nodes = staged(nodes, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    at = lambda d: nodes.where(F.col("depth") == d)
    levels = {deepest: at(deepest).where(leaf)}
    for d in range(deepest - 1, -1, -1):
        parents = levels[d + 1].select(*module, F.col("parent_id").alias("node_id"))
        levels[d] = at(d).where(leaf).unionByName(at(d).where(inner).join(parents, [*module, "node_id"], "left_semi"), allowMissingColumns=True)
    out = above = levels[0]
    for d in range(1, deepest + 1):
        above = levels[d].join(above.select(*module, F.col("node_id").alias("parent_id")), [*module, "parent_id"], "left_semi")
        out = out.unionByName(above)
    return out.select(*nodes.columns)
