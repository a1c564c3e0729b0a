"""From the events of functions to operations: what each function reads, writes, changes, waits for and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import accesses as A
from tracewell.functions import expressions as E
from tracewell.functions.folds import substituted, updated_value
from tracewell.operators import syntax as X
from tracewell.session import staged_by

_NAME = r"^\s*[A-Za-z_]\w*\s*$"


FRAMES = "array<struct<kind:string,guard:string,branch:string>>"


def framed(statements: DataFrame, params: DataFrame, unit: str) -> DataFrame:
    """``statements`` that are events, with ``frames``: what governs each, outermost first.

    First come the guards that earlier exits and jumps leave, the latest of them outermost,
    then the conditions and loops around the statement. ``statements`` have the labels of
    ``syntax.intervals`` and ``event``.
    """
    events = statements.where("event IS NOT NULL")
    lexical = X.control_frames(statements, unit, F.col("event").isNotNull())
    left = X.continuation_guards(statements, params, unit).select(F.col(unit).alias("_u"), "after", "before", "guard", "branch")
    held = events.select(unit, "node", "pre").join(left, (F.col(unit) == F.col("_u")) & (F.col("after") < F.col("pre")) & (F.col("before").isNull() | (F.col("pre") < F.col("before"))))
    frame = F.struct(F.lit("cond").alias("kind"), "guard", "branch")
    order = F.struct("after", F.coalesce("before", F.lit(1 << 62)).alias("before"), frame.alias("f"))
    earlier = held.groupBy(unit, "node").agg(F.reverse(F.array_sort(F.collect_list(order)))["f"].alias("_earlier"))
    joined = events.join(lexical, [unit, "node"]).join(earlier, [unit, "node"], "left")
    return joined.withColumn("frames", F.concat(F.coalesce(F.col("_earlier").cast(FRAMES), F.expr(f"cast(array() AS {FRAMES})")), F.col("frames").cast(FRAMES))).drop("_earlier")


def walk(statements: DataFrame, params: DataFrame, unit: str, entries: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """(unit, path, kind, address, width, var, value, frames) of the operations of each function and of the helpers that it calls.

    ``statements`` are one function a unit, as for ``operations`` (event, name, args, lhs,
    op, text) with the tree (node, parent, ord, branch, kind) around them and the labels of
    ``syntax.intervals``; ``text`` of an event is what it assigns or returns. ``params``
    (unit, params: names). A call of another unit's ``name`` (the unit as text) puts that
    unit's operations in its place, but for returns: parameters are replaced by the
    arguments, and the call's frames come before theirs. Calls are followed ``depth`` deep,
    not into the function itself, nor into ``entries`` (unit), which are called from
    elsewhere. Sorting by ``path`` gives the order.
    """
    events = staged_by(framed(statements, params, unit), "events", unit)
    guards = F.transform("frames", lambda f: f["guard"])
    own = operations(events.select(unit, F.col("pre").alias("ord"), "event", "name", "args", "lhs", "op", F.col("value").alias("text"), guards.alias("guards")), [unit])
    frames = events.select(unit, F.col("pre").alias("ord"), "frames")
    own = own.join(frames, [unit, "ord"]).select(unit, F.array(F.col("ord").cast("long")).alias("path"), "kind", "address", "width", "var", "value", "frames")
    own = staged_by(own, "walked", unit)
    known = params.select(unit, "params", F.col(unit).cast("string").alias("name"))
    known = known if entries is None else known.join(entries.select(unit), unit, "left_anti")
    sites = events.where("event = 'call'").select(F.col(unit).alias("_caller"), "pre", "args", F.col("frames").alias("_outer"), "name").join(known.select(F.col(unit).alias("_callee"), "params", "name"), "name").where("_caller <> _callee")
    n = F.least(F.size("params"), F.size(F.coalesce("args", F.array().cast("array<string>"))))
    mapping = F.map_from_arrays(F.slice("params", F.lit(1), n), F.slice("args", F.lit(1), n))
    sites = staged_by(sites.select("_caller", "_callee", "pre", mapping.alias("_m"), "_outer"), "sites", "_callee")
    now = own
    for _ in range(depth):
        inner = sites.join(now.where("kind <> 'Return'").withColumnRenamed(unit, "_callee"), "_callee")
        put = lambda c: substituted(F.col(c), F.col("_m")).alias(c)
        there = F.transform("frames", lambda f: f.withField("guard", substituted(f["guard"], F.col("_m"))))
        made = inner.select(F.col("_caller").alias(unit), F.concat(F.array("pre"), "path").alias("path"), "kind", put("address"), "width", "var", put("value"), F.concat("_outer", there).cast(FRAMES).alias("frames"))
        now = staged_by(own.unionByName(made), "walked", unit)
    return now


def operations(events: DataFrame, function: list[str]) -> DataFrame:
    """(function, ord, kind, address, width, var, value, guards) of the operations of each function, ordered by ``ord``.

    ``events`` has (function, ord, event, name, args, lhs, op, text, guards), ``ord`` unique
    within a function: a ``call`` (name, args, and the variable it is assigned to), an
    ``assign`` (``lhs op text``), or a ``return`` (text). Reads, writes, updates of maps and
    delays are known by the callee's name; any other call is no operation.

    A write of a plain variable takes what the variable then holds: its last read or
    unconditional assignment, and the changes since, guarded ones as choices. If that
    began with a read of the same address, the write is a ReadModifyWrite of that read;
    the read stays. A value that is not known stays as written.
    """
    width, name, args = A.width(F.col("name")), F.col("name"), F.coalesce("args", F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    call = F.col("event") == "call"
    kind, wrote, update = A.kind(name), A.write_parts(name, args), A.update_parts(name, args)
    mask = F.concat(F.lit("("), update["mask"], F.lit(")"))
    merged = F.concat(F.lit("((__old & ~"), mask, F.lit(") | (("), update["value"], F.lit(") & "), mask, F.lit("))"))
    wait = E.delay_ns(name, F.get(args, F.lit(0)).try_cast("bigint"))
    row = lambda k, address, var, value, w=width: F.struct(F.lit(k).alias("kind"), address.alias("address"), w.cast("int").alias("width"), var.alias("var"), value.alias("value"))
    op = (
        F.when(call & (kind == "read"), row("Read", A.read_address(name, args), A.result_variable(name, args, F.col("lhs")), none))
        .when(call & (kind == "write"), row("Write", wrote["address"], none, wrote["value"]))
        .when(call & (kind == "rmw") & update.isNotNull(), row("ReadModifyWrite", update["address"], F.lit("__old"), merged))
        .when(call & kind.isNull() & wait.isNotNull(), row("Delay", none, none, wait.cast("string"), F.lit(0)))
        .when(F.col("event") == "return", row("Return", none, none, F.col("text"), F.lit(None)))
    )
    # a generator of one row keeps the optimiser from writing the choice into each of its many uses
    known = events.select(*function, "ord", "event", "lhs", F.col("op").alias("sign"), "text", F.coalesce("guards", F.array().cast("array<string>")).alias("guards"), F.explode(F.array(op)).alias("_o"))

    # what each variable holds where it is written: one row an event of a variable, keyed by the variable
    plain = F.col("_o.kind") == "Write"
    variable = F.trim(F.when(F.col("event") == "assign", F.col("lhs")).when(F.col("_o.kind") == "Read", F.col("_o.var")).when(plain & F.col("_o.value").rlike(_NAME), F.col("_o.value")))
    of = known.withColumn("_v", variable).where("_v IS NOT NULL")
    fresh = (F.col("event") == "assign") & (F.col("sign") == "=") & (F.size("guards") == 0) & ~F.coalesce(F.expr("text RLIKE concat('\\\\b', _v, '\\\\b')"), F.lit(False))
    starts = (F.col("_o.kind") == "Read") | fresh
    up_to = Window.partitionBy(*function, "_v").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    of = of.select(*function, "_v", "ord", "event", "sign", "text", "guards", "_o", F.coalesce(starts, F.lit(False)).alias("_starts"))
    of = of.withColumn("_part", F.sum(F.col("_starts").cast("int")).over(up_to))
    change = (F.col("event") == "assign") & ~F.col("_starts")
    parts = of.groupBy(*function, "_v", "_part").agg(
        F.max(F.when(F.col("_starts"), F.struct(F.col("_o.address").alias("address"), F.col("text").alias("text"), F.lit(True).alias("known")))).alias("_from"),
        F.collect_list(F.when(change, F.struct("ord", F.col("sign").alias("op"), "text", "guards"))).alias("_changes"),
        F.collect_list(F.when(F.col("_o.kind") == "Write", F.struct("ord", F.col("_o.address").alias("address")))).alias("_uses"),
    )
    since = F.filter(F.array_sort("_changes"), lambda c: c["ord"] < F.col("_use.ord"))
    shown = F.transform(since, lambda c: F.struct(c["op"].alias("op"), c["text"].alias("text"), c["guards"].alias("guards")))
    uses = parts.where(F.col("_from").isNotNull()).withColumn("_use", F.explode("_uses")).select(*function, "_v", "_from", "_use", shown.alias("_c"))
    same = F.coalesce(F.col("_from.address") == F.col("_use.address"), F.lit(False))
    assigned = F.col("_from.address").isNull()
    held = updated_value(F.col("_v"), F.when(assigned, F.col("_from.text")), F.col("_c"))
    values = uses.where(same | assigned).select(*function, F.col("_use.ord").alias("ord"), same.alias("_same"), F.col("_v"), held.alias("_held"))

    out = known.where(F.col("_o").isNotNull()).join(values, [*function, "ord"], "left")
    changed = F.coalesce("_same", F.lit(False))
    return out.select(
        *function, "ord", F.when(changed, "ReadModifyWrite").otherwise(F.col("_o.kind")).alias("kind"), F.col("_o.address").alias("address"), F.col("_o.width").alias("width"),
        F.when(changed, F.col("_v")).otherwise(F.col("_o.var")).alias("var"), F.coalesce("_held", F.col("_o.value")).alias("value"), "guards",
    )


def lowered_arrays(ops: DataFrame, loops: DataFrame, key: list[str]) -> DataFrame:
    """(key, ord, sub, index, op): operations of loops with the elements of a private array as indexed state.

    ``ops`` has (key, ord, op) with ``op`` as in summaries, ``loops`` (key, source): one
    text a loop. A loop counts from 0, takes ``x = p->array[i].member`` and a context
    ``*c = p->array[i].context`` of the same array; any other loop, and operations without
    a loop, stay as they are. The loop begins (ord null) by reading ``array_member`` into x.
    What is read into ``c->f`` is kept in ``array_context_f``; writes that use ``c->f``
    read it first. ``index`` is set for such state.
    """
    from tracewell.operators.summaries import OP, operation

    name = r"([A-Za-z_]\\w*)"
    found = loops.groupBy(*key).agg(F.min("source").alias("_src")).withColumn("_i", F.regexp_extract("_src", r"for\s*\(\s*([A-Za-z_]\w*)\s*=\s*0\s*;", 1)).where("_i <> ''")
    part = lambda head, n, g: F.expr(f"regexp_extract(_src, concat('{head}{name}', '\\\\s*=\\\\s*({name}->{name}\\\\[', _i, '\\\\]\\\\.{name})\\\\s*;'), {g})")
    took, kept = (lambda g: part(r"(?<![\\w*>.])", 0, g)), (lambda g: part(r"\\*\\s*", 0, g))
    found = found.select(
        *key, F.explode(F.array(F.struct(F.col("_i").alias("i"), took(1).alias("x"), took(2).alias("e"), took(4).alias("a"), took(5).alias("m"), kept(1).alias("c"), kept(4).alias("ca"), kept(5).alias("cm")))).alias("_l")
    ).where("_l.x <> '' AND _l.c <> '' AND _l.a = _l.ca")
    j = ops.select(*key, "ord", F.col("op").cast(OP).alias("op")).join(found, key, "left")
    loop = F.col("_l")
    swap = lambda c: f"regexp_replace({c}, concat('(?<![A-Za-z0-9_])\\\\Q', _l.e, '\\\\E(?![A-Za-z0-9_])'), _l.x)"
    inner = F.concat(F.lit("(?<![A-Za-z0-9_])"), loop["c"], F.lit(r"->([A-Za-z_]\w*)"))
    of = F.struct(*[(F.expr(swap(f"op.{c}")) if c in ("address", "value", "guard") else F.col(f"op.{c}")).alias(c) for c in ("kind", "width", "address", "field", "var", "value", "guard")])
    j = j.withColumn("_o", of).withColumn("_read", F.when(F.col("op.kind") == "Read", F.nullif(F.expr("regexp_extract(op.var, concat('^', _l.c, '->([A-Za-z_]\\\\w*)$'), 1)"), F.lit(""))))
    state = lambda f: F.concat(loop["a"], F.lit("_"), loop["cm"], F.lit("_"), f)
    local = F.concat(F.lit("loop_state_"), F.col("_read"), F.lit("_value"))
    stored = F.array(F.col("_o").withField("var", local).cast(OP), operation("StateWrite", 4, field=state(F.col("_read")), value=local).cast(OP))
    fields = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("op.value", F.lit("")), inner, F.lit(1))))
    used = F.concat(F.transform(fields, lambda f: operation("StateRead", 4, field=state(f), var=F.concat(F.lit("loop_state_"), f)).cast(OP)), F.array(F.col("_o").withField("value", F.regexp_replace("_o.value", inner, F.lit("loop_state_$1"))).cast(OP)))
    new = F.when(loop.isNull(), F.array("op")).when(F.col("_read").isNotNull(), stored).when(F.col("op.kind").isin("Write", "ReadModifyWrite"), used).otherwise(F.array(F.col("_o").cast(OP)))
    index = F.when(F.col("_l").isNotNull() & F.col("op.kind").isin("StateRead", "StateWrite") & F.col("op.field").startswith(F.concat(loop["a"], F.lit("_"))), loop["i"])
    body = j.select(*key, "ord", "_l", F.posexplode(new).alias("sub", "op")).select(*key, "ord", "sub", index.alias("index"), "op")
    first = operation("StateRead", 4, field=F.concat(loop["a"], F.lit("_"), loop["m"]), var=loop["x"]).cast(OP)
    return found.select(*key, F.lit(None).cast("int").alias("ord"), F.lit(0).alias("sub"), loop["i"].alias("index"), first.alias("op")).unionByName(body)
