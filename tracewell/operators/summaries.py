"""Summaries of subsystems: what library callbacks do, as rows of operations.

One row that names a contract becomes the rows of its template: a projection to an array
of structs and an explode, without a shuffle. Operations are structs of kind, width,
address, state field, variable, value and guard; ``ord`` is their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.accesses import FIELD_READS, FIELD_WRITES
from tracewell.operators.traces import greedy_prefix

OP = "struct<kind:string,width:int,address:string,field:string,var:string,value:string,guard:string>"
#: The accessors of a controller's table, as (kind, bytes).
ACCESSORS = {"read_l": ("Read", 4), "read_w": ("Read", 2), "read_b": ("Read", 1), "write_l": ("Write", 4), "write_w": ("Write", 2), "write_b": ("Write", 1)}
#: What the core exports for a controller's table.
DELEGATES = ("sdhci_set_clock", "sdhci_set_bus_width", "sdhci_reset", "sdhci_set_uhs_signaling")
#: Queue calls, the state that they move, and by how much; without a step the state is only read.
QUEUE_STATE = {
    "virtqueue_add_inbuf_cache_clean": ("available", 1), "virtqueue_add_outbuf": ("outstanding", 1), "virtqueue_get_buf": ("completed", -1),
    "virtqueue_detach_unused_buf": ("outstanding", -1), "virtqueue_get_vring_size": ("queue_depth", None),
}


def _col(x: Column | str | None) -> Column:
    return F.lit(x).cast("string") if x is None or isinstance(x, str) else x


def operation(kind: str, width: Column | int = 4, address=None, field=None, var=None, value=None, guard=None) -> Column:
    """One operation as a struct."""
    w = width if isinstance(width, Column) else F.lit(width)
    return F.struct(F.lit(kind).alias("kind"), w.cast("int").alias("width"), *[_col(x).cast("string").alias(n) for n, x in (("address", address), ("field", field), ("var", var), ("value", value), ("guard", guard))])


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def accessor_operations(field: Column, callee: Column, base: Column, reg: Column, value: Column) -> Column:
    """The operations of a controller's register accessor; none for other fields.

    Plain accessors touch the register as it is. Big-endian ones with 32-bit registers
    turn the address of short reads, and write within the aligned word: bytes by an
    update, 16 bits by three ways. The transfer mode is kept aside; the command writes both
    at once; any other register is updated.
    """
    at = lambda r: _cat(base, " + ", r)
    big = callee.startswith("sdhci_be32bs_")
    back = operation("Return", 0, value="value")
    read = lambda w, r: F.array(operation("Read", w, at(r), var="value"), back)
    write = lambda w: F.array(operation("Write", w, at(reg), value=value))
    word = at(_cat("((", reg, ") & ~0x3)"))

    def update(mask: str, bits: str, guard=None) -> Column:
        shift = _cat("((", reg, f") & {bits}) * 8")
        new = _cat(f"((__old & ~({mask} << (", shift, "))) | (((", value, f") & {mask}) << (", shift, ")))")
        return operation("ReadModifyWrite", 4, word, var="__old", value=new, guard=guard)

    mode, command = _cat("(", reg, ") == (SDHCI_TRANSFER_MODE)"), _cat("(", reg, ") == (SDHCI_COMMAND)")
    half = F.array(
        operation("StateWrite", 2, field="xfer_mode_shadow", value=value, guard=mode), operation("StateRead", 2, field="xfer_mode_shadow", var="__xfer_mode_shadow", guard=command),
        operation("Write", 4, at(F.lit("SDHCI_TRANSFER_MODE")), value=_cat("((", value, ") << 16) | __xfer_mode_shadow"), guard=command), update("0xffff", "0x2", _cat("!((", mode, ") || (", command, "))")),
    )
    out = F.when(F.lit(False), F.expr(f"cast(array() AS array<{OP}>)"))
    turned = {"read_l": reg, "read_w": _cat("((", reg, ") ^ 0x2)"), "read_b": _cat("((", reg, ") ^ 0x3)")}
    for name, (kind, w) in ACCESSORS.items():
        plain = read(w, reg) if kind == "Read" else write(w)
        other = read(w, turned[name]) if kind == "Read" else write(4) if name == "write_l" else F.array(update("0xff", "0x3")) if name == "write_b" else half
        out = out.when(field == name, F.when(big, other).otherwise(plain))
    return F.coalesce(out, F.expr(f"cast(array() AS array<{OP}>)"))


def routed_accessors(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """``entries`` (table, field, callee) with ``route``: private, delegate, public or unmodeled.

    A callee that the source defines is private if the field is an accessor's; delegates
    are exported by the core; public ones are accessors with a known contract.
    """
    own = functions.select(F.col("name").alias("callee")).distinct().withColumn("_own", F.lit(True))
    route = F.when(F.col("_own") & F.col("field").isin(*ACCESSORS), "private").when(F.col("callee").isin(*DELEGATES), "delegate").when(F.col("callee").isin(*FIELD_READS["ioaddr"], *FIELD_WRITES["ioaddr"]), "public").otherwise("unmodeled")
    return entries.join(own, "callee", "left").select(*entries.columns, route.alias("route"))


def queue_operations(operation_name: Column, prefix: Column, variable: Column) -> Column:
    """The state operations of a queue call: a counter is read, and written one more or one less (never below 0); null for calls without a state."""
    out = F.when(operation_name == "virtqueue_kick", F.array(operation("StateWrite", field=_cat(prefix, "_notified"), value="1")))
    for name, (state, step) in QUEUE_STATE.items():
        field = _cat(prefix, f"_{state}")
        result = variable if step in (-1, None) else F.lit(None).cast("string")
        var = F.coalesce(result, _cat("__", field))
        new = _cat("(", var, ") + 1") if step == 1 else _cat("((", var, ") > 0 ? (", var, ") - 1 : 0)")
        rows = [operation("StateRead", field=field, var=var)] + ([operation("StateWrite", field=field, value=new)] if step else [])
        out = out.when(operation_name == name, F.array(*rows))
    return out


def config_state(member: Column) -> Column:
    """The state that stands for a member of the configuration: its path in lower case, or that in an offsetof."""
    text = F.regexp_replace(F.coalesce(member, F.lit("value")), r"\s+", "")
    inner = F.nullif(F.regexp_extract(text, r"offsetof\([^,]+,([^)]+)\)", 1), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(F.coalesce(inner, text), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return _cat("virtio_cfg_", F.lower(F.when(path == "", "value").otherwise(path)))


def state_rewritten(ops: DataFrame, key: list[str]) -> DataFrame:
    """Operations with those of configuration and queue contracts replaced by state operations, in order.

    ``ops`` has ``ord``, ``op`` (OP), ``contract`` (linux.virtio_config, linux.virtqueue or
    another), ``member``, ``queue_operation`` and ``prefix``. ``sub`` numbers what one
    operation became.
    """
    o = F.col("op")
    field = config_state(F.col("member"))
    named = F.when(o["var"].rlike(r"^[A-Za-z_]\w*$"), o["var"]).otherwise(field)
    config = F.when(o["kind"] == "Read", F.array(operation("StateRead", o["width"], field=field, var=named, guard=o["guard"]))).when(o["kind"] == "Write", F.array(operation("StateWrite", o["width"], field=field, value=o["value"], guard=o["guard"])))
    queue = F.transform(queue_operations(F.col("queue_operation"), F.col("prefix"), o["var"]), lambda x: x.withField("guard", o["guard"]))
    new = F.when(F.col("contract") == "linux.virtio_config", config).when(F.col("contract") == "linux.virtqueue", queue)
    return ops.select(*key, "ord", F.posexplode(F.coalesce(new, F.array(o.cast(OP)))).alias("sub", "op"))


def with_lifecycle(ops: DataFrame, assignments: DataFrame, key: list[str]) -> DataFrame:
    """Operations (key, line, ord, op) with a state write for each assignment of ``ready`` put in before the first later line.

    ``assignments`` has (key, line, text, guard).
    """
    value = F.regexp_extract("text", r"(?s)^[A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*)*(?:->|\.)ready\s*=\s*(true|false)\s*;?$", 1)
    new = assignments.withColumn("_v", value).where("_v <> ''").select(*key, "line", F.lit(2_000_000_000).alias("ord"), operation("StateWrite", 1, field="ready", value=F.when(F.col("_v") == "true", "1").otherwise("0"), guard=F.col("guard")).alias("op"))
    return ops.select(*key, "line", "ord", F.col("op").cast(OP).alias("op")).unionByName(new.select(*key, "line", "ord", F.col("op").cast(OP).alias("op")))


def config_fields(entries: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, values): the different (expression, conditions) of each configuration field, in order of first mention."""
    first = entries.groupBy(*key, "field", "expr", "conditions").agg(F.min("ord").alias("ord"))
    return first.groupBy(*key, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "expr", "conditions"))), lambda x: F.struct(x["expr"].alias("expr"), x["conditions"].alias("conditions"))).alias("values"))


def drain_errors(loops: DataFrame) -> Column:
    """Errors of a drain loop against its contract: two reads guard it, its one write acknowledges the pending register, once.

    Columns: guard_kinds and body_kinds (arrays), pending_addr, pending_var, mask_var,
    ack_addr, write_semantics, guard_value (text), max_iterations, assumptions (array).
    """
    c = F.col
    two, one = F.coalesce(c("guard_kinds") == F.array(F.lit("Read"), F.lit("Read")), F.lit(False)), F.coalesce(c("body_kinds") == F.array(F.lit("Write")), F.lit(False))
    wanted = _cat("(", c("pending_var"), " & ", c("mask_var"), ")")
    rest = F.array(
        F.when(~c("pending_addr").eqNullSafe(c("ack_addr")), F.lit("ack does not target pending register")), F.when(~c("write_semantics").eqNullSafe(F.lit("w1c")), F.lit("ack lacks W1C semantics")),
        F.when(~c("guard_value").eqNullSafe(wanted), F.lit("guard value is not pending & mask")), F.when(~c("max_iterations").eqNullSafe(F.lit(1)) | (F.coalesce(F.size("assumptions"), F.lit(0)) < 1), F.lit("bound lacks explicit quiescence assumption")),
    )
    return F.when(~two, F.array(F.lit("guard is not two MMIO reads"))).when(~one, F.array(F.lit("body is not one acknowledge write"))).otherwise(F.array_compact(rest))


#: State that a queue driver's program must have, and the lifecycle that must set it ready or not.
REQUIRED_STATE = (
    "virtio_cfg_select", "virtio_cfg_subsel", "virtio_cfg_size", "virtio_evt_available", "virtio_evt_completed", "virtio_sts_outstanding", "virtio_evt_notified", "virtio_sts_notified", "ready",
)
LIFECYCLE = (("remove", 0), ("freeze", 0), ("probe", 1), ("restore", 1))


def state_contract(ops: DataFrame, loops: DataFrame, driver: str = "driver") -> DataFrame:
    """(driver, ops, errors) of the queue-state contract.

    ``ops`` has (driver, module, kind, field, value, reliability) of operations under the
    contract; ``loops`` (driver, reliability, bounded, count). A driver without such
    operations needs no check and is left out.
    """
    wrote = (F.col("kind") == "StateWrite")
    per = ops.groupBy(driver).agg(
        F.count(F.lit(1)).alias("ops"), F.collect_set("field").alias("_f"),
        F.array_sort(F.collect_set(F.when(F.col("reliability").isin("Unsupported", "Unknown"), F.concat_ws(":", "module", "field")))).alias("_bad"),
        *[F.bool_or(F.coalesce(wrote & (F.col("field") == f), F.lit(False))).alias(f"_{f}") for f in ("virtio_evt_notified", "virtio_sts_notified")],
        *[F.bool_or(F.coalesce(wrote & (F.col("field") == "ready") & F.col("module").contains(m) & (F.col("value") == v), F.lit(False))).alias(f"_{m}") for m, v in LIFECYCLE],
    )
    lo = loops.groupBy(driver).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce((F.col("reliability") == "Exact") & F.col("bounded"), F.lit(False))).alias("_open"), F.array_sort(F.collect_set(F.when(F.col("count") > 64, F.col("count")))).alias("_long"))
    missing = F.transform(F.filter(F.array(*map(F.lit, REQUIRED_STATE)), lambda f: ~F.array_contains("_f", f)), lambda f: F.concat(F.lit("missing virtio state field "), f))
    text = lambda ok, t: F.when(~ok, F.lit(t))
    some = F.array_compact(F.array(
        text(F.col("_virtio_evt_notified"), "event queue notify transition is missing"), text(F.col("_virtio_sts_notified"), "status queue notify transition is missing"),
        *[text(F.col(f"_{m}"), f"{m} lifecycle does not {'restore' if v else 'clear'} ready") for m, v in LIFECYCLE],
        text(F.coalesce("_n", F.lit(0)) > 0, "virtqueue/config loops are not represented"), text(F.coalesce("_open", F.lit(0)) == 0, "virtio loop lacks an exact finite bound"),
    ))
    long = F.transform(F.coalesce("_long", F.array().cast("array<bigint>")), lambda n: _cat("virtio loop bound ", n.cast("string"), " exceeds source limit"))
    unreliable = F.transform("_bad", lambda b: F.concat(b, F.lit(" is not reliable")))
    return per.join(lo, driver, "left").select(driver, "ops", F.concat(unreliable, missing, some, long).alias("errors"))


def drain_proof(frame_kind: Column, guard: Column, kinds: Column, pending_addr: Column, ack_addr: Column, ack_var: Column, pending_var: Column, mask_var: Column) -> Column:
    """struct(count, guard_value, max_iterations) of a while loop that reads pending bits and a mask and writes what it found back; null if it is none.

    The guard must assign the acknowledged variable and contain a mask.
    """
    assigns = F.call_function("rlike", guard, _cat(r"\b", ack_var, r"\s*="))
    ok = (frame_kind == "while") & (kinds == F.array(F.lit("Read"), F.lit("Read"), F.lit("Write"))) & (pending_addr == ack_addr) & ack_var.isNotNull() & assigns & guard.contains("&")
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(1).alias("count"), _cat("(", pending_var, " & ", mask_var, ")").alias("guard_value"), F.lit(1).alias("max_iterations")))


def state_bound(init: Column, guard: Column, step: Column) -> Column:
    """struct(var, bound) of a for loop from 0 up to a member of the device's state by ones; null if it is none."""
    clean = lambda c: F.trim(F.regexp_replace(F.trim(c), r";\s*$", ""))
    var = F.nullif(F.regexp_extract(clean(init), r"^(?:[A-Za-z_]\w*(?:\s+[A-Za-z_]\w*)*\s+)?([A-Za-z_]\w*)\s*=\s*0$", 1), F.lit(""))
    limit = r"^([A-Za-z_]\w*)\s*<\s*([A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*)+)$"
    bound = F.nullif(F.regexp_extract(F.trim(guard), limit, 2), F.lit(""))
    by_one = (clean(step) == F.concat(var, F.lit("++"))) | (clean(step) == F.concat(F.lit("++"), var))
    proved = (F.regexp_extract(F.trim(guard), limit, 1) == var) & by_one & bound.isNotNull()
    return F.when(F.coalesce(proved, F.lit(False)), F.struct(var.alias("var"), bound.alias("bound")))


def legacy_verdicts(modules: DataFrame, traced: DataFrame, log: str, exercised: list[str] | None = None) -> DataFrame:
    """(log, verdict, checked, passed, expected, matched) of old listings, whose traces have no segments.

    ``modules`` has (log, module, expected), ``traced`` (log, actual): arrays of accesses.
    Modules of interrupts are not checked, nor are those without an exercised word, if
    such are given. Nothing to check is ``vacuous``; no trace at all is ``empty``.
    """
    name = F.col("module")
    checked = ~F.lower(name).rlike("irq|ack|mask|unmask|handler|interrupt")
    if exercised:
        checked = checked & name.rlike("|".join(exercised))
    j = modules.join(traced, log, "left").withColumn("_c", checked).withColumn("_m", F.when(F.col("_c"), greedy_prefix(F.coalesce("actual", F.array_except("expected", "expected")), F.col("expected"))))
    full = F.col("_c") & (F.col("_m") == F.size("expected"))
    per = j.groupBy(log).agg(F.count_if("_c").alias("checked"), F.count_if(full).alias("passed"), F.coalesce(F.sum(F.when(F.col("_c"), F.size("expected"))), F.lit(0)).alias("expected"), F.coalesce(F.sum("_m"), F.lit(0)).alias("matched"), F.max(F.coalesce(F.size("actual"), F.lit(0))).alias("_t"))
    verdict = F.when(F.col("checked") == 0, "vacuous").when(F.col("_t") <= 0, "empty").when(F.col("passed") < F.col("checked"), "missing").otherwise("ok")
    return per.select(log, verdict.alias("verdict"), "checked", "passed", "expected", "matched")


def clusters_with_evidence(df: DataFrame, entity: str, category: str, text: str) -> DataFrame:
    """(category, n_entities, evidence): for each category the texts of each entity, as a map of sorted arrays."""
    each = df.groupBy(category, entity).agg(F.array_sort(F.collect_list(text)).alias("_t"))
    return each.groupBy(category).agg(F.count(F.lit(1)).alias("n_entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(entity, "_t")))).alias("evidence"))


#: What of an operation or a node is provenance and no meaning.
PROVENANCE = ("op_id", "evidence", "reliability", "address_precision", "value_precision", "path_precision", "path_id", "validation", "validation_error", "metadata", "source")


def semantic_fingerprint(nodes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SHA-256 of what a program means: the canonical JSON of its nodes in order, without provenance.

    Values are quoted, so separators inside them cannot make different programs equal.
    """
    kept = [c for c in sorted(nodes.columns) if c not in (*key, *order, *PROVENANCE)]
    row = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    return nodes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("_t")))).alias("_r")).select(*key, F.sha2(F.concat(F.lit("["), F.array_join("_r._t", ","), F.lit("]")), 256).alias("fingerprint"))


def acceptance(runs: DataFrame, key: str) -> DataFrame:
    """The seven acceptance flags of each run, and whether all hold; a null counts as not held.

    Needs guard_passed, origin, target_errors, strict_complete, compiled (array of booleans),
    semantic_equal, functions_before, functions_after.
    """
    flags = {
        "guard_passed": F.col("guard_passed"), "imported_context_found": F.col("origin").isin("kbuild-cmd", "compile-commands"), "no_target_source_errors": F.col("target_errors") == 0,
        "access_accounting_strict": F.col("strict_complete"), "all_backends_compile": F.forall("compiled", lambda c: F.coalesce(c, F.lit(False))), "semantic_regression_free": F.col("semantic_equal"),
        "function_inventory_stable": F.col("functions_before").eqNullSafe(F.col("functions_after")),
    }
    held = runs.select(key, *[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()])
    return held.withColumn("accepted", F.forall(F.array(*flags), lambda x: x))


#: Queue calls in a loop, and the counter that bounds it.
QUEUE_BOUNDS = {"virtqueue_get_buf": "completed", "virtqueue_detach_unused_buf": "outstanding", "virtqueue_add_inbuf_cache_clean": "queue_depth"}
LOOP_FRAMES = "array<struct<kind:string,loop_kind:string,guard:string,source:string,init:string,step:string,contract:string>>"


def bounded_loop_frames(ops: DataFrame, key: list[str]) -> DataFrame:
    """``ops`` (key, ord, queue_operation, prefix, frames) with loops around queue calls counted up to the queue's counter.

    A loop goes by its source, or its guard without one. Every frame of such a loop, also
    of other operations of the same key, is rewritten; of several calls in one loop the
    last decides. Sizes of id tables become 8. A null array of frames stays null.
    """
    frames = F.col("frames").cast(LOOP_FRAMES)
    name = lambda f: F.coalesce(F.nullif(f["source"], F.lit("")), f["guard"], F.lit(""))
    counter = F.coalesce(*[F.when(F.col("queue_operation") == q, _cat(F.col("prefix"), f"_{c}")) for q, c in QUEUE_BOUNDS.items()])
    around = ops.select(*key, "ord", counter.alias("_c"), F.posexplode(frames).alias("_i", "_f")).where("_c IS NOT NULL AND _f.kind = 'loop'")
    each = around.groupBy(*key, name(F.col("_f")).alias("k")).agg(F.max_by("_c", F.struct("ord", "_i")).alias("v"))
    bounds = each.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_b"))
    sized = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"sizeof\s*\(\s*struct\s+[A-Za-z_]\w*_devids\s*\)", "8")

    def one(f: Column) -> Column:
        field = F.try_element_at(F.col("_b"), name(f))
        kept = f.withField("guard", sized(f["guard"])).withField("source", sized(f["source"]))
        loop = kept.withField("kind", F.lit("loop")).withField("loop_kind", F.lit("for")).withField("init", F.lit("unsigned int __virtio_i = 0")).withField("guard", _cat("__virtio_i < vi->", field)).withField("step", F.lit("__virtio_i++")).withField("contract", F.lit("linux.virtqueue.bounded"))
        return F.when(field.isNotNull(), loop).otherwise(kept)

    return ops.join(bounds, key, "left").withColumn("frames", F.transform(frames, one)).drop("_b")


def base_store(assignments: DataFrame, seeds: DataFrame, macros: DataFrame, unit: str) -> DataFrame:
    """(unit, name, expr): what each variable stands for after the assignments (unit, ord, name, text), made in order.

    ``seeds`` (unit, name) are pointers and mapped bases, which stand for themselves;
    ``macros`` (unit, name, value) are put in as numbers. An assignment takes what names in
    it stand for by then; one with a call in it is passed over. A unit's assignments are
    folded in one row: a function's, not a program's.
    """
    from tracewell.functions.folds import substituted, with_macros

    empty = F.expr("cast(map() AS map<string, string>)")
    start = seeds.where("name IS NOT NULL").groupBy(unit).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", F.col("name").alias("v"))))).alias("_s"))
    numbers = macros.where("value IS NOT NULL").groupBy(unit, "name").agg(F.min("value").alias("value")).groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("value").cast("long")))).alias("_m"))
    ordered = assignments.where(r"name IS NOT NULL AND text IS NOT NULL AND NOT text RLIKE '\\b[A-Za-z_]\\w*\\s*\\('").groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("ord", "name", F.trim("text").alias("text")))).alias("_a"))
    both = start.join(ordered, unit, "full_outer").join(numbers, unit, "left")

    def step(acc: Column, a: Column) -> Column:
        named = substituted(a["text"], acc)
        value = F.when(F.col("_m").isNull(), named).otherwise(with_macros(named, F.col("_m")))
        return F.map_concat(F.map_filter(acc, lambda k, _: k != a["name"]), F.create_map(a["name"], value))

    none = F.expr("cast(array() AS array<struct<ord: bigint, name: string, text: string>>)")
    folded = F.aggregate(F.coalesce(F.col("_a").cast("array<struct<ord: bigint, name: string, text: string>>"), none), F.coalesce("_s", empty), step)
    return both.select(unit, F.explode(folded).alias("name", "expr"))


def expanded_accessors(ops: DataFrame, returns: DataFrame, key: list[str]) -> DataFrame:
    """(key, ord, sub, op) of private accessors with each access through a public one replaced by what that does.

    ``ops`` has (key, ord, op, field, callee, base, reg, value): the field of the table that
    the accessor is for, and the public accessor called, null for other operations, which
    stay. An operation's guard holds for all that it becomes. A reading accessor that
    returns nothing yet returns the expression of ``returns`` (key, field, text), last.
    """
    public = F.col("callee").isin(*FIELD_READS["ioaddr"], *FIELD_WRITES["ioaddr"]) & F.col("op.kind").isin("Read", "Write", "ReadModifyWrite")
    outer = F.col("op.guard")
    both = lambda x: F.when(outer.isNull(), x["guard"]).when(x["guard"].isNull(), outer).otherwise(_cat("(", outer, ") && (", x["guard"], ")"))
    several = F.transform(accessor_operations(F.col("field"), F.col("callee"), F.col("base"), F.col("reg"), F.col("value")).cast(f"array<{OP}>"), lambda x: x.withField("guard", both(x)))
    rows = ops.select(*key, "ord", F.posexplode(F.when(F.coalesce(public, F.lit(False)), several).otherwise(F.array(F.col("op").cast(OP)))).alias("sub", "op"))
    done = rows.where("op.kind = 'Return'").select(*key).distinct()
    more = returns.where("field LIKE 'read\\_%' AND text <> ''").join(done, key, "left_anti").select(*key, F.lit(2_000_000_000).alias("ord"), F.lit(0).alias("sub"), operation("Return", 0, value=F.col("text")).cast(OP).alias("op"))
    return rows.select(*key, F.col("ord").cast("int").alias("ord"), "sub", "op").unionByName(more)


def contract_verdicts(nodes: DataFrame, driver: str, module: str) -> tuple[DataFrame, DataFrame]:
    """(driver, module, gpio, sdhci): which modules a runner may take by contract; and (driver, accessor_only, state_only), of whole drivers.

    ``nodes`` has kind, addr_kind, lowerable, origin, contract, summary, reliability and
    bounded. Modules of both kinds need a leaf and no loop. Leaves of a generic chip's
    configuration come from its summary and are not Unsupported; those of host tables are
    of that contract and neither Unsupported nor Unknown, and waits are let through. An
    address is fixed, symbolic, or computed and lowerable. A driver only has accessors if
    all its leaves are theirs; only state if its leaves are state operations of the bus or
    queues, at least one of them, and its loops are exact and bounded.
    """
    # the names of contracts and summaries are fixed values of the documents
    k = F.col("kind")
    inner = k.isin("Cond", "Seq", "Loop")
    yes = lambda c: F.coalesce(c, F.lit(False))
    register = k.isin("Read", "Write", "ReadModifyWrite")
    address = ~register | F.col("addr_kind").isin("symbolic", "fixed") | ((F.col("addr_kind") == "computed") & yes(F.col("lowerable")))
    state = k.isin("StateRead", "StateWrite", "Return")
    firm = ~F.coalesce("reliability", F.lit("")).isin("Unsupported", "Unknown")
    gpio = yes((register | state | (k == "OutputWrite")) & (F.col("origin") == "subsystem_summary") & (F.col("contract") == "linux.gpio_generic_chip_config") & (F.coalesce("reliability", F.lit("")) != "Unsupported") & address)
    sdhci = yes((k == "Delay") | ((register | state) & (F.col("contract") == "linux.sdhci_ops") & firm & address))
    accessor = yes((k == "Delay") | ((register | state) & (F.col("origin") == "subsystem_summary") & (F.col("summary") == "sdhci_accessor") & firm & address))
    moved = k.isin("StateRead", "StateWrite")
    virtio = yes((k == "Return") | (moved & F.col("contract").isin("linux.virtio_config", "linux.virtqueue", "linux.virtio.lifecycle") & firm))
    leaf, loop = k.isNotNull() & ~inner, k == "Loop"
    every = lambda c: F.coalesce(F.bool_and(F.when(leaf, c)), F.lit(False)) & ~F.coalesce(F.bool_or(loop), F.lit(False))
    exact = yes((F.col("reliability") == "Exact") & F.col("bounded"))
    modules = nodes.groupBy(driver, module).agg(every(gpio).alias("gpio"), every(sdhci).alias("sdhci"))
    only_state = F.coalesce(F.bool_and(F.when(leaf, virtio).when(loop, exact)), F.lit(False)) & F.coalesce(F.bool_or(leaf & moved), F.lit(False))
    return modules, nodes.groupBy(driver).agg(every(accessor).alias("accessor_only"), only_state.alias("state_only"))
