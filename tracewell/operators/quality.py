"""Quality of extracted programs: metrics by module and driver, path and control totals, scores, gates.

Nodes are the rows of op trees, leaves and inner ones: driver, module, kind, addr_kind
(symbolic, fixed, computed), lowerable and value_top (booleans), reliability, bounded.
Each step is one aggregation by key; scores are expressions over one row per driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INNER = ("Cond", "Seq", "Loop")
#: Leaves that are meant for values and state, not for registers.
SEMANTIC = ("StateRead", "StateWrite", "OutputWrite", "Return")
REGISTER = ("Read", "Write", "ReadModifyWrite")
LEVELS = ("Exact", "Conservative", "Unknown", "Unsupported")
COUNTS = ("total_ops", "symbolic", "fixed", "computed", "unsafe_computed", "rmw", "unknown_value", "cond", "loop", "conservative_loop")


def share(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b rounded half to even; null where b is 0."""
    return F.bround(F.try_divide(a.cast("double"), b.cast("double")), digits)


def module_metrics(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Counters by module: operations (delays among them), addresses by kind, unknown values, conditions, loops.

    Conditions and loops are counted at every depth; a loop is conservative unless it is
    bounded and Exact. ``pct_symbolic`` is null without addresses.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kind, addr = F.col("kind"), F.when(F.col("kind").isin(*REGISTER), F.col("addr_kind"))
    out = nodes.groupBy(*key).agg(
        n(~kind.isin(*INNER, *SEMANTIC)).alias("total_ops"),
        *[n(addr == k).alias(k) for k in ("symbolic", "fixed", "computed")],
        n((addr == "computed") & ~F.coalesce(F.col("lowerable"), F.lit(False))).alias("unsafe_computed"),
        n(kind == "ReadModifyWrite").alias("rmw"),
        n(kind.isin("Write", "ReadModifyWrite") & F.col("value_top")).alias("unknown_value"),
        n(kind == "Cond").alias("cond"),
        n(kind == "Loop").alias("loop"),
        n((kind == "Loop") & ~F.coalesce((F.col("reliability") == "Exact") & F.col("bounded"), F.lit(False))).alias("conservative_loop"),
    )
    return out.withColumn("pct_symbolic", share(F.col("symbolic"), F.col("symbolic") + F.col("fixed") + F.col("computed")))


def driver_metrics(modules: DataFrame, nodes: DataFrame, driver: str = "driver") -> DataFrame:
    """Module counters added up by driver, shares, and register operations by reliability (Unknown if not said)."""
    level = F.when(F.col("kind").isin(*REGISTER), F.coalesce("reliability", F.lit("Unknown")))
    levels = nodes.groupBy(driver).agg(*[F.count_if(level == x).alias(x.lower()) for x in LEVELS])
    out = modules.groupBy(driver).agg(*[F.sum(c).alias(c) for c in COUNTS], F.count(F.lit(1)).alias("modules"))
    out = out.withColumn("pct_symbolic", share(F.col("symbolic"), F.col("symbolic") + F.col("fixed") + F.col("computed")))
    return out.withColumn("pct_non_top_value", share(F.col("total_ops") - F.col("unknown_value"), F.col("total_ops"))).join(levels, driver)


def emitted_stats(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Reads, writes and updates by key; conditions count loops as well, and total_ops leaves delays out."""
    k = F.col("kind")
    out = nodes.groupBy(*key).agg(
        F.count_if(k == "Read").alias("mmio_reads"), F.count_if(k == "Write").alias("mmio_writes"), F.count_if(k == "ReadModifyWrite").alias("rmw"), F.count_if(k.isin("Cond", "Loop")).alias("conditions_recorded")
    )
    return out.withColumn("total_ops", F.col("mmio_reads") + F.col("mmio_writes") + F.col("rmw"))


def resolved_places(nodes: DataFrame, registers: DataFrame, driver: str = "driver") -> DataFrame:
    """(driver, resolved): different fixed offsets other than 0 and addresses of updates, and the size of the register map.

    Nodes need ``addr`` (the address as text) and ``offset``.
    """
    k = F.col("kind")
    place = F.when((k == "ReadModifyWrite"), F.concat(F.lit("rmw:"), F.coalesce("addr", F.lit("")))).when(k.isin("Read", "Write") & (F.col("addr_kind") == "fixed") & (F.col("offset") != 0), F.concat(F.lit("at:"), F.col("offset").cast("string")))
    own = nodes.groupBy(driver).agg(F.count_distinct(place).alias("_n"))
    size = registers.groupBy(driver).agg(F.count_distinct("name").alias("_m"))
    return own.join(size, driver, "left").select(driver, (F.col("_n") + F.coalesce("_m", F.lit(0))).alias("resolved"))


def path_totals(paths: DataFrame, pairs: DataFrame, driver: str = "driver") -> DataFrame:
    """Path statuses by driver, whether none is unknown, and switch pairs that are not exclusive."""
    n = lambda s: F.count_if(F.col("status") == s)
    got = paths.groupBy(driver).agg(*[n(s).alias(s) for s in ("satisfiable", "infeasible", "unknown", "intentionally_unreachable")])
    open_pairs = pairs.groupBy(driver).agg(F.count_if(~F.coalesce(F.col("exclusive"), F.lit(False))).alias("_p"))
    return got.join(open_pairs, driver, "left").select("*", (F.col("unknown") == 0).alias("complete"), F.coalesce("_p", F.lit(0)).alias("nonexclusive_switch_pairs")).drop("_p")


def exclusive_pairs(conditions: DataFrame, parent: list[str], switch: str, order: str, values: str) -> DataFrame:
    """Pairs of branches of one switch, in order, and whether no value selects both.

    ``values`` is the array of constants that a branch is taken for, null for a default,
    which is what no other branch takes. A guard that is no comparison with constants has
    an empty array: its pairs are not shown to be exclusive.
    """
    w = conditions.select(*parent, switch, F.col(order).alias("_o"), F.col(values).alias("_v"))
    b = w.select(*parent, switch, F.col("_o").alias("right"), F.col("_v").alias("_w"))
    known = lambda c: F.coalesce(F.size(c) > 0, F.lit(True))
    exclusive = known(F.col("_v")) & known(F.col("_w")) & ~(F.col("_v").isNull() & F.col("_w").isNull()) & ~F.coalesce(F.arrays_overlap("_v", "_w"), F.lit(False))
    return w.join(b, [*parent, switch]).where("_o < right").select(*parent, switch, F.col("_o").alias("left"), "right", exclusive.alias("exclusive"))


def control_totals(transfers: DataFrame, blocks: DataFrame, edges: DataFrame, driver: str = "driver", function: str = "function", backedges: DataFrame | None = None) -> DataFrame:
    """Control accounting by driver.

    ``transfers`` are (driver, function, kind, modeled, in_register_loop, in_switch,
    guarded_by_parameters, before_register, resolved) rows, one for each goto, continue,
    break and return. What is not modeled is unsupported if it can change which registers
    are reached: a goto; a continue, or a break out of no switch, in a loop with register
    accesses; a return guarded by parameters before one. ``complete`` needs none of them
    and no goto without its target. ``syntax.control_facts`` makes the transfers from
    statements; with ``backedges`` (driver, function, src, dst) they are counted as well.
    """
    t = F.col("kind")
    bad = (
        ((t == "goto") & ~F.col("modeled")) | (t.isin("continue") & F.col("in_register_loop")) | ((t == "break") & F.col("in_register_loop") & ~F.col("in_switch"))
        | ((t == "return") & ~F.col("modeled") & F.col("guarded_by_parameters") & F.col("before_register"))
    )
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = transfers.groupBy(driver).agg(
        flag((t == "return") & F.col("modeled")).alias("modeled_early_returns"), flag((t == "goto") & F.col("modeled")).alias("modeled_forward_gotos"),
        flag(bad).alias("unsupported"), flag((t == "goto") & ~F.col("resolved")).alias("_open"),
    )
    b = blocks.groupBy(driver).agg(F.count_distinct(function).alias("function_count"), F.count(F.lit(1)).alias("block_count"))
    e = edges.groupBy(driver).agg(F.count(F.lit(1)).alias("edge_count"))
    j = edges.groupBy(driver, function, "dst").agg(F.count_distinct("src").alias("_n")).where("_n > 1").groupBy(driver).agg(F.count(F.lit(1)).alias("join_count"))
    out = got.join(b, driver, "left").join(e, driver, "left").join(j, driver, "left")
    zero = {c: 0 for c in ("function_count", "block_count", "edge_count", "join_count")}
    if backedges is not None:
        out, zero["backedge_count"] = out.join(backedges.groupBy(driver).agg(F.count(F.lit(1)).alias("backedge_count")), driver, "left"), 0
    return out.withColumn("complete", (F.col("unsupported") == 0) & (F.col("_open") == 0)).drop("_open").fillna(zero)


# ---------------------------------------------------------------- scores and gates


def register_quality(c) -> Column:
    """The weighted quality of a driver's register operations less a penalty for diagnostics, from 0 to 1.

    ``c`` gives the column of a counter. Weights: safe addresses 0.5, symbolic ones 0.2,
    known values 0.2, no computed address 0.1 (else 0.05). 0.01 for each diagnostic, 0.2 at most.
    """
    ops, addresses = F.when(c("total_ops") > 0, c("total_ops")).otherwise(1), c("symbolic") + c("fixed") + c("computed")
    addresses = F.when(addresses > 0, addresses).otherwise(1)
    raw = (
        0.5 * ((addresses - c("unsafe_computed")) / addresses) + 0.2 * (c("symbolic") / addresses) + 0.2 * ((ops - c("unknown_value")) / ops) + 0.1 * F.when(c("computed") == 0, 1.0).otherwise(0.5)
    )
    return F.bround(F.greatest(F.lit(0.0), raw - F.least(F.lit(0.2), c("clang_diag") * 0.01)), 3)


def device_quality(c) -> Column:
    """Up to eight mapped registers 0.5, resolved resources 0.3, any state 0.2."""
    return F.bround(0.5 * (F.least(c("register_map"), F.lit(8)) / 8) + 0.3 * (c("resources_resolved") / F.greatest(c("resources"), F.lit(1))) + 0.2 * F.when(c("state_fields") > 0, 1.0).otherwise(0.0), 3)


def facts_quality(c) -> Column:
    """Structs and callbacks 0.3 each, resources 0.2, error paths and helper calls 0.1 each; 0 without facts."""
    part = lambda name, w: F.when(c(name) > 0, w).otherwise(0.0)
    return F.when(c("has_facts"), F.bround(part("structs", 0.3) + part("callbacks", 0.3) + part("fact_resources", 0.2) + part("error_paths", 0.1) + part("helper_calls", 0.1), 3)).otherwise(F.lit(0.0))


#: Counters and the texts of their blockers, in the order in which they are listed.
COUNTED = (
    ("unaccounted", "source MMIO access site(s) unaccounted"),
    ("ris_ops_without_evidence", "RIS operation(s) lack source evidence"),
    ("filtered", "source MMIO access site(s) explicitly filtered"),
    ("unsupported", "source register/opaque access site(s) unsupported"),
    ("path_unknown", "path predicate(s) not SMT-validated"),
    ("path_infeasible", "contradictory/infeasible RIS path(s)"),
    ("nonexclusive_switch_pairs", "switch path pair(s) not proven exclusive"),
    ("unsupported_ops", "register operation(s) use unsupported access domain"),
    ("unsupported_control", "unsupported control-flow transfer(s)"),
    ("unmodeled_callbacks", "subsystem library callback(s) lack semantic summary"),
)


def readiness(rows: DataFrame) -> DataFrame:
    """Four qualities, the blockers, and four gates of each driver, added to its row of counters.

    Needs the counters of ``driver_metrics``, those in COUNTED, and clang_diag, register_map,
    resources, resources_resolved, state_fields, spec_registers, has_facts, structs,
    callbacks, fact_resources, error_paths, helper_calls, functions, functions_with_role,
    unroled and unbound (arrays of names), strict_complete, path_complete,
    unvalidated_callbacks, subsystem_access. A driver without a run of its generated code
    is judged by these alone; for one with a run see ``backend_ready``.
    """
    c = F.col
    rows = rows.withColumns({"ris_quality": register_quality(c), "function_spec_quality": F.coalesce(share(c("functions_with_role"), c("functions")), F.lit(0.0)), "device_spec_quality": device_quality(c), "facts_quality": facts_quality(c)})
    count = lambda name, text: F.when(c(name) > 0, F.concat(c(name).cast("string"), F.lit(" " + text)))
    access = (c("symbolic") + c("fixed") + c("computed") > 0) | c("subsystem_access")
    generic = (c("unmodeled_callbacks") == 0) & (c("unvalidated_callbacks") == 0)
    texts = [
        *[count(n, t) for n, t in COUNTED],
        F.when(c("unsafe_computed") > 0, F.format_string("%d unsafe dynamic register address(es) (%d computed total)", "unsafe_computed", "computed")),
        count("unknown_value", "unknown (Top) value(s)"), count("clang_diag", "clang error diagnostic(s)"), count("conservative_loop", "conservative loop summary/summaries require validation"),
        F.when(F.size("unroled") > 0, F.concat(F.lit("missing role for: "), F.array_join("unroled", ", "))),
        F.when(F.size("unbound") > 0, F.concat(F.lit("callback entry without table binding: "), F.array_join("unbound", ", "))),
        F.when(~access, F.lit("no MMIO register accesses")),
        F.when((c("unvalidated_callbacks") > 0) & ~generic, F.concat(c("unvalidated_callbacks").cast("string"), F.lit(" synthesized subsystem callback(s) lack generic-backend execution oracle"))),
    ]
    paths = c("path_complete") & (c("path_infeasible") == 0) & (c("nonexclusive_switch_pairs") == 0)
    clean = (c("unsafe_computed") == 0) & (c("unknown_value") == 0) & (c("unsupported_ops") == 0) & (c("unsupported_control") == 0) & (c("conservative_loop") == 0)
    base = c("strict_complete") & paths & access & clean
    generic_ready = base & generic & (c("ris_quality") >= 0.7)
    return rows.withColumns({
        "blockers": F.filter(F.array(*texts), lambda x: x.isNotNull()),
        "harness_ready": generic_ready, "bare_metal_ready": generic_ready,
        "linux_ready": base & (c("unmodeled_callbacks") == 0) & (c("function_spec_quality") >= 0.6) & (F.size("unbound") == 0),
        "llm_synthesis_ready": (c("ris_quality") >= 0.7) & (c("function_spec_quality") >= 0.5) & (c("facts_quality") >= 0.6) & (c("spec_registers") > 0),
    })


def backend_ready(rows: DataFrame, runs: DataFrame, driver: str = "driver") -> DataFrame:
    """The harness, bare_metal and linux gates of ``readiness`` replaced by what a run of the generated code shows.

    ``runs`` has a row for each (driver, backend) with compiled, has_todo, unsupported,
    trace_passed, syntax_ok, callback_oracle (the callbacks' own oracle passed) and
    sources_ok (every required source oracle passed). A backend without a run keeps its gate.
    """
    flags = ("compiled", "has_todo", "unsupported", "trace_passed", "syntax_ok", "callback_oracle", "sources_ok")
    c = F.col
    yes = lambda b, f: F.coalesce(c(f"_{b}.{f}"), F.lit(False))
    for b in ("harness", "bare_metal", "linux"):
        rows = rows.join(runs.where(F.col("backend") == b).select(driver, F.struct(*flags).alias(f"_{b}")), driver, "left")
    access = (c("symbolic") + c("fixed") + c("computed") > 0) | c("subsystem_access")
    paths = c("path_complete") & (c("path_infeasible") == 0) & (c("nonexclusive_switch_pairs") == 0)
    common = c("strict_complete") & paths & access & (c("unmodeled_callbacks") == 0) & (c("unsafe_computed") == 0) & (c("unknown_value") == 0) & (c("unsupported_ops") == 0) & (c("unsupported_control") == 0)

    def gate(b: str) -> Column:
        ran = common & yes(b, "sources_ok") & yes(b, "compiled") & ~yes(b, "has_todo") & ~yes(b, "unsupported")
        if b == "linux":
            ran = ran & (c("function_spec_quality") >= 0.6) & (F.size("unbound") == 0) & yes(b, "syntax_ok")
        else:
            ran = ran & (c("conservative_loop") == 0) & ((c("unvalidated_callbacks") == 0) | yes(b, "callback_oracle"))
        if b == "harness":
            ran = ran & yes(b, "trace_passed")
        return F.when(c(f"_{b}").isNull(), c(f"{b}_ready")).otherwise(ran)

    return rows.withColumns({f"{b}_ready": gate(b) for b in ("harness", "bare_metal", "linux")}).drop("_harness", "_bare_metal", "_linux")


#: The names of the whole-program gates.
PROGRAM_GATES = {
    "linked_alias_complete": lambda c: c("alias_complete"),
    "all_translation_units_linked": lambda c: c("linked_units") == c("units"),
    "linked_bitcode_hashed": lambda c: F.coalesce(c("bitcode_sha256"), F.lit("")) != "",
    "internal_calls_resolved": lambda c: c("unresolved_calls") == 0,
    "access_accounting_strict": lambda c: c("strict_complete"),
    "control_accounting_complete": lambda c: c("control_complete"),
    "cfg_complete": lambda c: c("cfg_complete"),
    "path_validation_complete": lambda c: c("path_complete"),
    "path_validation_no_unknown": lambda c: c("path_unknown") == 0,
    "path_validation_no_infeasible": lambda c: c("path_infeasible") == 0,
    "switch_paths_exclusive": lambda c: c("nonexclusive_switch_pairs") == 0,
    "operation_ids_unique": lambda c: c("op_ids") == c("distinct_op_ids"),
    "operation_evidence_complete": lambda c: c("ris_ops_without_evidence") == 0,
    "computed_addresses_lowerable": lambda c: c("unsafe_computed") == 0,
    "values_complete": lambda c: c("unknown_value") == 0,
    "loops_proved": lambda c: c("conservative_loop") == 0,
    "access_domains_supported": lambda c: c("unsupported_ops") == 0,
}


def program_gates(rows: DataFrame) -> DataFrame:
    """``gates`` (a map of the seventeen whole-program gates) and ``whole_program_complete``, added to each row; null counts as not held."""
    pairs = [F.struct(F.lit(n).alias("k"), F.coalesce(g(F.col), F.lit(False)).alias("v")) for n, g in PROGRAM_GATES.items()]
    rows = rows.withColumn("gates", F.map_from_entries(F.array(*pairs)))
    return rows.withColumn("whole_program_complete", F.forall(F.map_values("gates"), lambda g: g))


def paper_totals(rows: DataFrame, means: list[str], flags: list[str]) -> DataFrame:
    """One row: number of rows, means of some columns rounded to three digits, and how often each flag holds."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.bround(F.avg(m), 3).alias(f"mean_{m}") for m in means], *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags])
