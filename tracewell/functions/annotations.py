"""Labels of operations and reports: intent, precision, reliability, blockers, diagnostics, address forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that an intent goes by.
_HANDLER_WORDS = "IRQ|HANDLER|ACK|MASK|UNMASK|SET_IRQ_TYPE"
_REMOVE_WORDS = "REMOVE|SHUTDOWN|SUSPEND"
_ZEROS = ("0", "0X0", "0X00", "0X00000000")
#: Categories of blockers in the order they are tried, and what their texts contain.
BLOCKERS = (
    ("source_access_unaccounted", r"source MMIO access site\(s\) unaccounted"),
    ("ris_evidence_missing", r"RIS operation\(s\) lack source evidence"),
    ("source_access_filtered", r"source MMIO access site\(s\) explicitly filtered"),
    ("unsupported_access", r"(?:source register/opaque access site\(s\) unsupported|register operation\(s\) use unsupported access domain)"),
    ("path_unvalidated", r"path predicate\(s\) not SMT-validated"),
    ("path_infeasible", r"contradictory/infeasible RIS path\(s\)"),
    ("switch_exclusivity", r"switch path pair\(s\) not proven exclusive"),
    ("unsupported_control_flow", r"unsupported control-flow transfer\(s\)"),
    ("subsystem_summary", r"subsystem library callback\(s\) lack semantic summary"),
    ("subsystem_validation", r"synthesized subsystem callback\(s\) lack generic-backend execution oracle"),
    ("unsafe_dynamic_address", r"unsafe dynamic register address\(es\)"),
    ("unknown_value", r"unknown \(Top\) value\(s\)"),
    ("clang_diagnostics", r"clang error diagnostic\(s\)"),
    ("conservative_loop", r"conservative loop summary/summaries require validation"),
    ("missing_role", r"^missing role for:"),
    ("callback_binding", r"^callback entry without table binding:"),
    ("no_register_access", r"^no MMIO register accesses$"),
    ("linux_semantic_binding", r"^linux backend has unsupported semantic bindings$"),
)
#: Fixed value: what stands for others and is never chosen as the first common blocker.
UMBRELLA = ("linux_semantic_binding",)


def address_text(kind: Column, base: Column, offset: Column) -> Column:
    """How an address is searched for words: Fixed as a number, others as base and offset; empty for other kinds."""
    number = F.concat(F.lit("0x"), F.hex(offset.cast("bigint")))
    more = F.when(F.coalesce(offset, F.lit(0)) != 0, F.concat(F.lit(" + "), number)).otherwise(F.lit(""))
    return F.when(kind == "Fixed", number).when(kind.isin("Offset", "Indirect"), F.concat(F.upper(F.coalesce(base, F.lit(""))), more)).otherwise(F.lit(""))


#: Words of a register or address that tell what an operation is for.
INTENT_WORDS = {
    "handled": "INT|IRQ|CLR|MASK|EN", "power": "POWER|PM|SUSPEND|CLK|CLOCK", "init": "INIT|RESET|SOFT_RESET", "status": "STATUS|STAT|FLAG|RAW|MASKED", "interrupt": "INT|IRQ", "data": "TX|RX|DATA|FIFO",
    "config": "CONFIG|MODE|CTRL|DIR|PULL|DEBOUNCE|TYPE|EDGE|LEVEL|PRESCALE", "sync": "DOORBELL|NOTIFY|READY",
}


def intent(kind: Column, function: Column, register: Column, address: Column, value: Column, known: Column | None = None) -> Column:
    """What an operation is for, by the first of ten rules that holds, else Status for reads and Config for others.

    ``known`` is an intent that is already there; it stays unless it is empty or Unknown.
    """
    name = F.upper(F.coalesce(function, F.lit("")))
    search = F.upper(F.concat_ws(" ", F.coalesce(register, F.lit("")), F.coalesce(address, F.lit(""))))
    zero = F.upper(F.coalesce(value, F.lit(""))).isin(*_ZEROS)
    has = lambda which: search.rlike(INTENT_WORDS[which])
    irq, remove = name.rlike(_HANDLER_WORDS), name.rlike(_REMOVE_WORDS)
    out = F.when(F.coalesce(known, F.lit("")).isin("", "Unknown") == F.lit(False), known) if known is not None else F.when(F.lit(False), F.lit(None).cast("string"))
    return (
        out.when(irq & has("handled"), "Interrupt").when(has("power"), "Power").when(remove & zero, "Power").when(has("init"), "Init")
        .when((kind == "Write") & zero & ~irq, "Init").when((kind == "Read") & has("status"), "Status").when(has("interrupt"), "Interrupt")
        .when(has("data"), "DataTransfer").when(has("config"), "Config").when(has("sync"), "Synchronization")
        .when(kind == "Read", "Status").otherwise("Config")
    )


def precision(addr_kind: Column, addr_top: Column, value_top: Column, n_conditions: Column, domain: Column) -> Column:
    """struct(address, value, path, reliability) of a register operation.

    Reliability: Unsupported outside plain memory access, else Unknown if address or value
    is, else Conservative under conditions, else Exact.
    """
    address = F.when(addr_kind.isin("symbolic", "fixed"), addr_kind).when((addr_kind == "computed") & ~F.coalesce(addr_top, F.lit(False)), "computed").otherwise("unknown")
    value = F.when(F.coalesce(value_top, F.lit(False)), "unknown").otherwise("exact")
    path = F.when(F.coalesce(n_conditions, F.lit(0)) > 0, "syntactic").otherwise("unconditional")
    level = F.when(F.coalesce(domain, F.lit("mmio")) != "mmio", "Unsupported").when((address == "unknown") | (value == "unknown"), "Unknown").when(path == "syntactic", "Conservative").otherwise("Exact")
    return F.struct(address.alias("address"), value.alias("value"), path.alias("path"), level.alias("reliability"))


def semantic_precision(value_top: Column, n_conditions: Column, domain: Column) -> Column:
    """struct(value, path, reliability) of a state or result operation, which has no address."""
    value = F.when(F.coalesce(value_top, F.lit(False)), "unknown").otherwise("exact")
    path = F.when(F.coalesce(n_conditions, F.lit(0)) > 0, "syntactic").otherwise("unconditional")
    level = F.when(F.coalesce(domain, F.lit("source_state")).startswith("unsupported"), "Unsupported").when(value == "unknown", "Unknown").when(path == "syntactic", "Conservative").otherwise("Exact")
    return F.struct(value.alias("value"), path.alias("path"), level.alias("reliability"))


def blocker_category(text: Column) -> Column:
    """The first category whose pattern the text contains, else unclassified."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in BLOCKERS], F.lit("unclassified"))


def is_error(warning: Column) -> Column:
    """Whether a diagnostic is an error or fatal (severity 3 or 4)."""
    return F.coalesce(warning.contains("clang diag[3]") | warning.contains("clang diag[4]"), F.lit(False))


def is_target_diagnostic(warning: Column, source: Column) -> Column:
    """Whether a diagnostic is about the source itself and not about what it includes."""
    return F.coalesce(warning.startswith("clang diag[") & F.contains(warning, source), F.lit(False))


def formal_address(kind: Column, base: Column, offset: Column, register: Column) -> Column:
    """struct(kind, base, register, offset) of an address: symbolic if its register has a name, else by its form.

    Fixed and Offset become fixed, Indirect computed, with its base and offset kept;
    anything else is computed with no base.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    named = text(register) != ""
    number = F.coalesce(offset.cast("bigint"), F.lit(0).cast("bigint"))
    none, gone = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    of = lambda k, b, r, o: F.struct(F.lit(k).alias("kind"), b.alias("base"), r.alias("register"), o.alias("offset"))
    return (
        F.when(named, of("symbolic", F.when(kind.isin("Offset", "Indirect"), text(base)).otherwise(F.lit("")), register, gone))
        .when(kind == "Offset", of("fixed", text(base), none, number)).when(kind == "Indirect", of("computed", text(base), none, number))
        .when(kind == "Fixed", of("fixed", F.lit(""), none, number)).otherwise(of("computed", none, none, gone))
    )


def value_address(tag: Column, base: Column, offset: Column, number: Column) -> Column:
    """struct(kind, base, offset) of the address that an abstract value denotes; null if it is none."""
    of = lambda k, b, o: F.struct(F.lit(k).alias("kind"), b.cast("string").alias("base"), o.cast("bigint").alias("offset"))
    return F.when(tag == "BasePtr", of("Offset", base, F.lit(0))).when(tag == "Offset", of("Offset", base, offset)).when(tag == "Const", of("Fixed", F.lit(None), number))


def value_text(tag: Column, number: Column, text: Column) -> Column:
    """The text of an abstract value that is written: a non-negative number in hex, or a symbolic text; else null."""
    return F.when((tag == "Const") & (number >= 0), F.concat(F.lit("0x"), F.lower(F.hex(number.cast("bigint"))))).when(tag == "SymExpr", text)


def width_name(n: Column) -> Column:
    """B1, B2, B4 or B8; B4 for other sizes."""
    return F.when(n.isin(1, 2, 4, 8), F.concat(F.lit("B"), n.cast("string"))).otherwise(F.lit("B4"))
