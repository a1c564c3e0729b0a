"""Ordered rules and proofs on names, loops, addresses and clock registers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.expressions import let, shift_left
from tracewell.sources.builds import int_literal

#: The words that hint at a role, in the order they are tried.
ROLE_HINTS = (
    ("probe", "probe"), ("remove", "remove"), ("shutdown", "remove"), ("suspend", "suspend"), ("resume", "resume"),
    ("ack_irq", "interrupt_ack"), ("mask_irq", "interrupt_mask"), ("unmask_irq", "interrupt_unmask"), ("set_irq_type", "set_irq_type"),
    ("irq_handler", "interrupt_handler"), ("handler", "interrupt_handler"), ("setup_queue", "setup_queue"), ("init_device", "init"),
    ("notify", "notify"), ("get_status", "get_status"), ("set_status", "set_status"), ("reset", "reset"), ("init", "init"),
)
#: The words that hint at a device class, in the order they are tried.
CLASS_HINTS = (
    ("gpio", "gpio_controller"), ("clk", "clock"), ("pll", "clock"), ("virtio", "virtio_mmio"), ("ahci", "ahci"),
    ("sdhci", "sdhci"), ("rtc", "rtc"), ("i2c", "i2c"), ("spi", "spi"),
)
#: The leaves of an address that can be emitted as they are.
LOWERABLE = (
    r"(?U)^(?:[A-Za-z_]\w*|sizeof\s+[A-Za-z_]\w*|[A-Za-z_]\w*->(?:base|regs|ioaddr|hwirq|[A-Za-z_]\w*_base)|[A-Za-z_]\w*->(?:flags|nr_ports)"
    r"|[A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*)*(?:->|\.)hpi(?:->|\.)(?:base|regstep))$"
)
#: Most turns of a loop that still counts as bounded.
MAX_TURNS = 256
#: Fixed values of the clock registers: masks, their places, and the limits of the oscillator in Hz.
BYPASS, ENABLE = 0x2, 0x1
DIVF, DIVF_AT, DIVQ, DIVQ_AT = 0x0FF00000, 20, 0x00070000, 16
BUS_DIV, BUS_DIV_AT, PERIPHERAL_DIV = 0x6, 1, 0x1
VCO_MIN = 2_133_000_000


def hinted(name: Column, hints: tuple[tuple[str, str], ...]) -> Column:
    """What the first word found in the lower-cased name stands for; null without one."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(word), F.lit(value)) for word, value in hints])


def is_noise(name: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a constant's name starts with a prefix, or is lower-case and of at most eight characters."""
    out = (F.lower(name) == name) & (F.upper(name) != name) & (F.length(name) <= 8)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def lowerable(tokens: Column) -> Column:
    """Whether all leaves of a postfix address can be emitted without approximation; false without tokens."""
    fine = F.forall(tokens, lambda t: F.when(t["tok"] == "Var", F.trim(t["name"]).rlike(LOWERABLE)).otherwise(t["tok"] != "Top"))
    return F.coalesce(fine & (F.size(tokens) > 0), F.lit(False))


def loop_bound(init: Column, guard: Column, step: Column, macros: Column | None = None) -> Column:
    """struct(var, start, bound, stride, count) of a counting loop, or null if its bound is not proved.

    A loop counts up from a value while below (or at) another, by one or by a positive
    stride; the values are literals, or names in the ``macros`` map. More than MAX_TURNS
    turns count as unproved; one whose bound is not above its start takes none.
    """

    def number(text: Column) -> Column:
        text = F.trim(text)
        return F.coalesce(int_literal(text), F.try_element_at(macros, text)) if macros is not None else int_literal(text)

    def part(text: Column, pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(F.regexp_replace(F.trim(text), r"\s*;\s*$", ""), pattern, k), F.lit(""))

    begin = r"(?U)^(?:[A-Za-z_]\w*\s+)*([A-Za-z_]\w*)\s*=\s*([^=].*)$"
    limit = r"(?U)^([A-Za-z_]\w*)\s*(<=|<)\s*([^<=].*)$"
    by_more = r"(?U)^([A-Za-z_]\w*)\s*\+=\s*(.+)$"
    one = F.nullif(F.regexp_extract(F.trim(step), r"(?U)^(?:\+\+([A-Za-z_]\w*)|([A-Za-z_]\w*)\+\+)\s*;?$", 0), F.lit(""))
    read = F.struct(
        part(init, begin, 1).alias("var"), part(guard, limit, 1).alias("guarded"), F.coalesce(F.regexp_extract(one, r"(?U)\w+", 0), part(step, by_more, 1)).alias("stepped"),
        number(part(init, begin, 2)).alias("start"), number(part(guard, limit, 3)).alias("bound"), F.when(part(guard, limit, 2) == "<=", 1).otherwise(0).alias("more"),
        F.when(one.isNotNull(), F.lit(1).cast("bigint")).otherwise(number(part(step, by_more, 2))).alias("stride"),
    )

    def proof(r: Column) -> Column:
        whole = F.call_function("div", r["bound"] - r["start"] + r["more"] + r["stride"] - 1, F.nullif(r["stride"], F.lit(0).cast("bigint")))
        count = F.greatest(whole, F.lit(0).cast("bigint"))
        proved = (r["guarded"] == r["var"]) & (r["stepped"] == r["var"]) & (r["stride"] > 0) & r["start"].isNotNull() & r["bound"].isNotNull() & (count <= MAX_TURNS)
        return F.when(proved, F.struct(r["var"].alias("var"), r["start"].alias("start"), r["bound"].alias("bound"), r["stride"].alias("stride"), count.alias("count")))

    return let(read, proof)


def resource_bindings(text: Column, call: str = "devm_platform_ioremap_resource") -> Column:
    """Map of what is assigned the call's result to the resource index in it; the last of a name wins."""
    one = r"(?U)\b([A-Za-z_]\w*(?:\s*->\s*[A-Za-z_]\w*)?)\s*=\s*" + call + r"\s*\([^,]+,\s*([0-9]+)\s*\)"
    found = F.regexp_extract_all(text, F.lit(one), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, one, 1), r"\s+", "").alias("k"), F.regexp_extract(x, one, 2).cast("int").alias("v")))
    none = F.expr("cast(array() as array<struct<k:string,v:int>>)")
    last = F.aggregate(pairs, none, lambda acc, p: F.concat(F.filter(acc, lambda q: q["k"] != p["k"]), F.array(p)))
    return F.map_from_entries(last)


def device_ids(text: Column, macros: Column) -> Column:
    """array(vendor, device) of the first PCI_DEVICE pair, by value or through the ``macros`` map; null if either is unknown."""
    token = r"(0[xX][0-9a-fA-F]+|\d+|[A-Za-z_]\w*)"
    pair = rf"PCI_DEVICE\s*\(\s*{token}\s*,\s*{token}\s*\)"
    raw = [F.nullif(F.regexp_extract(text, pair, k), F.lit("")) for k in (1, 2)]
    ids = [F.coalesce(int_literal(r), F.try_element_at(macros, r)) for r in raw]
    return F.when(ids[0].isNotNull() & ids[1].isNotNull(), F.array(*ids))


def without_calls(text: Column, argument: str, callee: str = "writel") -> Column:
    """A text without the lines that are one call with a match of ``argument`` in it."""
    return F.regexp_replace(text, rf"(?m)^[ \t]*{callee}\([^;]*{argument}[^;]*\);[ \t]*\n", "")


def sources_listed(build_text: Column, sources: Column) -> Column:
    """Whether a build file names the object of every source; true without sources."""
    return F.forall(sources, lambda s: F.contains(build_text, F.concat(F.regexp_replace(F.regexp_extract(s, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", ""), F.lit(".o"))))


def line_counts(text: Column) -> Column:
    """struct(lines, non_blank); a break at the end starts no further line, and a null text has none."""
    each = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\z", ""), "\n")
    blank = F.coalesce(text, F.lit("")) == ""
    return F.struct(F.when(blank, 0).otherwise(F.size(each)).alias("lines"), F.size(F.filter(each, lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")).alias("non_blank"))


def pll(rate: Column, reference: Column) -> Column:
    """struct(divq, divf) that bring an oscillator of ``reference`` Hz to a rate, held within its limits."""
    r = F.least(F.greatest(rate.cast("bigint"), F.lit(VCO_MIN // 64)), F.lit(VCO_MIN))
    divq = F.lit(1) + sum((F.when(shift_left(r, F.lit(q)) < VCO_MIN, 1).otherwise(0) for q in range(1, 7)), F.lit(0))
    divf = F.call_function("div", shift_left(r, divq) + F.call_function("div", reference, F.lit(2).cast("bigint")), reference) - 1
    return F.struct(divq.cast("bigint").alias("divq"), divf.alias("divf"))


def clock(mode: Column, reg: Column, a: Column, b: Column) -> Column:
    """struct(status, value, reg) of a clock operation on a register.

    Modes: 1 rate of the PLL, 2 peripheral rate, 3 bus rate, 4 peripheral clock rate, 5
    nearest PLL rate, 6 nearest peripheral rate, 7 set a peripheral rate (status -22 if
    the divider is odd), 8 set a PLL rate. Others give null.
    """
    reg, a, b = (c.cast("bigint") for c in (reg, a, b))
    div = lambda x, y: F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint")))
    big = lambda n: F.lit(n).cast("bigint")
    bits = lambda mask, at: F.call_function("shiftright", reg.bitwiseAND(big(mask)), F.lit(at))
    clear = lambda x, mask: x - x.bitwiseAND(big(mask))
    p = pll(a, b)
    ratio = div(b, a)
    value = (
        F.when((mode == 1) & (reg.bitwiseAND(big(BYPASS)) != 0), a)
        .when(mode == 1, div(a * (bits(DIVF, DIVF_AT) + 1), shift_left(F.lit(1), bits(DIVQ, DIVQ_AT))))
        .when(mode == 2, div(a, F.when(reg.bitwiseAND(big(PERIPHERAL_DIV)) != 0, big(8)).otherwise(big(4))))
        .when(mode == 3, div(a, bits(BUS_DIV, BUS_DIV_AT) + 2))
        .when(mode == 4, div(a, (reg.bitwiseAND(big(0x1F)) + 1) * 2))
        .when(mode == 5, div(b * (p["divf"] + 1), shift_left(F.lit(1), p["divq"])))
        .when(mode == 6, div(b, div(ratio + 1, big(2)) * 2))
        .when(mode.isin(7, 8), big(0))
    )
    other = clear(clear(reg, DIVF | DIVQ), BYPASS | ENABLE) + shift_left(p["divf"], F.lit(DIVF_AT)).bitwiseOR(shift_left(p["divq"], F.lit(DIVQ_AT))) + ENABLE
    same = clear(reg, DIVQ).bitwiseOR(shift_left(p["divq"], F.lit(DIVQ_AT)))
    after = (
        F.when((mode == 7) & (ratio % 2 == 0), div(ratio, big(2)))
        .when(mode == 8, F.when(p["divf"] != bits(DIVF, DIVF_AT), other).otherwise(same)).otherwise(reg)
    ).bitwiseAND(big(0xFFFFFFFF))
    status = F.when((mode == 7) & (ratio % 2 == 1), -22).otherwise(0)
    return F.when(value.isNotNull(), F.struct(status.alias("status"), value.alias("value"), after.alias("reg")))


def code_only(text: Column) -> Column:
    """C text with comments made a space, then strings and characters made empty, in this order."""
    for pattern, to in ((r"(?s)/\*.*?\*/", " "), (r"//[^\n]*", " "), (r'(?s)"(?:\\[^\n]|[^"\\])*+"', '""'), (r"(?s)'(?:\\[^\n]|[^'\\])*+'", "''")):
        text = F.regexp_replace(text, pattern, to)
    return text


def call_count(code: Column, names: tuple[str, ...]) -> Column:
    """How many calls of any of the names a text has."""
    return F.regexp_count(code, F.lit(r"(?U)\b(?:" + "|".join(sorted(names)) + r")\s*\("))
