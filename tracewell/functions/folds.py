"""Texts of C put together from rows: names replaced, and assignments and returns merged, as folds over arrays.

Everything here is a column expression; nothing parses. A value that depends on conditions
becomes a conditional expression, innermost the value that holds without any.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substituted(text: Column, mapping: Column) -> Column:
    """A text with whole names replaced by what a map of texts has for them; the name of a member is left alone."""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*|\d\w*|\W+"), F.lit(0))

    def one(all_: Column) -> Column:
        name = lambda t, i: t.rlike(r"^[A-Za-z_]") & ~F.coalesce(F.when(i > 0, F.get(all_, i - 1)).rlike(r"(->|\.)\s*$"), F.lit(False))
        return F.array_join(F.transform(all_, lambda t, i: F.when(name(t, i), F.coalesce(F.try_element_at(mapping, t), t)).otherwise(t)), "")

    # the array of one element has the tokens cut once
    return F.when(mapping.isNull(), text).otherwise(F.get(F.transform(F.array(tokens), one), 0))


def with_macros(text: Column, macros: Column) -> Column:
    """A text with the names of numeric macros (a map of numbers) replaced: by hex, or by decimal if negative."""
    return substituted(text, F.transform_values(macros, lambda _, v: F.when(v >= 0, F.concat(F.lit("0x"), F.lower(F.hex(v)))).otherwise(v.cast("string"))))


def _choice(guard: Column, then: Column, other: Column) -> Column:
    return F.concat(F.lit("(("), guard, F.lit(") ? ("), then, F.lit(") : ("), other, F.lit("))"))


def _all(guards: Column) -> Column:
    return F.array_join(F.transform(guards, lambda g: F.concat(F.lit("("), F.trim(g), F.lit(")"))), " && ")


def _listed(rows: Column, kind: str) -> Column:
    return F.coalesce(rows.cast(kind), F.expr(f"cast(array() AS {kind})"))


def mutated(value: Column, op: Column, text: Column) -> Column:
    """A value after an assignment: the text itself, or the value combined with it."""
    return F.when(op == "=", F.trim(text)).otherwise(F.concat(F.lit("("), value, F.lit(" "), F.substring(op, F.lit(1), F.length(op) - 1), F.lit(" ("), F.trim(text), F.lit("))")))


def returned(returns: Column) -> Column:
    """One expression for all returns of a function, in source order: structs of text, guards and plain.

    ``plain`` says that only conditions are around the return. Null if there is none, if
    one is in a loop or has an empty guard, or unless the last one alone is unguarded.
    """
    rows = _listed(returns, "array<struct<text:string,guards:array<string>,plain:boolean>>")

    def merged(r: Column) -> Column:
        n, last = F.size(r), F.element_at(r, -1)
        before = F.slice(r, F.lit(1), n - 1)
        empty = lambda g: F.coalesce(F.trim(g), F.lit("")) == ""
        bad = F.exists(r, lambda x: ~F.coalesce(x["plain"], F.lit(False)) | F.exists(F.coalesce(x["guards"], F.expr("cast(array() AS array<string>)")), empty))
        free = lambda x: F.coalesce(F.size(x["guards"]), F.lit(0)) <= 0
        same = F.size(F.array_distinct(F.transform(r, lambda x: x["text"]))) == 1
        folded = F.aggregate(F.reverse(before), last["text"], lambda v, x: _choice(_all(x["guards"]), x["text"], v))
        return F.when(bad, F.lit(None).cast("string")).when(same, last["text"]).when(free(last) & ~F.exists(before, free), folded)

    return F.when(F.size(rows) > 0, F.get(F.transform(F.array(rows), merged), 0))


def pointer_value(assignments: Column) -> Column:
    """What a pointer holds after its assignments in order: structs of text and guards.

    The last unconditional one is what conditional ones fall back to; two whose conditions
    are each other's complement need no fallback. Null without a value on some path.
    """
    rows = _listed(assignments, "array<struct<text:string,guards:array<string>>>")
    plain = F.filter(rows, lambda r: F.size(r["guards"]) == 0)
    guarded = F.transform(F.filter(rows, lambda r: F.size(r["guards"]) > 0), lambda r: F.struct(F.array_join(r["guards"], " && ").alias("g"), r["text"].alias("t")))
    start = F.struct(F.when(F.size(plain) > 0, F.try_element_at(plain, F.lit(-1))["text"]).alias("v"), F.expr("cast(array() AS array<int>)").alias("done"))
    places = F.when(F.size(guarded) > 0, F.sequence(F.lit(0), F.size(guarded) - 1)).otherwise(F.expr("cast(array() AS array<int>)"))

    def step(acc: Column, k: Column) -> Column:
        at = lambda j: F.get(guarded, j)
        twin = F.get(F.filter(places, lambda j: (j != k) & ~F.array_contains(acc["done"], j) & (at(j)["g"] == F.concat(F.lit("!("), at(k)["g"], F.lit(")")))), 0)
        paired = F.struct(F.concat(F.lit("(("), at(k)["g"], F.lit(") ? ("), at(k)["t"], F.lit(") : ("), at(twin)["t"], F.lit("))")).alias("v"), F.concat(acc["done"], F.array(k, twin)).alias("done"))
        alone = F.struct(F.concat(F.lit("(("), at(k)["g"], F.lit(") ? ("), at(k)["t"], F.lit(") : ("), acc["v"], F.lit("))")).alias("v"), F.concat(acc["done"], F.array(k)).alias("done"))
        return F.when(F.array_contains(acc["done"], k), acc).when(twin.isNotNull(), paired).when(acc["v"].isNotNull(), alone).otherwise(acc)

    return F.aggregate(places, start, step, lambda a: a["v"])


def updated_value(variable: Column, initial: Column, changes: Column) -> Column:
    """What is written back after changes in order: structs of op, text and guards.

    Unconditional changes come first; each group of changes under the same guards is a
    branch that starts from the initial value, the variable itself without one.
    """
    rows = _listed(changes, "array<struct<op:string,text:string,guards:array<string>>>")
    base = F.coalesce(F.nullif(initial, F.lit("")), variable)
    run = lambda cs, start: F.aggregate(cs, start, lambda v, c: mutated(v, c["op"], c["text"]))
    value = run(F.filter(rows, lambda c: F.size(c["guards"]) <= 0), base)
    groups = F.array_distinct(F.transform(F.filter(rows, lambda c: F.size(c["guards"]) > 0), lambda c: c["guards"]))
    return F.aggregate(F.reverse(groups), value, lambda v, g: F.concat(F.lit("(("), F.array_join(F.transform(g, lambda c: F.concat(F.lit("("), c, F.lit(")"))), " && "), F.lit(") ? ("), run(F.filter(rows, lambda c: c["guards"] == g), base), F.lit(") : ("), v, F.lit("))")))


def switched_value(initial: Column, selector: Column, branches: Column) -> Column:
    """What is written back after a switch: structs of labels and changes (op, text); no labels are the default, the last of which counts."""
    rows = _listed(branches, "array<struct<labels:array<string>,changes:array<struct<op:string,text:string>>>>")
    none = F.expr("cast(array() AS array<struct<op:string,text:string>>)")
    after = lambda cs: F.aggregate(F.coalesce(cs, none), initial, lambda v, c: mutated(v, c["op"], c["text"]))
    default = F.filter(rows, lambda b: F.size(b["labels"]) <= 0)
    start = F.when(F.size(default) > 0, after(F.try_element_at(default, F.lit(-1))["changes"])).otherwise(initial)
    test = lambda ls: F.array_join(F.transform(ls, lambda x: F.concat(F.lit("("), selector, F.lit(" == "), x, F.lit(")"))), " || ")
    return F.aggregate(F.reverse(F.filter(rows, lambda b: F.size(b["labels"]) > 0)), start, lambda v, b: F.concat(F.lit("(("), test(b["labels"]), F.lit(") ? ("), after(b["changes"]), F.lit(") : ("), v, F.lit("))")))
