"""Callback programs of gpio banks from their configuration, and the differential of these against the bank's own driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.batches import batched
from tracewell.operators.devices import bank_run
from tracewell.operators.interpreter import Run, Unsupported, seeded, steps

_DATA, _DIRECTION = "gpio_sdata", "gpio_sdir"


def _var(name: str) -> dict:
    return {"Var": name}


def _do(op: str, left: dict, right: dict) -> dict:
    return {"BinOp": {"op": op, "left": left, "right": right}}


class Programs:
    """The callbacks of one configuration as op trees; ``made`` maps each callback, and ``init``, to its ops."""

    def __init__(self, offsets: dict[str, int], width: int, flags: set[str]):
        self.at, self.width, self.flags = offsets, width, flags
        self.ones = {"Const": (1 << 8 * width) - 1}
        line = _do("Shl", {"Const": 1}, _var("offset"))
        paired = "set" in offsets and "clr" in offsets
        turns = [f for f in ("dirin", "dirout") if f in offsets]
        done = {"Return": {"value": {"Const": 0}}}
        one = self.pair(_var("value"), line, line) if paired else self.shadow(_DATA, self.merged("__data", line, _do("Mul", line, _do("Ne", _var("value"), {"Const": 0}))), [("set" if "set" in offsets else "dat", False)])
        wanted, rest = _do("BitAnd", _var("bits"), _var("mask")), _do("BitAnd", self.inverted(_var("bits")), _var("mask"))
        many = self.either(wanted, rest) if paired else self.shadow(_DATA, self.merged("__data", _var("mask"), wanted), [("set" if "set" in offsets else "dat", False)])
        levels = self.read("set" if "read_output_set" in flags else "dat", "value")
        self.made = {
            "init": self.start(paired),
            "get": [levels, {"Return": {"value": _do("Ne", _do("BitAnd", _var("value"), line), {"Const": 0})}}],
            "get_multiple": [levels, {"OutputWrite": {"target": "bits", "value": self.merged("bits", _var("mask"), _do("BitAnd", _var("value"), _var("mask")))}}, done],
            "set": [*one, done],
            "set_multiple": [*many, done],
        }
        if turns:
            to = [(f, f == "dirin") for f in turns]
            into, out = (self.shadow(_DIRECTION, self.merged("__direction", line, bits), to) for bits in ({"Const": 0}, line))
            self.made |= {
                "direction_input": [*into, done],
                "direction_output": [*out, *one, done] if "no_set_on_input" in flags else [*one, *out, done],
                "get_direction": self.asked(line),
            }

    def inverted(self, x: dict) -> dict:
        return _do("BitXor", x, self.ones)

    def merged(self, old: str, mask: dict, bits: dict) -> dict:
        return _do("BitOr", _do("BitAnd", _var(old), _do("BitXor", mask, {"Const": (1 << 64) - 1})), bits)

    def place(self, field: str) -> dict:
        order = {"evidence": {"byte_order": "big"}} if "big_endian" in self.flags else {}
        return {"addr": {"Fixed": {"base": "", "offset": self.at[field]}}, "width": f"B{self.width}", **order}

    def read(self, field: str, var: str) -> dict:
        return {"Read": {**self.place(field), "var": var}}

    def write(self, field: str, value: dict) -> dict:
        return {"Write": {**self.place(field), "value": value}}

    def keep(self, field: str, value: dict) -> dict:
        return {"StateWrite": {"field": field, "width": f"B{self.width}", "value": value}}

    def start(self, paired: bool) -> list[dict]:
        word = "set" if "set" in self.at and not paired and "unreadable_set" not in self.flags else "dat"
        ops = [self.read(word, "__first"), self.keep(_DATA, _var("__first"))]
        field = next((f for f in ("dirout", "dirin") if f in self.at and "unreadable_dir" not in self.flags), None)
        if field:
            ops += [self.read(field, "__first"), self.keep(_DIRECTION, self.inverted(_var("__first")) if field == "dirin" else _var("__first"))]
        return ops

    def shadow(self, state: str, value: dict, to: list[tuple[str, bool]]) -> list[dict]:
        """A shadow word changed and written to registers, inverted where the register means the opposite."""
        var = "__data" if state == _DATA else "__direction"
        now = _var(state)
        return [{"StateRead": {"field": state, "var": var}}, self.keep(state, value), *[self.write(f, self.inverted(now) if opposite else now) for f, opposite in to]]

    def pair(self, guard: dict, high: dict, low: dict) -> list[dict]:
        return [{"Cond": {"guard": guard, "then_ops": [self.write("set", high)], "else_ops": [self.write("clr", low)]}}]

    def either(self, high: dict, low: dict) -> list[dict]:
        return [{"Cond": {"guard": _do("BitAnd", x, self.ones), "then_ops": [self.write(f, x)]}} for f, x in (("set", high), ("clr", low))]

    def asked(self, line: dict) -> list[dict]:
        is_set = lambda name: _do("Ne", _do("BitAnd", _var(name), line), {"Const": 0})
        if "unreadable_dir" in self.flags:
            return [{"StateRead": {"field": _DIRECTION, "var": "__direction"}}, {"Return": {"value": _do("Eq", is_set("__direction"), {"Const": 0})}}]
        if "dirout" in self.at:
            return [self.read("dirout", "__direction"), {"Return": {"value": _do("Eq", is_set("__direction"), {"Const": 0})}}]
        return [self.read("dirin", "__direction"), {"Return": {"value": is_set("__direction")}}]


def callback_programs(cases: DataFrame, key: list[str], offsets: str, width: str, flags: str) -> DataFrame:
    """(key, callback, program): the op trees, as JSON, of the seven callbacks and the set-up (``init``) of each bank.

    A bank without direction registers has no direction callbacks; one without dat has no rows.
    """

    def made(o, w, f):
        at = dict(o or [])
        return [(k, json.dumps(v)) for k, v in Programs(at, w, set(f or [])).made.items()] if "dat" in at else []

    rows = batched(made, "array<struct<callback:string,program:string>>")(*map(F.col, (offsets, width, flags)))
    return cases.select(*key, F.explode(rows).alias("_r")).select(*key, "_r.*")


class Placed(Programs):
    """The same with the fields' places left to the bases of a run, so that banks which differ in these alone share them."""

    def place(self, field: str) -> dict:
        return {**super().place(field), "addr": {"Fixed": {"base": field, "offset": 0}}}


@lru_cache(4096)
def _made(fields: tuple[str, ...], width: int, flags: frozenset[str]) -> dict[str, Callable[[Run], tuple[int] | None]]:
    return {k: steps(ops) for k, ops in Placed(dict.fromkeys(fields, 0), width, set(flags)).made.items()}


def program_run(offsets, width, flags, plan, size: int) -> tuple | None:
    """A row of CALLS as the callbacks' programs give it; null without a plan."""
    if plan is None:
        return None
    try:
        at = dict(offsets or [])
        programs = _made(tuple(at), width, frozenset(flags or []))
        device = Run({}, {}, seeded(size), at)
        programs["init"](device)
        shadows = lambda: (device.state.get(_DATA, 0), device.state.get(_DIRECTION, 0))
        start, calls = shadows(), []
        for step in plan:
            args = {k: v for k, v in step["args"] if v is not None}
            device.env, device.trace, device.outputs = dict(args), [], {}
            end = programs[step["table"].removeprefix("gpio_chip.")](device)
            calls.append((step["table"], device.trace, None if end is None else end[0], device.outputs.get("bits", args.get("bits")), *shadows()))
        return (*start, calls, None)
    except (KeyError, Unsupported, TypeError, ValueError) as e:
        return (None, None, [], f"{type(e).__name__}: {e}")


def bank_differential(cases: DataFrame, offsets: str, width: str, flags: str, program_flags: str, plan: str, memory_bytes: int = 4096) -> DataFrame:
    """``cases`` with ``calls``, ``first_difference`` and ``passed``: the programs' runs against those of the bank's own driver.

    ``program_flags`` are the flags that the programs were made with. The first difference
    is ``error``, ``initial state``, or the callback at which trace, result, output or
    shadows differ; null if none. A null plan does not pass. Nothing is shuffled.
    """
    args = list(map(F.col, (offsets, width, flags, program_flags, plan)))
    got = batched(lambda o, w, f, m, p: compared(bank_run(o, w, f, p, memory_bytes), program_run(o, w, m, p, memory_bytes)), "struct<calls:int,first:string>")(*args)
    out = cases.withColumn("_d", got).withColumn("calls", F.coalesce("_d.calls", F.lit(0))).withColumn("first_difference", F.col("_d.first"))
    return out.withColumn("passed", F.col("_d").isNotNull() & F.col("first_difference").isNull()).drop("_d")


def compared(source: tuple | None, formal: tuple | None) -> tuple[int, str | None] | None:
    """(calls, first difference) of two rows of CALLS; null without a plan."""
    if source is None or formal is None:
        return None
    n = len(source[2])
    if source[3] is not None or formal[3] is not None:
        return n, "error"
    if source[:2] != formal[:2]:
        return n, "initial state"
    return n, next((s[0] for s, f in zip(source[2], formal[2]) if s != f), None)


def _quoted(name: str) -> str:
    """SQL of a regular expression that matches a column's text as it is."""
    return f"'\\\\Q', {name}, '\\\\E'"


def direction_variants(fields: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """(key, source_variable, source_expr, source_condition) of banks whose one direction register is inverted for one case.

    ``fields`` has (key, field, expr, condition, switch, branch), ``sources`` (key, text).
    dirin and dirout each have one entry, of the same register, in the case and the default
    of one switch; the switched variable is last assigned the number of a firmware alias,
    names within it resolved to what they were last assigned.
    """
    row = F.struct(F.trim("expr").alias("expr"), F.trim("switch").alias("switch"), "branch", "condition")
    pick = lambda f: (F.count_if(F.col("field") == f).alias(f"_n_{f}"), F.max(F.when(F.col("field") == f, row)).alias(f"_{f}"))
    per = fields.where(F.col("field").isin("dirin", "dirout")).groupBy(*key).agg(*pick("dirin"), *pick("dirout"))
    per = per.where("_n_dirin = 1 AND _n_dirout = 1 AND _dirin.expr = _dirout.expr AND _dirin.switch = _dirout.switch AND _dirin.switch <> ''")
    per = per.where("array_sort(array(_dirin.branch, _dirout.branch)) = array('case', 'default')")
    per = per.select(*key, F.col("_dirin.switch").alias("source_variable"), F.col("_dirin.condition").alias("_c")).join(sources.select(*key, "text"), key)
    last = lambda name, value: f"element_at(regexp_extract_all(text, concat('(?s)(?<![A-Za-z0-9_])', {_quoted(name)}, '\\\\s*=\\\\s*({value})\\\\s*;'), 1), -1)"
    per = per.withColumn("_e", F.expr(f"try_{last('source_variable', '.+?')}")).where("_e IS NOT NULL")
    resolved = f"""aggregate(array_sort(array_distinct(regexp_extract_all(_e, '([A-Za-z_]\\\\w*)', 1))), _e, (e, n) ->
        if(n = source_variable, e, coalesce(regexp_replace(e, concat('(?<![A-Za-z0-9_])', {_quoted('n')}, '(?![A-Za-z0-9_])'), concat('(', try_{last('n', '[^;]+?')}, ')')), e)))"""
    per = per.withColumn("source_expr", F.expr(resolved)).withColumn("_v", F.regexp_extract("_c", r"(?:==|!=)\s*\(?\s*([0-9]+)\s*\)?", 1))
    per = per.where(F.col("source_expr").rlike(r'^of_alias_get_id\s*\(\s*\(?\s*pdev->dev\.of_node\s*\)?\s*,\s*"[A-Za-z0-9_-]+"\s*\)$') & (F.col("_v") != ""))
    return per.select(*key, "source_variable", "source_expr", F.concat(F.lit("("), "source_expr", F.lit(") == "), F.col("_v").cast("bigint").cast("string")).alias("source_condition"))


def bank_models(fields: DataFrame, sources: DataFrame, macros: DataFrame, key: list[str]) -> DataFrame:
    """(key, selector, base, resource_index, max_count, property, irq_selector) of configurations that choose among banks.

    ``fields`` has (key, field, base, resource_index, expr): computed places relative to a
    mapped base. At least two of dat, set and dirout are there, each once and at one base,
    and exactly one member is in all their places: the selector, which the source must keep
    in the chip's own object. ``macros`` has (key, name, value); a bound over 256 is none.
    """
    member = r"([A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*)+)"
    members = F.filter(F.array_distinct(F.regexp_extract_all("expr", F.lit(member), F.lit(1))), lambda m: ~m.eqNullSafe(F.col("base")))
    of = fields.where(F.col("field").isin("dat", "set", "dirout")).select(*key, "field", "base", "resource_index", members.alias("_m"))
    per = of.groupBy(*key, "field").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("base", "resource_index")).alias("_b"), F.first("_m").alias("_m"))
    whole = per.groupBy(*key).agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"), F.min("_b").alias("_lo"), F.max("_b").alias("_b"), F.count("_b.resource_index").alias("_r"), F.collect_list("_m").alias("_ms"))
    shared = F.aggregate("_ms", F.get("_ms", F.lit(0)), lambda a, m: F.array_intersect(a, m))
    one = whole.where("_k >= 2 AND _n = 1 AND _r = _k AND _lo = _b").withColumn("_s", shared).where("size(_s) = 1").select(*key, F.get("_s", F.lit(0)).alias("selector"), "_b.base", "_b.resource_index")
    j = one.join(sources.select(*key, "text"), key).where(F.expr(f"text RLIKE concat('[A-Za-z_]\\\\w*\\\\s*->\\\\s*[A-Za-z_]\\\\w*\\\\s*=\\\\s*', {_quoted('selector')}, '\\\\s*;')"))
    number = r"(0[xX][0-9a-fA-F]+|\\d+)"
    got = lambda before, after: F.nullif(F.expr(f"regexp_extract(text, concat('{before}', {_quoted('selector')}, '{after}'), 1)"), F.lit(""))
    value = lambda t: F.when(t.rlike("^0[xX]"), F.conv(F.substring(t, 3, 16), 16, 10).cast("bigint")).otherwise(t.try_cast("bigint"))
    j = j.withColumn("_limit", got("", r"\\s*>=\\s*([A-Za-z_]\\w*|0[xX][0-9a-fA-F]+|\\d+)"))
    known = macros.groupBy(*key, F.col("name").alias("_limit")).agg(F.max("value").alias("_value"))
    bound = F.coalesce(value(F.col("_limit")), "_value")
    return j.join(known, [*key, "_limit"], "left").select(
        *key, "selector", "base", "resource_index", F.when((bound > 0) & (bound <= 256), bound).alias("max_count"),
        got(r"fwnode_property_read_u32\\s*\\([^,]+,\\s*\"([^\"]+)\"\\s*,\\s*&\\s*", r"\\s*\\)").alias("property"),
        value(got(r"if\\s*\\(\\s*", rf"\\s*==\\s*{number}\\s*\\)\\s*[A-Za-z_]\\w*irq[A-Za-z_]*\\s*\\(")).alias("irq_selector"),
    )


def applied_bank_models(ops: DataFrame, models: DataFrame, key: list[str]) -> DataFrame:
    """``ops`` (key, base, expr: a computed address) with the bank's selector in it replaced by the state that holds it.

    ``models`` has (key, selector, base, state_field), one row a key. Addresses from another
    base stay; those from the model's are then from ``base``, the mapped base of any bank.
    The selector is replaced where it stands alone, not inside a longer name.
    """
    m = models.select(*key, F.col("selector").alias("_sel"), F.col("base").alias("_base"), F.col("state_field").alias("_state"))
    inside = F.coalesce(F.col("base") == F.col("_base"), F.lit(False))
    put = F.expr(f"regexp_replace(expr, concat('(?<![A-Za-z0-9_])', {_quoted('_sel')}, '(?![A-Za-z0-9_])'), _state)")
    got = ops.join(m, key, "left").withColumns({"expr": F.when(inside, put).otherwise(F.col("expr")), "_b": F.when(inside, "base").otherwise(F.col("base"))})
    return got.drop("base", "_sel", "_base", "_state").withColumnRenamed("_b", "base").select(*ops.columns)
