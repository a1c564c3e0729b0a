"""Sinks of reports: metrics and scores as text, binding blocks, JSON documents, macros of a paper's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    """A rounded number as the reports write it; None for null."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def metrics_text(drivers: DataFrame, modules: DataFrame, driver: str = "driver") -> DataFrame:
    """(driver, text): the line of each driver's counters, and a table of its modules of fixed width, in order of name."""
    cells = [F.format_string("%4d", F.col(c)) for c in ("total_ops", "symbolic", "fixed", "computed", "unknown_value", "cond", "loop")]
    row = F.concat_ws(" ", F.rpad("module", F.greatest(F.length("module"), F.lit(28)), F.lit(" ")), *cells, F.lpad(_number(F.col("pct_symbolic")), F.greatest(F.length(_number(F.col("pct_symbolic"))), F.lit(5)), F.lit(" ")))
    rows = modules.groupBy(driver).agg(F.array_sort(F.collect_list(F.struct("module", row.alias("t"))))["t"].alias("_rows"))
    head = F.concat(F.rpad(F.lit("module"), 28, " "), *[F.lit(" " + h.rjust(w)) for h, w in (("ops", 4), ("sym", 4), ("fix", 4), ("cmp", 4), ("unk", 4), ("cond", 4), ("loop", 4), ("%sym", 5))])
    first = F.concat(
        F.format_string("driver metrics: %d ops | symbolic %d fixed %d computed %d | rmw %d unknown_value %d | cond %d loop %d | pct_symbolic ", *[F.col(c) for c in ("total_ops", "symbolic", "fixed", "computed", "rmw", "unknown_value", "cond", "loop")]),
        _number(F.col("pct_symbolic")), F.lit(" pct_non_top "), _number(F.col("pct_non_top_value")), F.format_string(" | clang_diag %d | regs %d", F.col("clang_diag"), F.col("register_map")),
    )
    text = F.concat_ws("\n", first, F.lit(""), head, F.lit("-" * 78), F.array_join(F.coalesce("_rows", F.array().cast("array<string>")), "\n"))
    return drivers.join(rows, driver, "left").select(driver, text.alias("text"))


#: Fixed by the report: the names of its lines, and the columns they show.
SCORE_LINES = (
    ("ris_quality", "ris_quality"), ("function_spec_quality", "function_spec_quality"), ("device_spec_quality", "device_spec_quality"), ("facts_quality", "facts_quality"),
    ("backend_harness_ready", "harness_ready"), ("backend_bare_metal_ready", "bare_metal_ready"), ("backend_linux_ready", "linux_ready"), ("llm_synthesis_ready", "llm_synthesis_ready"),
)


def score_text(scores: DataFrame, key: str) -> DataFrame:
    """(key, text): the report of a score, which ``logs.scores`` reads back."""
    shown = [F.concat(F.lit(f"  {n}: "), F.when(F.col(c).cast("string") == "true", "True").when(F.col(c).cast("string") == "false", "False").otherwise(F.col(c).cast("string"))) for n, c in SCORE_LINES]
    listed = F.concat(F.lit("  blockers:\n"), F.array_join(F.transform("blockers", lambda b: F.concat(F.lit("    - "), b)), "\n"))
    return scores.select(key, F.concat_ws("\n", F.lit("generation_readiness:"), *shown, F.when(F.size("blockers") > 0, listed).otherwise(F.lit("  blockers: []"))).alias("text"))


#: Fixed by the block format: the line of each kind of binding, in the order in which kinds are written.
BINDING_LINES = (("include", "  include %s"), ("type", '  type %s -> "%s"'), ("callback", "  callback %s = %s"), ("export", '  export %s as "%s"'), ("state", '  map %s -> "%s"'), ("primitive", '  map %s -> "%s"'))


def binding_block(bindings: DataFrame, key: list[str]) -> DataFrame:
    """(key, text): the block of a backend's bindings, which ``listings.bindings`` reads back.

    ``bindings`` has backend, device, kind, name, target and ord.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, (k, _) in enumerate(BINDING_LINES)])
    line = F.coalesce(*[F.when(F.col("kind") == k, F.format_string(f, *([F.col("name")] if f.count("%s") == 1 else [F.col("name"), F.col("target")]))) for k, f in BINDING_LINES])
    got = bindings.withColumns({"_r": rank, "_l": line}).where("_l IS NOT NULL").groupBy(*key, "backend", "device").agg(F.array_sort(F.collect_list(F.struct("_r", "ord", "_l")))["_l"].alias("_t"))
    return got.select(*key, F.concat_ws("\n", F.format_string("backend %s for device %s {", "backend", "device"), F.array_join("_t", "\n"), F.lit("}")).alias("text"))


def json_documents(modules: DataFrame, driver: str, parts: list[str], order: list[str]) -> DataFrame:
    """(driver, text): one JSON document a driver with its modules, each with ``parts`` of its columns, in order; nulls are written."""
    got = modules.groupBy(driver).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*parts).alias("_m"))))["_m"].alias("modules"))
    return got.select(driver, F.to_json(F.struct(F.col(driver).cast("string").alias("driver"), F.lit(1).alias("version"), "modules"), {"ignoreNullFields": "false"}).alias("text"))


def paper_macros(totals: DataFrame) -> DataFrame:
    """(name, line) of a macro for each column of a one-row table of totals; percent signs are escaped."""
    pairs = F.array(*[F.struct(F.lit("".join(p.capitalize() for p in c.split("_"))).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("--")).alias("value")) for c in totals.columns])
    return totals.select(F.explode(pairs).alias("p")).select("p.name", F.concat(F.lit("\\newcommand{\\"), F.col("p.name"), F.lit("}{"), F.replace("p.value", F.lit("%"), F.lit("\\%")), F.lit("}")).alias("line"))


def typed_value(text: Column) -> Column:
    """struct(flag, number, text) of a value in a score report: a boolean, a number, or else a text."""
    number = text.try_cast("double")
    flag = F.when(text == "True", True).when(text == "False", False)
    return F.struct(flag.alias("flag"), F.when(flag.isNull(), number).alias("number"), F.when(flag.isNull() & number.isNull(), text).alias("text"))


def _section(head: str, lines, array) -> Column:
    """A heading and one line for each element, or null without elements."""
    return F.when(F.size(array) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(array, lines), "\n")))


def _join(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def device_text(devices: DataFrame, key: str) -> DataFrame:
    """(key, text): the listing of a device, which ``logs.register_offsets`` reads registers from.

    ``devices`` has name, class, source, state (name, type, bind), resources (name, type,
    required, bind), registers (name, width, base, offset), invariants and functions, the
    latter two as texts. Empty arrays and a null source leave out their lines.
    """
    bind = lambda x: F.when(x["bind"].isNotNull() & (x["bind"] != ""), F.concat(F.lit(" bind "), x["bind"])).otherwise("")
    state = F.when(F.size("state") > 0, F.concat(_section("  state {", lambda x: _join("    ", x["name"], ": ", x["type"], bind(x)), F.col("state")), F.lit("\n  }")))
    resources = F.when(F.size("resources") > 0, F.array_join(F.transform("resources", lambda x: _join("  resource ", x["name"], ": ", x["type"], " { required ", x["required"].cast("string"), bind(x), " }")), "\n"))
    registers = F.when(F.size("registers") > 0, F.array_join(F.transform("registers", lambda x: _join("  register ", x["name"], ": ", x["width"], " at ", x["base"], " + 0x", F.lower(F.hex(x["offset"])))), "\n"))
    invariants = F.when(F.size("invariants") > 0, F.array_join(F.transform("invariants", lambda x: _join("  invariant ", x)), "\n"))
    functions = F.when(F.size("functions") > 0, F.array_join("functions", "\n"))
    source = F.when(F.coalesce("source", F.lit("")) != "", _join('  source "', F.col("source"), '"'))
    return devices.select(key, F.concat_ws("\n", _join("device ", F.col("name"), " {"), _join("  class ", F.col("class")), source, state, resources, registers, invariants, functions, F.lit("}")).alias("text"))


def facts_text(facts: DataFrame, key: str) -> DataFrame:
    """(key, text): the report of a source's facts.

    ``facts`` has source, includes, structs (name, fields (name, ctype)), constants (name,
    value), callbacks (name, function), resources (name, acquisition, binds_to),
    error_paths, helper_calls and snippets (name, calls), arrays in the order in which they
    are shown. Empty ones leave out their section; negative constants keep their sign.
    """
    number = lambda v: F.when(v < 0, F.concat(F.lit("-0x"), F.lower(F.hex(-v)))).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(v))))
    item = lambda x: _join("  - ", x)
    quoted = lambda x: _join('  - "', x, '"')
    field = lambda f: _join("      ", f["name"], ': "', f["ctype"], '"')
    struct = lambda x: F.concat_ws("\n", _join("  ", x["name"], ":"), F.lit("    fields:"), F.when(F.size(x["fields"]) > 0, F.array_join(F.transform(x["fields"], field), "\n")))
    resource = lambda x: F.concat_ws("\n", _join("  ", x["name"], ":"), _join('    acquisition: "', x["acquisition"], '"'), F.when(F.coalesce(x["binds_to"], F.lit("")) != "", _join('    binds_to: "', x["binds_to"], '"')))
    snippet = lambda x: F.concat_ws("\n", _join("  ", x["name"], ":"), F.when(F.size(x["calls"]) > 0, F.array_join(F.transform(x["calls"], lambda c: _join('    - "', c, '"')), "\n")))
    return facts.select(key, F.concat_ws(
        "\n", _join("source: ", F.col("source")), _section("includes:", item, F.col("includes")), _section("structs:", struct, F.col("structs")), _section("constants:", lambda x: _join("  ", x["name"], ": ", number(x["value"])), F.col("constants")),
        _section("callbacks:", lambda x: _join("  ", x["name"], ": ", x["function"]), F.col("callbacks")), _section("resources:", resource, F.col("resources")), _section("error_paths:", quoted, F.col("error_paths")), _section("helper_calls:", quoted, F.col("helper_calls")),
        _section("source_snippets:", snippet, F.col("snippets")),
    ).alias("text"))
