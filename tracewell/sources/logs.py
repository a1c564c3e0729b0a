"""Text sources: trace logs, score and metrics reports, build commands, older module listings.

A file is one row of the read, so it is the unit of parallelism; its lines are numbered
from 1. Patterns use Unicode classes. Null texts have no lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.traces import segments

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Fixed by the formats: lines of a trace that enter a function or access a register, a register's line of a listing, and the line of counts.
_FUNCTION = r"(?U)\[rhfn\]\s+([A-Za-z_]\w*)"
_ACCESS = r"(?U)\[rh\]\s+(R|W)\s+0x([0-9a-fA-F]+)"
_REGISTER = r"(?U)register\s+(\w+):\s*B\d+\s+at\s+base\s+\+\s+(0x[0-9a-fA-F]+)"
_METRICS = (
    r"driver metrics: (\d+) ops \| symbolic (\d+) fixed (\d+) computed (\d+) \| rmw (\d+) unknown_value (\d+) \| cond (\d+) loop (\d+) \| "
    r"pct_symbolic ([^ ]+) pct_non_top ([^ ]+) \| clang_diag (\d+) \| regs (\d+)"
)
#: Fixed by the report: the names of its counts, in the order they are printed.
METRICS = ("ops", "symbolic", "fixed", "computed", "rmw", "unknown_value", "conditions", "loops", "pct_symbolic", "pct_non_top", "clang_diagnostics", "registers")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text), a row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, text), a row per line."""
    split = F.posexplode(F.split(F.col(text), _BREAK)).alias("_i", "text")
    return files.select(key, split).select(key, (F.col("_i") + 1).alias("line_no"), "text")


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def hex_number(digits: Column) -> Column:
    """Hexadecimal digits, with or without 0x, as a bigint; null beyond 63 bits."""
    return F.conv(F.regexp_replace(digits, "^0[xX]", ""), 16, 10).try_cast("bigint")


def trace_events(lines: DataFrame, log: str, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """(log, line_no, seg_id, fn, kind, offset) of the lines that name a function or an access.

    A line with both is a function's. ``seg_id`` counts the functions so far: accesses
    before the first are in segment 0. Other lines, and null ones, are left out.
    """
    t = F.col(text)
    fn = _group(t, _FUNCTION, 1)
    kind = F.when(fn.isNull(), _group(t, _ACCESS, 1))
    got = lines.select(log, line_no, fn.alias("fn"), kind.alias("kind"), F.when(fn.isNull(), hex_number(_group(t, _ACCESS, 2))).alias("offset"))
    return segments(got.where("fn IS NOT NULL OR kind IS NOT NULL"), [log], [line_no], F.col("fn").isNotNull()).select(log, line_no, "seg_id", "fn", "kind", "offset")


def scores(lines: DataFrame, key: str) -> DataFrame:
    """(key, name, value, blockers): the ``name: value`` lines of a report, and its list of blockers.

    Values stay text. The last line of a name wins. Lines ``- x`` count as blockers after
    the line ``blockers:`` only; without any the list is empty.
    """
    t = F.trim(F.col("text"))
    marked = segments(lines.withColumn("text", t), [key], ["line_no"], t == "blockers:", "_b").withColumn("_block", (F.col("_b") > 0) & F.col("text").startswith("- "))
    at = F.instr("text", ":")
    named = (at > 0) & ~F.col("_block") & ~F.col("text").isin("generation_readiness:", "blockers:", "blockers: []")
    pair = F.struct("line_no", F.trim(F.substring("text", F.lit(1), at - 1)).alias("name"), F.trim(F.substring("text", at + 1, F.length("text"))).alias("value"))
    last = marked.where(named).select(key, pair.alias("p")).groupBy(key, F.col("p.name").alias("name")).agg(F.max_by("p.value", "p.line_no").alias("value"))
    blockers = marked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_block"), F.struct("line_no", "text")))), lambda s: F.substring(s["text"], F.lit(3), F.length(s["text"]))).alias("blockers"))
    return blockers.join(last, key, "left").select(key, "name", "value", "blockers")


def metrics(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per file with the counts in METRICS, taken from its first line; nulls if it has none."""
    first = F.get(F.split(F.col(text), _BREAK, 2), 0)
    cols = [_group(first, _METRICS, k + 1).try_cast("double" if n.startswith("pct_") else "int").alias(n) for k, n in enumerate(METRICS)]
    return files.select(key, *cols)


def build_command(text: Column) -> Column:
    """The command of a saved build file: what its first ``cmd_x := ...`` line says, up to a semicolon; else null."""
    found = _group(text, r"(?m)^(?:saved)?cmd_[^ ]+\s*:=\s*([^\n]+)$", 1)
    return F.trim(F.substring_index(F.trim(found), ";", 1))


def register_offsets(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, name, offset) of the ``register`` lines of a device listing; the last of a name wins."""
    each = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_REGISTER), F.lit(0))).alias("_i", "_r")
    got = files.select(key, each).select(key, "_i", _group(F.col("_r"), _REGISTER, 1).alias("name"), hex_number(_group(F.col("_r"), _REGISTER, 2)).alias("offset"))
    return got.groupBy(key, "name").agg(F.max_by("offset", "_i").alias("offset"))


def listed_modules(files: DataFrame, registers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, module, ops): accesses of each module of an older listing, in order, by offset.

    Comments go; lines without a known offset are left out, and so are modules left
    without any. A read-modify-write is a read and a write. The last module of a name wins.
    """
    module = r"(?Us)module\s+(\w+)\s*\{(.*?)\n  \}"
    symbolic = r"(?U)\b(R|W|RMW)\(B\d+,\s*.*?\.(\w+)\)"
    fixed = r"(?U)\b(R|W|RMW)\(B\d+,\s*.*?\[(0x[0-9a-fA-F]+)\]"
    found = files.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(module), F.lit(0))).alias("_m", "_t"))
    body = found.select(key, "_m", F.regexp_extract("_t", module, 1).alias("module"), F.posexplode(F.split(F.regexp_extract("_t", module, 2), _BREAK)).alias("_i", "_l"))
    clean = F.regexp_replace("_l", "--.*$", "")
    ops = body.select(
        key, "_m", "module", "_i", F.coalesce(_group(clean, symbolic, 1), _group(clean, fixed, 1)).alias("kind"), _group(clean, symbolic, 2).alias("name"),
        F.when(_group(clean, symbolic, 1).isNull(), hex_number(_group(clean, fixed, 2))).alias("at"),
    ).where("kind IS NOT NULL")
    placed = ops.join(registers.select(key, "name", "offset"), [key, "name"], "left").withColumn("offset", F.coalesce("at", "offset")).where("offset IS NOT NULL")
    one = lambda k: F.struct(F.lit(k).alias("kind"), F.col("offset"))
    each = placed.withColumn("_ops", F.when(F.col("kind") == "RMW", F.array(one("R"), one("W"))).otherwise(F.array(F.struct("kind", "offset"))))
    per = each.groupBy(key, "module", "_m").agg(F.array_sort(F.collect_list(F.struct("_i", "_ops"))).alias("_o"))
    return per.groupBy(key, "module").agg(F.max_by("_o", "_m").alias("_o")).select(key, "module", F.flatten(F.col("_o._ops")).alias("ops"))


def value_traces(lines: DataFrame, log: str, tag: str, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """(log, line_no, call_no, module, kind, name, offset, value) of what calls do between fences.

    Lines ``[tag-begin]`` and ``[tag-end]`` fence off what counts; ``[tag] module`` starts
    a call, numbered from 1 in each log, and what follows belongs to it up to the next
    call or the end fence. ``kind`` is R or W for ``[trace n] R 0x.. = 0x..``, ``result``
    for ``[tag-result] 0x..``, and ``output`` and ``state`` for ``name=0x..`` pairs after
    ``[tag-output]`` and ``[tag-state]``, one row per pair. A call without any such line has
    one row with a null kind. Values beyond 63 bits are their bit patterns.
    """
    t, q = F.col(text), re.escape(tag)
    flagged = lines.select(
        log, line_no, t.alias("_t"), F.when(F.contains(t, F.lit(f"[{tag}-begin]")), 1).when(F.contains(t, F.lit(f"[{tag}-end]")), 0).alias("_fence"),
        _group(t, rf"\[{q}\]\s+([A-Za-z_]\w*)", 1).alias("_module"),
    )
    so_far = Window.partitionBy(log).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    on = flagged.withColumn("_on", F.last("_fence", True).over(so_far) == 1).withColumn("_ends", F.sum(F.when(F.col("_fence") == 0, 1).otherwise(0)).over(so_far))
    starts = F.col("_on") & F.col("_fence").isNull() & F.col("_module").isNotNull()
    since = Window.partitionBy(log, "_ends").orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    called = on.withColumn("_start", F.coalesce(starts, F.lit(False))).withColumn("call_no", F.sum(F.col("_start").cast("bigint")).over(so_far))
    called = called.withColumn("module", F.last(F.when(F.col("_start"), F.col("_module")), True).over(since)).where(F.col("_on") & F.col("_fence").isNull() & F.col("module").isNotNull())
    line = F.col("_t")
    access, result = r"\[trace\s+\d+\]\s+(R|W)\s+0x([0-9a-fA-F]+)\s+=\s+0x([0-9a-fA-F]+)", rf"\[{q}-result\]\s+0x([0-9a-fA-F]+)"
    pair = r"([A-Za-z_]\w*)=0x([0-9a-fA-F]+)"
    bits = lambda x: F.conv(x, 16, -10).try_cast("bigint")

    def item(kind, name, offset, value):
        return F.struct(kind.alias("kind"), name.cast("string").alias("name"), offset.cast("bigint").alias("offset"), value.alias("value"))

    none = F.lit(None)
    found = F.regexp_extract_all(line, F.lit(pair), F.lit(0))
    after = lambda k: F.transform(found, lambda x: item(F.lit(k), F.regexp_extract(x, pair, 1), none, bits(F.regexp_extract(x, pair, 2))))
    items = (
        F.when(F.col("_start"), F.array(item(none.cast("string"), none, none, none.cast("bigint"))))
        .when(line.rlike(access), F.array(item(F.regexp_extract(line, access, 1), none, bits(F.regexp_extract(line, access, 2)), bits(F.regexp_extract(line, access, 3)))))
        .when(line.rlike(result), F.array(item(F.lit("result"), none, none, bits(F.regexp_extract(line, result, 1)))))
        .when(F.contains(line, F.lit(f"[{tag}-output]")), after("output")).when(F.contains(line, F.lit(f"[{tag}-state]")), after("state"))
    )
    rows = called.select(log, line_no, "call_no", "module", "_start", F.inline(items))
    alone = Window.partitionBy(log, "call_no")
    return rows.withColumn("_n", F.count("kind").over(alone)).where(F.col("kind").isNotNull() | (F.col("_n") == 0)).select(log, line_no, "call_no", "module", "kind", "name", "offset", "value")
