"""Source code as text tables: what lines are code, and which specialisations code has.

Whether a line begins in code, or inside a comment or string over several lines, depends
on all lines before it. Each line is a map from the state that it begins in to that it
ends in; maps are composed within blocks of lines and over the blocks, so a file of any
length is handled in bounded pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import staged

#: What opens and closes strings over several lines in Python, and comments in C.
PYTHON = ((('"""', '"""'), ("'''", "'''")), "#")
C = ((("/*", "*/"),), "//")
_STRINGS = r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?"""


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def _tokens(language) -> str:
    """A regex of what is no code in a line: strings, comments, and pieces that are open at its end."""
    spans, comment = language
    closed = [f"{_quoted(a)}.*?{_quoted(b)}" for a, b in spans]
    return "|".join(closed + [f"{_quoted(a)}.*$" for a, _ in spans] + [f"{_quoted(comment)}.*$", _STRINGS])


def _ends(text: Column, language) -> Column:
    """The state at the end of a piece of a line that begins in code: 0, or the number of the span that is open."""
    last = F.element_at(F.regexp_extract_all(text, F.lit(f"({_tokens(language)})"), F.lit(1)), -1)
    out = F.lit(0)
    for k, (a, b) in enumerate(language[0], 1):
        shut = F.endswith(last, F.lit(b)) & (F.length(last) >= len(a) + len(b))
        out = F.when(F.startswith(last, F.lit(a)) & ~shut, k).otherwise(out)
    return F.when(F.try_element_at(F.regexp_extract_all(text, F.lit(f"({_tokens(language)})"), F.lit(1)), F.lit(-1)).isNull(), 0).otherwise(out)


def _after(text: Column, close: str) -> Column:
    """What follows the first ``close`` in a text, or null."""
    at = F.instr(text, close)
    return F.when(at > 0, F.substring(text, at + len(close), F.length(text)))


def line_states(lines: DataFrame, key: str, language=PYTHON, block: int = 1024) -> DataFrame:
    """``lines`` (key, line, text) with ``state``: 0 if the line begins in code, else the number of the span that it begins in.

    Lines are numbered without gaps in each file; a null text counts as empty. Strings of
    one line end with it.
    """
    t = F.coalesce("text", F.lit(""))
    moves = [_ends(t, language)]
    for k, (_, b) in enumerate(language[0], 1):
        rest = _after(t, b)
        moves.append(F.when(rest.isNull(), k).otherwise(_ends(rest, language)))
    each = staged(lines.withColumns({"_m": F.array(*moves), "_b": F.expr(f"line div {block}")}), "lines")
    same = F.array(*[F.lit(k) for k in range(len(moves))])
    through = lambda first, then: F.transform(first, lambda s: F.get(then, s))
    start = F.struct(same.alias("now"), F.expr("cast(array() AS array<array<int>>)").alias("out"))
    fold = lambda maps: F.aggregate(maps, start, lambda a, m: F.struct(through(a["now"], m).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")))
    blocks = each.groupBy(key, "_b").agg(F.array_sort(F.collect_list(F.struct("line", "_m"))).alias("_l")).withColumn("_f", fold(F.col("_l._m")))
    # over the blocks of a file: one number each
    totals = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_b", F.col("_f.now").alias("m")))).alias("_t"))
    entered = F.aggregate("_t", F.struct(F.lit(0).alias("s"), F.expr("cast(array() AS array<int>)").alias("out")), lambda a, x: F.struct(F.get(x["m"], a["s"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])
    begins = totals.select(key, F.explode(F.arrays_zip(F.col("_t._b").alias("b"), entered.alias("s"))).alias("x")).select(key, F.col("x.b").alias("_b"), F.col("x.s").alias("_s"))
    # a row a block or line: none is sent whole to the driver, however small its files look
    states = blocks.join(begins.hint("merge"), [key, "_b"]).select(key, F.explode(F.arrays_zip(F.col("_l.line").alias("line"), F.col("_f.out").alias("m"))).alias("x"), "_s").select(key, F.col("x.line").alias("line"), F.get("x.m", F.col("_s")).alias("state"))
    return each.drop("_m", "_b").join(states.hint("merge"), [key, "line"])


def code_lines(lines: DataFrame, key: str, language=PYTHON) -> DataFrame:
    """(key, line, code): the lines without comments and without what belongs to a span from an earlier line; strings of one line stay."""
    at = line_states(lines, key, language)
    t = F.coalesce("text", F.lit(""))
    code = F.when(F.col("state") == 0, t)
    for k, (_, b) in enumerate(language[0], 1):
        code = code.when(F.col("state") == k, F.coalesce(_after(t, b), F.lit("")))
    bare = F.regexp_replace(code, f"({_STRINGS})|{_quoted(language[1])}.*$", "$1")
    return at.select(key, "line", bare.alias("code"))


#: Comparisons of code with one source or device, and the tables of layouts by callee.
EQUALITIES = {"source_basename_equals": r"os\.path\.basename\(source\)\s*==\s*['\"]([^'\"]+)['\"]", "device_name_equals": r"(?:device_spec\.name|\bdev)\s*==\s*['\"]([^'\"]+)['\"]"}
LAYOUTS = ("PRIVATE_MMIO_READ_LAYOUTS", "PRIVATE_MMIO_WRITE_LAYOUTS")


def specialization_inventory(lines: DataFrame, key: str, nesting: int = 6) -> DataFrame:
    """(category, value): the names with which code compares sources and devices, and the keys of its layout tables.

    Comments do not count. A table's keys are the strings before a colon at its top level;
    what is in brackets inside it, up to ``nesting`` deep, is not looked at.
    """
    code = staged(code_lines(lines, key), "code")
    out = None
    for category, pattern in EQUALITIES.items():
        found = code.select(F.lit(category).alias("category"), F.explode(F.regexp_extract_all("code", F.lit(pattern), F.lit(1))).alias("value"))
        out = found if out is None else out.unionByName(found)
    begin = rf"(?:{'|'.join(LAYOUTS)})\b[^={{}}]*=\s*\{{"
    whole = code.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "code")))["code"], "\n").alias("t")).where(F.col("t").rlike(begin))
    tables = whole.select(F.explode(F.slice(F.split("t", begin, -1), F.lit(2), F.lit(1 << 20))).alias("t"))
    flat = F.col("t")
    for _ in range(nesting):
        flat = F.regexp_replace(flat, r"\{[^{}\[\]()]*\}|\[[^{}\[\]()]*\]|\([^{}\[\]()]*\)", " ")
    keys = F.regexp_extract_all(F.substring_index(flat, "}", 1), F.lit(r"['\"]([^'\"]+)['\"]\s*:"), F.lit(1))
    return out.unionByName(tables.select(F.lit("private_mmio_layouts").alias("category"), F.explode(keys).alias("value"))).distinct()
