"""Places in source texts: slices by byte, lines of byte offsets, calls and what they are assigned to.

Offsets count bytes of UTF-8, as front ends give them. A file's line index is the array of
the bytes at which its lines begin; the line of an offset is found in it by binary search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


def line_starts(text: Column) -> Column:
    """The byte offsets at which the lines of a text begin, ascending; lines end with a newline.

    Lengths are summed within blocks of lines and over the blocks, so that a file of n
    lines does not copy n growing arrays.
    """
    lengths = F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)

    def summed(lens: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.expr("cast(array() AS array<bigint>)").alias("out"))
        return F.aggregate(lens, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def indexed(lens: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int"))
        part = lambda k: F.slice(lens, k * _BLOCK + 1, F.lit(_BLOCK))
        totals = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0).cast("long"), lambda a, n: a + n))
        starts = summed(totals, F.lit(0).cast("long"))
        return F.flatten(F.zip_with(blocks, starts, lambda k, s: summed(part(k), s)))

    # lens is used many times; the array of one element computes it once
    return F.flatten(F.transform(F.array(lengths), indexed))


def upper_bound(values: Column, x: Column) -> Column:
    """How many elements of an ascending array are ``x`` or less, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(values, mid) <= x
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))
    return F.aggregate(turns, start, halved, lambda s: s["lo"])


def source_slices(files: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """``refs`` (key, begin, end: bytes, end exclusive) with ``slice``, ``line`` and ``column``, of ``files`` (key, text).

    Bytes that are no UTF-8, as where a slice cuts a character, become U+FFFD. Lines and
    columns count from 1, columns in bytes. A reference without its file, with a null, or
    with an end before its begin has an empty slice and no place.
    """
    index = files.select(key, F.col("text").cast("binary").alias("_bytes"), line_starts(F.col("text")).alias("_starts"))
    got = refs.join(index, key, "left")
    ok = F.coalesce((F.col("begin") >= 0) & (F.col("end") >= F.col("begin")) & F.col("_bytes").isNotNull(), F.lit(False))
    cut = F.make_valid_utf8(F.substring("_bytes", F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")).cast("string"))
    line = upper_bound(F.col("_starts"), F.col("begin"))
    placed = got.withColumn("slice", F.when(ok, cut).otherwise("")).withColumn("line", F.when(ok, line))
    return placed.withColumn("column", F.when(ok, F.col("begin") - F.get("_starts", F.col("line") - 1) + 1)).drop("_bytes", "_starts")


def numbered_lines(files: DataFrame, key: str) -> DataFrame:
    """(key, line, text, before): the lines of each file from 1, with the line before, empty for the first."""
    lines = F.split("text", "\n", -1)
    pairs = F.arrays_zip(lines.alias("text"), F.concat(F.array(F.lit("")), F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("before"))
    return files.where("text IS NOT NULL").select(key, F.posexplode(pairs).alias("_i", "l")).select(key, (F.col("_i") + 1).alias("line"), "l.text", "l.before")


#: The shapes of a line that assigns what a call returns.
_PLACE = r"[A-Za-z_]\w*(?:\s*(?:->|\.)\s*\w+)*"
_SAME_LINE = rf"^\s*({_PLACE})\s*=(?!=)"
_LINE_BEFORE = rf"^\s*({_PLACE})\s*=\s*$"
_DECLARED = r"^\s*(?:[A-Za-z_]\w*\s+)+(?:\*+\s*)?([A-Za-z_]\w*)\s*=(?!=)"


def assigned_to(text: Column, before: Column, callee: Column) -> Column:
    """What a line assigns the call of ``callee`` in it to: a variable or member, one that it declares, or what the line before leaves open; else null."""
    here = F.contains(text, callee) & (callee != "")
    bare = lambda pattern, line: F.nullif(F.replace(F.regexp_extract(line, pattern, 1), F.lit(" "), F.lit("")), F.lit(""))
    declared = F.nullif(F.regexp_extract(text, _DECLARED, 1), F.lit(""))
    return F.coalesce(F.when(here, F.coalesce(bare(_SAME_LINE, text), declared)), bare(_LINE_BEFORE, before))


def call_targets(files: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """``calls`` (key, line, callee) with ``assigned``: what the source assigns each call to. A line that the file does not have assigns nothing."""
    lines = numbered_lines(files, key).select(key, "line", F.col("text").alias("_t"), F.col("before").alias("_b"))
    return calls.join(lines, [key, "line"], "left").withColumn("assigned", assigned_to(F.col("_t"), F.col("_b"), F.col("callee"))).drop("_t", "_b")


def source_calls(files: DataFrame, key: str) -> DataFrame:
    """(key, line, column, callee, call_text, assigned): every name with an opening bracket after it in the lines of source texts.

    ``call_text`` is the line from the name on; words that open a statement are no calls.
    """
    found = F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(0))
    pieces = F.split("text", r"\b[A-Za-z_]\w*\s*\(", -1)
    # where a match begins: what is before it and the matches before it
    sums = F.aggregate(F.arrays_zip(pieces.alias("p"), found.alias("m")), F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<int>)").alias("out")), lambda a, x: F.struct((a["at"] + F.octet_length(x["p"]) + F.coalesce(F.octet_length(x["m"]), F.lit(0))).alias("at"), F.concat(a["out"], F.array(a["at"] + F.octet_length(x["p"]))).alias("out")), lambda a: a["out"])
    each = numbered_lines(files, key).withColumn("_m", found).where("size(_m) > 0").select(key, "line", "text", "before", F.posexplode("_m").alias("_i", "_f"), sums.alias("_at"))
    callee = F.regexp_extract("_f", r"^\w+", 0)
    each = each.select(key, "line", (F.get("_at", F.col("_i")) + 1).alias("column"), callee.alias("callee"), "text", "before").where(~F.col("callee").isin("if", "for", "while", "switch", "return", "sizeof"))
    call_text = F.make_valid_utf8(F.substring(F.col("text").cast("binary"), F.col("column"), F.octet_length("text")).cast("string"))
    return each.select(key, "line", "column", "callee", call_text.alias("call_text"), assigned_to(F.col("text"), F.col("before"), F.col("callee")).alias("assigned"))
