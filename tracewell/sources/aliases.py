"""Reports of an alias analysis: its symbol table, its pairs, and what is aliased to known origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the reports: a symbol's line, a variable with its scope, and a pair's line.
SYMBOL = r"^(\d+)\s+(.*)"
VARIABLE = r"^var(\d+)\[([^\]]*)\]"
PAIR = r"^(MayAlias|NoAlias|PartialAlias|MustAlias)\s+(\S+)\s+--\s+(\S+)"


def symbols(lines: DataFrame, key: str, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """(key, var, function, line, file, code) of the symbol lines; the last of a variable wins.

    The function is what follows the last @ of the scope, or the whole scope; without a
    scope, and without a place in the source, these are empty and 0.
    """
    t = F.trim(F.col(text))
    code = F.regexp_extract(t, SYMBOL, 2)
    place = F.struct(
        F.substring_index(F.regexp_extract(code, VARIABLE, 2), "@", -1).alias("function"),
        F.coalesce(F.regexp_extract(code, r'"ln":\s*(\d+)', 1).try_cast("int"), F.lit(0)).alias("line"),
        F.regexp_extract(code, r'"fl":\s*"([^"]+)"', 1).alias("file"), code.alias("code"),
    )
    found = lines.where(t.rlike(SYMBOL)).select(key, F.regexp_extract(t, SYMBOL, 1).cast("bigint").alias("var"), F.col(line_no).alias("_n"), place.alias("_p"))
    return found.groupBy(key, "var").agg(F.max_by("_p", "_n").alias("_p")).select(key, "var", "_p.*")


def pairs(lines: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, left_var, right_var) of the pair lines whose sides are both variables."""
    t = F.trim(F.col(text))
    var = lambda k: F.regexp_extract(F.regexp_extract(t, PAIR, k), VARIABLE, 1).try_cast("bigint")
    return lines.where(t.rlike(PAIR)).select(key, F.regexp_extract(t, PAIR, 1).alias("kind"), var(2).alias("left_var"), var(3).alias("right_var")).where("left_var IS NOT NULL AND right_var IS NOT NULL")


def aliased(pairs: DataFrame, origins: DataFrame, key: str, kind: str = "MayAlias") -> DataFrame:
    """(key, alias_var, origin_var) of the pairs of a kind with exactly one side among ``origins`` (key, var).

    Each pair is seen from both sides, so two equi-joins find it whichever side is known;
    repeated pairs give one row.
    """
    known = origins.select(key, F.col("var").alias("origin_var")).distinct()
    both = pairs.where(F.col("kind") == kind)
    sides = both.select(key, F.col("left_var").alias("origin_var"), F.col("right_var").alias("alias_var")).unionByName(both.select(key, F.col("right_var").alias("origin_var"), F.col("left_var").alias("alias_var")))
    other = known.withColumnRenamed("origin_var", "alias_var")
    return sides.join(known, [key, "origin_var"], "left_semi").join(other, [key, "alias_var"], "left_anti").select(key, "alias_var", "origin_var").distinct()


def linked_names(found: DataFrame, symbols: DataFrame, units: DataFrame, lvalues: DataFrame, key: str) -> DataFrame:
    """(key, alias_var, origin_var, source, line, name, type) of the aliases of a program linked from several units.

    ``found`` is what ``aliased`` returns, ``symbols`` their table, ``units`` (key, source)
    the paths that were linked, and ``lvalues`` (key, source, line, name, type) what their
    lines assign, the least name where a line assigns several. A symbol's file is the unit
    with that path or file name if there is just one; otherwise, or if that line assigns
    nothing there, the only unit whose line of that number assigns something. Symbols
    without a line, or with several such units, have no name and are left out.
    """
    base = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    at = found.join(symbols.select(key, F.col("var").alias("alias_var"), "line", "file"), [key, "alias_var"]).where("line > 0")
    names = units.select(key, "source", F.explode(F.array_distinct(F.array(F.col("source"), base(F.col("source"))))).alias("_n")).distinct()
    spelled = at.where("file <> ''").select(key, "alias_var", F.explode(F.array_distinct(F.array(F.col("file"), base(F.col("file"))))).alias("_n")).distinct()
    sources = spelled.join(names, [key, "_n"]).groupBy(key, "alias_var").agg(F.min("source").alias("_s"), F.max("source").alias("_z")).where("_s = _z").drop("_z")
    assigned = lvalues.join(units.select(key, "source").distinct(), [key, "source"], "left_semi").groupBy(key, "source", "line").agg(F.min(F.struct("name", "type")).alias("_v"))
    only = assigned.groupBy(key, "line").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("source", "_v")).alias("_o")).where("_c = 1").drop("_c")
    told = at.join(sources, [key, "alias_var"], "left").join(assigned.withColumnRenamed("source", "_s"), [key, "_s", "line"], "left").join(only, [key, "line"], "left")
    by = F.when(F.col("_v").isNotNull(), F.struct(F.col("_s").alias("source"), F.col("_v"))).otherwise(F.col("_o"))
    return told.withColumn("_by", by).where("_by IS NOT NULL").select(key, "alias_var", "origin_var", "_by.source", "line", "_by._v.name", "_by._v.type")
