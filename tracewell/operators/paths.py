"""Whether the guards of a path can hold together, decided on bits and ranges.

Each distinct guard becomes alternatives, each a list of atoms: a variable under a mask,
compared with a constant. A path's guards are multiplied out, and for each way to meet
them what is said of one variable is put together by aggregates: the greatest lower and
least upper bound, the bits known to be one or zero, and the values that are excluded.
Numbers are unsigned with 64 bits. A way is contradictory if some variable has no value
left; it can be met if all its atoms were understood and each variable has a value that
is shown to fit. What is neither is unknown, so nothing is called infeasible wrongly.

Paths of equal guards are decided once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import cexpr
from tracewell.session import ship

TOP = (1 << 64) - 1
#: Ways to meet a path's guards that are looked at; beyond, the path is unknown.
MOST_WAYS = 256
_ATOM = "struct<name:string,mask:string,op:string,value:string>"
_FLIPPED = {"Eq": "Ne", "Ne": "Eq", "Lt": "Ge", "Ge": "Lt", "Gt": "Le", "Le": "Gt"}
_SWAPPED = {"Eq": "Eq", "Ne": "Ne", "Lt": "Gt", "Gt": "Lt", "Le": "Ge", "Ge": "Le"}


def _atom(tree: tuple, truth: bool) -> list[list[tuple]]:
    """Alternatives of lists of (name, mask, op, value): when a term without && and || is true, or false."""
    if tree[0] == "Const":
        return [[]] if (tree[1] != 0) == truth else []
    op, left, right = tree[1:] if tree[0] == "Bin" and tree[1] in _FLIPPED else ("Ne", tree, ("Const", 0))
    if left[0] == "Const":
        op, left, right = _SWAPPED[op], right, left
    op = op if truth else _FLIPPED[op]
    mask = TOP
    if left[0] == "Bin" and left[1] == "BitAnd":
        a, b = left[2:]
        if "Const" in (a[0], b[0]):
            left, mask = (b, a[1]) if a[0] == "Const" else (a, b[1])
    if left[0] != "Var" or right[0] != "Const" or (mask != TOP and op not in ("Eq", "Ne")):
        return [[(None, None, None, None)]]
    return [[(left[1], str(mask & TOP), op, str(right[1] & TOP))]]


def alternatives(tree: tuple, truth: bool = True) -> list[list[tuple]]:
    """The lists of atoms one of which holds exactly if the expression is true (or false); an atom of nulls is not understood."""
    if tree[0] == "Bin" and tree[1] in ("And", "Or"):
        a, b = alternatives(tree[2], truth), alternatives(tree[3], truth)
        if (tree[1] == "Or") == truth:
            return a + b
        return [x + y for x in a for y in b] if len(a) * len(b) <= MOST_WAYS else [[(None, None, None, None)]]
    if tree[0] == "Bin" and tree[1] in ("Eq", "Ne") and ("Const", 0) in tree[2:]:
        other = tree[3] if tree[2] == ("Const", 0) else tree[2]
        if other[0] == "Bin" and other[1] in ("And", "Or", *_FLIPPED):
            return alternatives(other, truth == (tree[1] == "Ne"))
    return _atom(tree, truth)


def _ways(guards: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in guards:
        yield batch.map(lambda g: [[dict(zip(("name", "mask", "op", "value"), a)) for a in way] for way in alternatives(cexpr.parse(g))])


def decided(paths: DataFrame, guards: str = "guards") -> DataFrame:
    """``paths`` (guards: an array of conditions) with ``status``: satisfiable, infeasible or unknown.

    A path without guards is satisfiable; null guards are not looked at.
    """
    ship(paths.sparkSession)
    sets = paths.withColumn("_set", F.array_sort(F.array_distinct(F.filter(F.coalesce(guards, F.expr("cast(array() AS array<string>)")), lambda g: g.isNotNull()))))
    distinct = sets.select("_set").distinct()
    texts = distinct.select(F.explode("_set").alias("_g")).distinct()
    ways = texts.select("_g", F.pandas_udf(_ways, f"array<array<{_ATOM}>>")("_g").alias("_w"))
    clauses = distinct.select("_set", F.explode("_set").alias("_g")).join(ways, "_g").groupBy("_set").agg(F.collect_list("_w").alias("_c"))
    empty = F.expr(f"array(cast(array() AS array<{_ATOM}>))")
    number = F.aggregate("_c", F.lit(1.0), lambda n, c: n * F.size(c))
    product = F.aggregate("_c", empty, lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(c, lambda b: F.concat(a, b)))))
    met = clauses.select("_set", (number > MOST_WAYS).alias("_many"), F.when(number <= MOST_WAYS, product).alias("_p"))
    way = met.where("NOT _many").select("_set", F.posexplode("_p").alias("_way", "_atoms"))
    atoms = way.select("_set", "_way", F.explode("_atoms").alias("a")).select("_set", "_way", "a.name", "a.op", *[F.col(f"a.{c}").cast("decimal(20,0)").alias(c) for c in ("mask", "value")])
    held = way.join(_contradictions(atoms), ["_set", "_way"], "left").select("_set", F.coalesce("_bad", F.lit(False)).alias("_bad"), F.coalesce("_good", F.lit(True)).alias("_good"))
    status = held.groupBy("_set").agg(F.bool_or(~F.col("_bad") & F.col("_good")).alias("_sat"), F.bool_and("_bad").alias("_no")).select("_set", F.when(F.col("_sat"), "satisfiable").when(F.col("_no"), "infeasible").otherwise("unknown").alias("_s"))
    known = met.join(status, "_set", "left").select("_set", F.when(F.col("_many"), "unknown").otherwise(F.coalesce("_s", F.lit("infeasible"))).alias("status"))
    return sets.join(known, "_set", "left").select(*paths.columns, F.coalesce("status", F.lit("satisfiable")).alias("status"))


def _contradictions(atoms: DataFrame) -> DataFrame:
    """(_set, _way, _bad, _good): whether some variable of a way has no value, and whether all have one for sure."""
    top = F.expr(f"cast('{TOP}' AS decimal(20,0))")
    v, m, op = F.col("value"), F.col("mask"), F.col("op")
    whole = m == top
    zero = F.expr("cast(0 AS decimal(20,0))")
    low = F.when(whole & op.isin("Eq", "Ge"), v).when(op == "Gt", v + 1).otherwise(zero)
    high = F.when(whole & op.isin("Eq", "Le"), v).when(op == "Lt", v - 1).otherwise(top)
    # 64-bit patterns as signed longs; decimals from 2^63 on are taken down by 2^64
    bits = lambda x: F.when(x > F.expr("cast('9223372036854775807' AS decimal(20,0))"), x - F.expr(f"cast('{TOP + 1}' AS decimal(20,0))")).otherwise(x).cast("long")
    one_bit = (F.bit_count(bits(m)) == 1) & (op == "Ne") & ~whole
    ones = F.when(op == "Eq", bits(v)).when(one_bit & (v == 0), bits(m)).otherwise(F.lit(0).cast("long"))
    zeros = F.when(op == "Eq", bits(m).bitwiseAND(F.bitwise_not(bits(v)))).when(one_bit & (v == m), bits(m)).otherwise(F.lit(0).cast("long"))
    # an equality whose value has bits outside the mask has no solution
    outside = (op == "Eq") & (bits(v).bitwiseAND(F.bitwise_not(bits(m))) != 0)
    vague = F.col("name").isNull() | (~whole & (op == "Ne") & ~(one_bit & v.isin(0) | (one_bit & (v == m))))
    per = atoms.groupBy("_set", "_way", "name").agg(
        F.max(F.when(F.col("name").isNotNull(), low)).alias("lo"), F.min(F.when(F.col("name").isNotNull(), high)).alias("hi"), F.bit_or(ones).alias("ones"), F.bit_or(zeros).alias("zeros"),
        F.collect_set(F.when((op == "Ne") & whole, v)).alias("ne"), F.bool_or(vague).alias("vague"), F.bool_or(F.coalesce(outside, F.lit(False))).alias("outside"),
    )
    number = lambda b: F.when(b < 0, b.cast("decimal(20,0)") + F.expr(f"cast('{TOP + 1}' AS decimal(20,0))")).otherwise(b.cast("decimal(20,0)"))
    least, most = number(F.col("ones")), number(F.bitwise_not(F.col("zeros")))
    free = (F.col("ones") == 0) & (F.col("zeros") == 0)
    inside = F.filter("ne", lambda x: (x >= F.col("lo")) & (x <= F.col("hi")))
    room = F.col("hi") - F.col("lo") + 1 - F.size(inside)
    fits = lambda x: (x >= F.col("lo")) & (x <= F.col("hi")) & ~F.array_contains("ne", x)
    bad = F.col("outside") | (F.col("lo") > F.col("hi")) | (F.col("ones").bitwiseAND(F.col("zeros")) != 0) | (least > F.col("hi")) | (most < F.col("lo")) | (free & (room <= 0)) | ((least == most) & ~fits(least))
    good = ~F.col("vague") & ~bad & F.when(free, room > 0).otherwise(fits(least) | fits(most))
    named = F.col("name").isNotNull()
    return per.groupBy("_set", "_way").agg(F.bool_or(named & F.coalesce(bad, F.lit(False))).alias("_bad"), F.bool_and(named & F.coalesce(good, F.lit(False))).alias("_good"))
