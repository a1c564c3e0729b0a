"""Ordered traces: segments, greedy matching, alignment of calls to segments, best variants.

A trace is a table of rows with a group (log, user), an order and an item. Order comes
from columns, never from the position of rows; ties need a column that breaks them.
Everything of one group is handled in one window or one fold, so a group is the unit
of parallelism; groups are dealt by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, group: list[str], order: list[str], is_marker: Column, name: str = "seg_id") -> DataFrame:
    """Add the number of the segment a row belongs to: the count of markers up to it.

    Rows before the first marker of their group are in segment 0. Null markers do not count.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(is_marker.cast("int"), F.lit(0))).over(w))


def ordered_items(df: DataFrame, group: list[str], order: list[str], item: str, name: str = "items") -> DataFrame:
    """One row per group with its items in order, as an array."""
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))).alias("_o")).select(*group, F.col("_o._item").alias(name))


def greedy_prefix(actual: Column, pattern: Column) -> Column:
    """How many leading items of ``pattern`` occur in ``actual`` in order, taken greedily.

    Once an item of the pattern is not found, all later ones are missing as well.
    Items compare null-safely.
    """
    return F.aggregate(actual, F.lit(0), lambda i, x: F.when((i < F.size(pattern)) & F.get(pattern, i).eqNullSafe(x), i + 1).otherwise(i))


def subsequence_match(df: DataFrame, actual: str, pattern: Column) -> DataFrame:
    """Add ``matched``, ``missing`` and ``complete`` of each row's array against a pattern."""
    df = df.withColumn("matched", greedy_prefix(F.col(actual), pattern))
    return df.withColumn("missing", F.slice(pattern, F.col("matched") + 1, F.size(pattern))).withColumn("complete", F.col("matched") == F.size(pattern))


def align_calls(calls: Column, names: Column) -> Column:
    """For each call in order the 1-based place of the segment it takes, or null.

    A call takes the next unused segment of exactly its name; the first call that finds
    none leaves nothing for those after it.
    """
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, call):
        rest = F.slice(names, acc["at"] + 1, F.size(names))
        place = F.array_position(rest, call).cast("int")
        hit = (acc["at"] >= 0) & (place > 0)
        at = F.when(hit, acc["at"] + place).otherwise(F.lit(-1))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.when(hit, at))).alias("out"))

    # once exhausted the cursor is -1; slice() needs a start of 1 or more
    def guarded(acc, call):
        safe = F.struct(F.greatest(acc["at"], F.lit(0)).alias("at"), acc["out"].alias("out"))
        moved = step(safe, call)
        gone = acc["at"] < 0
        return F.struct(F.when(gone, F.lit(-1)).otherwise(moved["at"]).alias("at"), F.when(gone, F.concat(acc["out"], F.array(F.lit(None).cast("int")))).otherwise(moved["out"]).alias("out"))

    return F.aggregate(calls, start, guarded, lambda acc: acc["out"])


def best_variant(df: DataFrame, call: list[str], complete: str, matched: str, missing: str, variant: str) -> DataFrame:
    """One row per call: complete first, then most matched, then fewest missing, then the first variant."""
    w = Window.partitionBy(*call).orderBy(F.col(complete).desc(), F.col(matched).desc(), F.col(missing), F.col(variant))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coverage(df: DataFrame, matched: str, expected: Column, item_key: str, by: list[str]) -> DataFrame:
    """Coverage of calls per ``by``: complete calls, matched and expected items, keys of complete calls only."""
    ok = F.col(matched) == expected
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(ok).alias("complete_calls"),
        F.sum(matched).alias("matched_items"),
        F.sum(expected).alias("expected_items"),
        F.countDistinct(F.when(ok, F.col(item_key))).alias("credited"),
    )


def islands(df: DataFrame, group: list[str], order: list[str], frame: Column) -> DataFrame:
    """Add ``island``: the number of the maximal run of equal frames that a row is in."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_f", frame).withColumn("_new", (~F.col("_f").eqNullSafe(F.lag("_f").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f", "_new")


def last_value_before(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the last non-null ``value`` of the rows strictly before each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "op_no") -> DataFrame:
    """Number rows in order within their group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def _shared(a: Column, b: Column) -> Column:
    """How many leading elements two arrays have in common, null-safely."""
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    step = lambda acc, e: F.struct((acc["on"] & e).alias("on"), (acc["n"] + F.when(acc["on"] & e, 1).otherwise(0)).alias("n"))
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y)), start, step, lambda acc: acc["n"])


def nested(df: DataFrame, group: list[str], order: list[str], stack: str) -> DataFrame:
    """Add ``row_no`` and ``inside``: for each frame of a row's stack the row that opened it.

    Rows in a run that share a frame at a depth, and all frames above it, are in one node;
    the node goes by the number of its first row and its depth. The depth of the deepest
    stack is looked up first, as each depth is a running column of its own.
    """
    deepest = df.agg(F.max(F.size(stack))).first()[0] or 0
    w = Window.partitionBy(*group).orderBy(*order)
    s = F.coalesce(F.col(stack), F.array().cast(df.schema[stack].dataType))
    before = F.coalesce(F.lag(s).over(w), F.array().cast(df.schema[stack].dataType))
    out = df.withColumns({"row_no": F.row_number().over(w), "_before": before}).withColumn("_same", _shared(s, F.col("_before")))
    opened = [F.last(F.when(F.col("_same") < d + 1, F.col("row_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for d in range(deepest)]
    rows = F.array(*opened) if opened else F.expr("cast(array() AS array<int>)")
    return out.withColumn("inside", F.slice(rows, F.lit(1), F.size(s))).drop("_same", "_before")
