"""Validation: step-by-step comparison of traces, module predicates, mutation sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trace_diff(expected: DataFrame, actual: DataFrame, case: list[str], step: str, columns: list[str]) -> DataFrame:
    """(case..., steps, differing, first_difference, reason) for each case of either side.

    Steps are matched by case and step number; nulls are equal to each other. ``reason``
    is that of the first difference: ``missing`` (not in the actual trace), ``extra``, or
    the names of the columns that differ, comma-joined. A step number may occur once on
    each side.
    """
    key = [*case, step]
    left = expected.select(*key, F.struct(*columns).alias("_e"))
    right = actual.select(*key, F.struct(*columns).alias("_a"))
    joined = left.join(right, key, "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), F.lit(c)) for c in columns]))
    reason = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise(F.nullif(F.array_join(differing, ","), F.lit("")))
    bad = F.col("_r").isNotNull()
    per = joined.select(*key, reason.alias("_r")).groupBy(*case).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(bad).alias("differing"),
        F.min(F.when(bad, F.struct(F.col(step).alias("step"), F.col("_r").alias("reason")))).alias("_f"),
    )
    return per.select(*case, "steps", "differing", F.col("_f.step").alias("first_difference"), F.col("_f.reason").alias("reason"))


def mutations_caught(base: DataFrame, mutants: DataFrame, key: list[str], mutation: str, value: str) -> DataFrame:
    """(mutation, cases, caught, complete): whether each mutation changes the value of every case it was applied to.

    A mutant without a base case counts as caught: it is a case that should not exist.
    """
    joined = mutants.select(*key, mutation, F.col(value).alias("_m")).join(base.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in")), key, "left")
    hit = F.col("_in").isNull() | ~F.col("_m").eqNullSafe(F.col("_b"))
    return joined.groupBy(mutation).agg(F.count(F.lit(1)).alias("cases"), F.count_if(hit).alias("caught")).withColumn("complete", F.col("caught") == F.col("cases"))


def portable_modules(nodes: DataFrame, module: list[str], fits: Column) -> DataFrame:
    """(module..., leaves, portable): whether all leaves of a module fit a contract and it has no loop.

    A leaf for which ``fits`` is null does not fit; a module without leaves is portable.
    """
    inner = F.col("kind").isin("Cond", "Seq", "Loop")
    leaf = F.col("kind").isNotNull() & ~inner
    good = F.when(leaf, F.coalesce(fits, F.lit(False))).otherwise(~F.coalesce(F.col("kind") == "Loop", F.lit(False)))
    return nodes.groupBy(*module).agg(F.count_if(leaf).alias("leaves"), F.bool_and(good).alias("portable"))


def merged_first(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, part): of several tables, the row of the first that has the key; within one, the least value."""
    out = None
    for n, part in enumerate(parts):
        one = part.select(key, value, F.lit(n).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min(F.struct("part", value)).alias("_m")).select(key, f"_m.{value}", "_m.part")
