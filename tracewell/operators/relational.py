"""Keyed operators: accounting, conflicts, unique candidates, report diffs, sampling, scoring.

All take DataFrames and column names. Each needs at most one shuffle per key; joins are
left to the optimizer, which broadcasts only what it measures to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def access_accounting(sites: DataFrame, ops: DataFrame, key: str, op_id: str, initial: str) -> DataFrame:
    """Match expected sites with emitted operations on ``key``.

    Status: emitted if any operation has the site; else the site's own status if it is
    filtered or unsupported; else unaccounted. ``op_ids`` is sorted and distinct.
    """
    found = ops.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(op_id)).alias("op_ids"), F.count(F.lit(1)).alias("n_ops"))
    status = F.when(F.col("n_ops") > 0, "emitted").when(F.col(initial).isin("filtered", "unsupported"), F.col(initial)).otherwise("unaccounted")
    return sites.join(found, key, "left").withColumn("status", status).withColumn("n_ops", F.coalesce("n_ops", F.lit(0)))


def accounting_totals(accounted: DataFrame, without_evidence: Column) -> DataFrame:
    """Counters by status, ``complete`` (nothing unaccounted, no stray operation) and ``strict_complete`` (nothing filtered or unsupported either)."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("emitted", "filtered", "unsupported", "unaccounted")}
    return accounted.agg(F.count(F.lit(1)).alias("source_accesses"), *n.values()).select(
        "*",
        ((F.col("unaccounted") == 0) & (without_evidence == 0)).alias("complete"),
        ((F.col("unaccounted") == 0) & (without_evidence == 0) & (F.col("filtered") == 0) & (F.col("unsupported") == 0)).alias("strict_complete"),
    )


def first_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Per key the value of the first row in order, and how many different values there are."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("value"), F.count_distinct(value).alias("n_values")).withColumn("conflict", F.col("n_values") > 1)


def unique_candidate(df: DataFrame, key: str, candidate: str) -> DataFrame:
    """Keys that have exactly one different candidate, and that candidate."""
    return df.groupBy(key).agg(F.min(candidate).alias("lo"), F.max(candidate).alias("hi")).where(F.col("lo") == F.col("hi")).select(key, F.col("lo").alias(candidate))


def primary_and_alternates(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order, with the number of the others; pre-aggregated, so a hot key is no single task."""
    got = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_f"), (F.count(F.lit(1)) - 1).alias("alternates"))
    return got.select("_f.*", "alternates")


def report_diff(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison of two reports: side that lacks the key, and the columns that differ, null-safe."""
    a = base.select(key, F.struct(*columns).alias("a"))
    b = other.select(key, F.struct(*columns).alias("b"))
    differs = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    side = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differs) > 0, "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, side.alias("side"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), differs).alias("changed"))


def hash_sample(df: DataFrame, pool: str, path: str, seed: str, quota: int) -> DataFrame:
    """Per pool the first ``quota`` rows by SHA-256 of ``seed:path``; the rank is kept."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(path).cast("string")), 256)
    return df.withColumn("_h", h).withColumn("rank", F.row_number().over(Window.partitionBy(pool).orderBy("_h"))).where(F.col("rank") <= quota).drop("_h")


def ordered_rules(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (name, regex) that matches; rules are tried in order."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def cluster(df: DataFrame, entity: str, category: str, least: int, excluded: list[str]) -> DataFrame:
    """Categories by number of different entities; ``chosen`` marks the first of at least ``least`` that is not excluded."""
    c = df.groupBy(category).agg(F.count_distinct(entity).alias("n_entities"))
    ok = (F.col("n_entities") >= least) & ~F.col(category).isin(excluded)
    top = c.where(ok).orderBy(F.desc("n_entities"), category).limit(1).select(F.col(category).alias("_top"))
    return c.join(F.broadcast(top), F.col(category) == F.col("_top"), "left").select(category, "n_entities", F.col("_top").isNotNull().alias("chosen"))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded half to even, null where b is 0 or either is null."""
    return F.bround(F.try_divide(a.cast("double"), b.cast("double")), digits)


def weighted_score(parts: list[tuple[Column, float]], penalty: Column | None = None, digits: int = 3) -> Column:
    """Weighted sum of parts less a penalty, held within 0 and 1."""
    total = sum((c.cast("double") * w for c, w in parts), F.lit(0.0))
    if penalty is not None:
        total = total - penalty
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), digits)


def blockers(gates: list[tuple[str, Column]]) -> Column:
    """The names of the gates that do not hold; a null gate does not hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates]), lambda x: x.isNotNull())


def interval_containment(points: DataFrame, at: str, spans: DataFrame, after: str, before: str, on: list[str], width: int) -> DataFrame:
    """Pairs with after <= at < before within equal ``on`` keys.

    Places are bucketed by ``width`` and joined on the bucket, so that a key with many
    points is not compared with all spans of the key. A span is copied once per bucket
    that it meets; choose ``width`` near the usual span.
    """
    p = points.withColumn("_b", F.expr(f"cast(floor({at} / {width}) as bigint)"))
    s = spans.withColumn("_b", F.explode(F.expr(f"sequence(cast(floor({after} / {width}) as bigint), cast(floor(({before} - 1) / {width}) as bigint))"))).where(F.col(after) < F.col(before))
    return p.join(s, [*on, "_b"]).where((F.col(after) <= F.col(at)) & (F.col(at) < F.col(before))).drop("_b")


def fingerprint(df: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """SHA-256 per key over the canonical text of its rows in order."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("_t")))).alias("_r")).select(*key, F.sha2(F.array_join(F.col("_r._t"), "\n"), 256).alias("fingerprint"))
