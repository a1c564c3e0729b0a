"""Regex matches with their places, as plain SQL expressions.

Spark's functions give the matches of a pattern but not where they are. The pieces
between the matches (``split``) and the matches themselves (``regexp_extract_all``)
add up to the text, so running sums of their lengths are the places, in code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 128


def literal(pattern: str) -> str:
    """A regex as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running_sums(lengths: str) -> str:
    """SQL: for each element of an int array the sum of it and those before it.

    Sums are made within blocks and over the blocks' totals, so that an array of n
    elements takes n * sqrt(n)-like work instead of copying n growing arrays.
    """
    block = f"slice({lengths}, k * {_BLOCK} + 1, {_BLOCK})"
    fold = "aggregate({0}, named_struct('at', {1}, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at + x))), a -> a.out)"
    blocks = f"sequence(0, (size({lengths}) - 1) div {_BLOCK})"
    totals = f"concat(array(0), {fold.format(f'transform({blocks}, k -> aggregate({block}, 0, (s, x) -> s + x))', '0')})"
    return f"CASE WHEN size({lengths}) = 0 THEN cast(array() AS array<int>) ELSE flatten(zip_with({blocks}, slice({totals}, 1, (size({lengths}) - 1) div {_BLOCK} + 1), (k, t) -> {fold.format(block, 't')})) END"


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, for every name, the array of its pattern's leftmost non-overlapping matches.

    Elements are (start, stop, text): code points, stop exclusive. Each pattern is
    searched once, and a second time only in texts where it was found.
    """
    keep = df.columns
    df = df.select("*", *[F.expr(f"regexp_extract_all({text}, {literal(p)}, 0)").alias(f"_m_{n}") for n, p in patterns.items()])
    df = df.select("*", *[F.expr(f"CASE WHEN size(_m_{n}) > 0 THEN transform(zip_with(slice(split({text}, {literal(p)}, -1), 1, size(_m_{n})), _m_{n}, (a, b) -> array(length(a), length(b))), x -> x[0] + x[1]) ELSE cast(array() AS array<int>) END").alias(f"_l_{n}") for n, p in patterns.items()])
    df = df.select("*", *[F.expr(running_sums(f"_l_{n}")).alias(f"_e_{n}") for n in patterns])
    return df.select(*keep, *[F.expr(f"zip_with(_m_{n}, _e_{n}, (m, e) -> named_struct('start', e - length(m), 'stop', e, 'text', m))").alias(n) for n in patterns])
