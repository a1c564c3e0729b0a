"""Python functions on columns, run on Arrow batches."""

from __future__ import annotations

import marshal
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tracewell.session import ship


def _array(values: list, t: pa.DataType) -> pa.Array:
    """Plain values as an Arrow array, a column at a time: tuples are structs, pairs or dicts are maps."""
    if pa.types.is_struct(t):
        none = [v is None for v in values]
        rows = [(None,) * t.num_fields if v is None else v if isinstance(v, tuple) else tuple(v.get(t.field(i).name) for i in range(t.num_fields)) for v in values]
        parts = [_array(list(c), t.field(i).type) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], t.field(i).type) for i in range(t.num_fields)]
        return pa.StructArray.from_arrays(parts, fields=list(t), mask=pa.array(none, pa.bool_()))
    if pa.types.is_list(t) or pa.types.is_map(t):
        rows = [list(v.items()) if isinstance(v, dict) else v for v in values]
        ends = [0, *accumulate(0 if v is None else len(v) for v in rows)]
        at = pa.array([None if v is None else e for v, e in zip(rows, ends)] + ends[-1:], pa.int32())
        inner = [x for v in rows if v is not None for x in v]
        if pa.types.is_list(t):
            return pa.ListArray.from_arrays(at, _array(inner, t.value_type), type=t)
        return pa.MapArray.from_arrays(at, _array([k for k, _ in inner], t.key_type), _array([v for _, v in inner], t.item_type), type=t)
    return pa.array(values, t)


def _values(a: pa.Array) -> list:
    """An Arrow array as plain values, as ``to_pylist`` gives them but a column at a time: structs are dicts, maps lists of pairs."""
    if not len(a):
        return []  # Spark sends no offsets then
    t, none = a.type, a.is_null().to_pylist() if a.null_count else None
    if pa.types.is_struct(t):
        names = [f.name for f in t]
        out = [dict(zip(names, r)) for r in zip(*map(_values, a.flatten()))] if names else [{} for _ in range(len(a))]
    elif pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_map(t):
        ends = a.offsets.to_numpy().tolist()
        first, n = ends[0], ends[-1] - ends[0]
        inner = list(zip(_values(a.keys.slice(first, n)), _values(a.items.slice(first, n)))) if pa.types.is_map(t) else _values(a.values.slice(first, n))
        out = [inner[b - first : e - first] for b, e in zip(ends, ends[1:])]
    elif pa.types.is_integer(t):
        out = (a.fill_null(0) if none else a).to_numpy().tolist()
    elif pa.types.is_string(t):
        found = a.dictionary_encode()
        words = found.dictionary.to_pylist()
        return [words[i] if i >= 0 else None for i in found.indices.fill_null(-1).to_numpy().tolist()]
    else:
        return a.to_pylist()
    return [None if x else v for x, v in zip(none, out)] if none else out


def _key(row: tuple):
    """What equal rows with nested values have in common."""
    try:
        return marshal.dumps(row, 2)
    except ValueError:  # decimals, dates and times
        return repr(row)


def batched(function: Callable, returns: str) -> Callable[..., Column]:
    """``function`` of plain Python values as a function of columns that returns the SQL type ``returns``.

    Maps arrive as lists of pairs. Structs are returned as tuples in the order of their
    fields. The function must be pure: rows of equal inputs within one batch share a call. Nothing is kept between batches.
    """

    def call(*columns: Column) -> Column:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            ship(spark)
        kind = to_arrow_type(_parse_datatype_string(returns))

        def run(*arrays: pa.Array) -> pa.Array:
            rows = list(zip(*(_values(a) if pa.types.is_nested(a.type) else a.to_pylist() for a in arrays)))
            nested = any(pa.types.is_nested(a.type) for a in arrays)
            numbers: dict = {}
            at = [numbers.setdefault(_key(row) if nested else row, len(numbers)) for row in rows]
            firsts = dict(zip(reversed(at), reversed(rows)))
            out = _array([function(*firsts[k]) for k in range(len(numbers))], kind)
            return out if len(out) == len(rows) else out.take(pa.array(at, pa.int32()))

        return F.arrow_udf(run, returns)(*columns)

    return call


def partitions(spark: SparkSession) -> int:
    """As many parts as costly work per row is dealt over: a few for each core, as each starts Python anew."""
    return max(32, 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all partitions, before work that costs more than the rows' size says."""
    return df.repartition(partitions(df.sparkSession))


def once(df: DataFrame, text: str, columns: dict[str, Callable[[str], Column]]) -> DataFrame:
    """``df`` with ``columns``, functions of the column named ``text``, made once for each distinct value of it.

    Distinct values are dealt over all partitions, as they cost more than their size says.
    """
    each = df.select(F.col(text).alias("_of")).distinct()
    made = spread(each).select("_of", *[f("_of").alias(n) for n, f in columns.items()])
    return df.join(made, F.col(text).eqNullSafe(F.col("_of")), "left").drop("_of")
