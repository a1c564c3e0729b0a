"""Cases on which queries once differed from their SQL, and steps that must not grow faster than their input."""

import datetime
import os

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from tracewell.functions import accesses, batches
from tracewell.operators import automata, banks, interpreter
from tracewell.operators import graphs as G
from tracewell.operators import pointers as A
from tracewell.operators import syntax as X
from tracewell.operators.backends import GPIO_TABLES
from tracewell.operators.devices import bank_run
from tracewell.plans import catalogue
from tracewell.plans import syntax as S
from tracewell.session import staged
from tracewell.sources import code

from .conftest import SF


def as_sql(spark, name, folder, **tables):
    """The rows of a query on the given tables, and those of its SQL, both sorted."""
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


def test_interval_guard_rounds_seconds_as_its_sql(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, 1, "signup", at(10.6)), (2, 1, "view", at(10.2)), (3, 1, "view", at(11.4)), (4, 1, "view", at(86410.7)), (5, 1, "view", at(86410.4)), (6, 1, "view", at(10.5)), (7, 1, "signup", at(11.5))]
    got, want = as_sql(spark, "interval_guard", tmp_path, events=spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz"))
    assert got == want


def test_points_to_by_rounds(spark):
    rows = [("address", 0, 100)] + [("copy", i + 1, i) for i in range(5)] + [("address", 200, 0), ("load", 201, 200), ("copy", 0, 5)]
    df = spark.createDataFrame(rows, "kind string, left long, right long")
    assert {p for p, o in A.points_to(df, rounds=3).where("object = 100").collect()} == {0, 1, 2, 3, 201}
    assert {p for p, o in A.points_to(df, rounds=9).where("object = 100").collect()} == set(range(6)) | {201}


def test_labels_by_arrays_and_by_joins(spark):
    rows = [("u", i, None if i % 7 == 0 else (i * 5) % i, (i * 11) % 50) for i in range(40)] + [("v", 1, 9, 0), ("v", 2, 1, 0), ("v", 3, None, 0)]
    nodes = spark.createDataFrame(rows, "unit string, node long, parent long, ord long")
    assert sorted(X.intervals(nodes, "unit").collect()) == sorted(X.intervals(nodes, "unit", gathered=2).collect())


def test_control_flow_moves_nothing_once_labelled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = X.cfg_edges(S.labelled(spark, "/root/testdata/sf0.001"), "unit")
        assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_automata_move_nothing_once_labelled(spark):
    nodes = spark.createDataFrame([(1, 1, None, "body", 0, "Cond", None), (1, 2, 1, "then", 0, "Read", 4)], "m int, node_id int, parent_id int, branch string, ord int, kind string, offset long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = automata.automata(nodes, ["m"])
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert [(r.m, r.empty, r.shortest, len(r.positions)) for r in got.collect()] == [(1, True, 1, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_staged_tables_count_as_larger_than_their_files(spark):
    staged(spark.range(10), "small")
    rows = staged(spark.range(400_000).selectExpr("id", "7 AS k"), "rows")
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in rows.inputFiles())
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 10 * size


def test_repeated_texts_are_parsed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def length(t):
        calls.add(1)
        return None if t is None else len(t)

    df = spark.range(0, 600, 1, 6).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'bc' END AS t")
    got = batches.once(df, "t", {"n": batches.batched(length, "int")}).select("id", "t", "n").collect()
    assert len(got) == 600 and all(r.n == (None if r.t is None else len(r.t)) for r in got) and calls.value == 3


def test_nested_results_are_built_by_column():
    kind = pa.struct([("a", pa.int64()), ("b", pa.list_(pa.struct([("x", pa.string()), ("y", pa.map_(pa.string(), pa.int64()))])))])
    rows = [(1, [("p", {"k": 1}), None, ("q", None)]), None, (None, None), {"a": 3, "b": []}]
    want = [{"a": 1, "b": [{"x": "p", "y": [("k", 1)]}, None, {"x": "q", "y": None}]}, None, {"a": None, "b": None}, {"a": 3, "b": []}]
    got = batches._array(rows, kind)
    got.validate(full=True)
    assert got.to_pylist() == want and got.type == kind and not len(batches._array([], kind))


def test_costly_rows_of_one_file_are_dealt_over_many_tasks(spark):
    assert catalogue.QUERIES["bank_differential"](spark, SF).rdd.getNumPartitions() >= 32


def test_first_differences_of_bank_runs():
    call = ("t", [("R", 0, 1)], 1, None, 0, 0)
    run = lambda calls, data=0, error=None: (data, 0, calls, error)
    assert banks.compared(None, None) is None and banks.compared(run([call]), run([call])) == (1, None)
    assert banks.compared(run([call]), run([call], 1)) == (1, "initial state") and banks.compared(run([call]), run([], None, "KeyError: 't'")) == (1, "error")
    assert banks.compared(run([call, call]), run([call, ("t", [], *call[2:])])) == (2, "t")


def test_banks_that_differ_in_places_alone_share_their_programs():
    banks._made.cache_clear()
    plan = [{"table": t, "args": [("offset", 1), ("value", 1), ("mask", 6), ("bits", 3)]} for t in GPIO_TABLES]
    for at in (0, 20, 40):
        offsets = [("dat", at), ("set", at + 4), ("dirout", at + 8)]
        run = banks.program_run(offsets, 4, ["big_endian"], plan, 4096)
        assert banks.compared(bank_run(offsets, 4, ["big_endian"], plan, 4096), run) == (7, None) and run[2][0][1][0][1] == at
    assert banks._made.cache_info().misses == 1
    assert banks.program_run([("dat", 4095)], 4, [], plan, 4096)[3] == "Unsupported: address outside the memory"


def test_programs_made_functions_run_as_they_are_interpreted():
    var, do = lambda n: {"Var": n}, lambda op, a, b: {"BinOp": {"op": op, "left": a, "right": b}}
    addr = {"Fixed": {"base": "b", "offset": 4}}
    ops = [
        {"Read": {"addr": addr, "width": "B2", "var": "x", "evidence": {"byte_order": "big"}}}, {"StateWrite": {"field": "s", "width": "B1", "value": do("Add", var("x"), {"Const": 300})}},
        {"StateRead": {"field": "s", "var": "y"}}, {"OutputWrite": {"target": "o", "value": do("Sub", {"Const": 0}, var("y"))}}, {"ReadModifyWrite": {"addr": addr, "width": "B1", "transform": do("BitXor", var("__old"), var("p->s"))}},
        {"Cond": {"guard": do("Ge", var("n"), {"Const": 2}), "then_ops": [{"Write": {"addr": addr, "width": "B4", "value": do("Shl", var("o"), var("n"))}}], "else_ops": [{"Return": {"value": do("Eq", var("n"), {"Const": 1})}}]}},
        {"Loop": {"bounded": True, "reliability": "Exact", "count": var("n"), "induction_var": "i", "body": [{"Cond": {"guard": do("Eq", var("i"), {"Const": 3}), "then_ops": [{"Return": {"value": do("Div", var("x"), do("Sub", var("n"), {"Const": 5}))}}]}}]}},
    ]

    def ran(n, how):
        run = interpreter.Run({"n": n}, {}, interpreter.seeded(64), {"b": 8})
        try:
            end = how(run)
        except interpreter.Unsupported as e:
            end = str(e)
        return end, run.trace, run.env, run.state, run.outputs, bytes(run.memory)

    made = interpreter.steps(ops)
    for n in (0, 1, 2, 4, 5, 5000):
        got = ran(n, made)
        assert (got[0][0] if isinstance(got[0], tuple) else got[0], *got[1:]) == ran(n, lambda run: run.go(ops))


def test_nested_values_are_read_by_column():
    kind = pa.struct([("a", pa.int64()), ("t", pa.string()), ("b", pa.list_(pa.struct([("x", pa.bool_()), ("y", pa.map_(pa.string(), pa.float64()))])))])
    rows = [None, {"a": 1, "t": None, "b": None}, {"a": None, "t": "é", "b": [None, {"x": None, "y": [("k", None)]}]}, {"a": -(1 << 63), "t": "", "b": []}, {"a": 2, "t": "é", "b": [{"x": True, "y": [("k", 0.5), ("l", 1.0)]}]}]
    for t, values in ((kind, rows), (pa.list_(kind), [rows, None, [], rows[1:]]), (pa.map_(pa.int32(), kind), [[(1, rows[2])], None, [], [(2, None), (3, rows[4])]])):
        a = pa.array(values, t)
        for at in range(len(a) + 1):
            for b in (a.slice(at), a.slice(at, 2)):
                assert batches._values(b) == b.to_pylist()
    assert batches._key(([1], datetime.date(2020, 1, 1))) == batches._key(([1], datetime.date(2020, 1, 1))) and batches._key(([1],)) != batches._key(([True],))


def test_equal_nested_rows_share_a_call(spark):
    calls = spark.sparkContext.accumulator(0)

    def total(m):
        calls.add(1)
        return None if m is None else [(k, v + 1) for k, v in m]

    df = spark.range(0, 300, 1, 1).selectExpr("id", "CASE WHEN id % 3 > 0 THEN map('a', id % 3) END AS m")
    got = df.select("id", batches.batched(total, "array<struct<k:string,v:bigint>>")("m").alias("t")).collect()
    assert all((r.t is None) == (r.id % 3 == 0) and (r.t is None or [tuple(x) for x in r.t] == [("a", r.id % 3 + 1)]) for r in got) and calls.value == 3


def test_line_states_are_never_broadcast(spark):
    lines = spark.createDataFrame([(1, 0, "x = 1"), (1, 1, "'''"), (1, 2, "y"), (2, 0, "z")], "f int, line int, text string")
    got = code.line_states(lines, "f")
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.f, r.line, r.state) for r in got.collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 2), (2, 0, 0)]


def test_call_texts_are_cut_alike_by_pattern_and_by_character(spark):
    texts = ["", "f", "f()", "f(a", "f)a(b)", "f(a, (b, c), {d, [e]})) x", "f(a]b)", "a, (b, c), d", ",", " a ,, b ", "a) , b", "(a, b", "[a, (b], c), d", "f" + "(" * 9 + "x, y" + ")" * 9 + ", z", "(a)" * 200 + ", b", "f(" + "(a, b), " * 5000 + ")", "é(ü\n, ö), 漢", "a(b\n,c)\n,d"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    trimmed = F.transform(accesses._split_arguments(F.col("t")), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    for r in df.select(accesses.balanced(F.col("t")).alias("a"), accesses._balanced(F.col("t")).alias("b"), accesses.split_arguments(F.col("t")).alias("c"), trimmed.alias("d")).collect():
        assert r.a == r.b and r.c == r.d
    # those of usual nesting fit the patterns, so nothing is folded
    assert [bool(r[0]) for r in df.where("t IN ('f(a, (b, c), {d, [e]})) x', 'é(ü\n, ö), 漢')").select(F.regexp_extract("t", accesses._ROUND, 1)).collect()] == [True, True]


def test_symbols_of_a_wide_file_count_by_their_own_size(spark, tmp_path):
    wide = spark.range(0, 300_000, 1, 1).selectExpr("id AS symbol", *[f"'same' AS c{k}" for k in range(40)])
    wide.write.parquet(f"{tmp_path}/wide")
    got = G._symbols(spark.read.parquet(f"{tmp_path}/wide"))
    assert got.count() == 300_000 and got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 300_000 * 8
