"""Operators on small tables with known results."""

import random

from pyspark.sql import functions as F

from tracewell.functions import expressions as E
from tracewell.operators import graphs, relational, traces


def test_greedy_prefix_equals_a_cursor(spark):
    r = random.Random(3)
    cases = [([r.choice("abc") for _ in range(r.randint(0, 8))], [r.choice("abc") for _ in range(r.randint(0, 4))]) for _ in range(200)]
    got = spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(cases)], "i int, a array<string>, p array<string>").select("i", traces.greedy_prefix(F.col("a"), F.col("p")).alias("m")).collect()
    for row in got:
        a, p = cases[row["i"]]
        it, n = iter(a), 0
        for x in p:
            if x not in it:
                break
            n += 1
        assert row["m"] == n


def test_calls_take_each_segment_once(spark):
    df = spark.createDataFrame([(["probe", "callback"], ["probe", "callback"]), (["probe", "callback", "callback"], ["probe", "callback"]), (["probe"], ["probe__callback"]), ([], ["x"])], "c array<string>, s array<string>")
    got = [r[0] for r in df.select(traces.align_calls(F.col("c"), F.col("s"))).collect()]
    assert got == [[1, 2], [1, 2, None], [None], []]


def test_accounting_status_precedence(spark):
    sites = spark.createDataFrame([(1, "pending"), (2, "filtered"), (3, "unsupported"), (4, "pending")], "site int, initial string")
    ops = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "site int, op string")
    got = {r["site"]: (r["status"], r["op_ids"]) for r in relational.access_accounting(sites, ops, "site", "op", "initial").collect()}
    assert got == {1: ("emitted", ["a"]), 2: ("emitted", ["b"]), 3: ("unsupported", None), 4: ("unaccounted", None)}


def test_dominators_of_a_diamond_and_a_loop(spark):
    edges = [("d", "e", "a"), ("d", "e", "b"), ("d", "a", "j"), ("d", "b", "j"), ("l", "e", "h"), ("l", "h", "b"), ("l", "b", "h"), ("l", "h", "x")]
    df = spark.createDataFrame(edges, "g string, a string, b string").withColumn("entry", F.lit("e"))
    got = {(r["g"], r["node"]): (r["idom"], r["header"]) for r in graphs.dominators(df, "g", "a", "b", "entry").collect()}
    assert got[("d", "j")] == ("e", False)
    assert got[("l", "b")] == ("h", False) and got[("l", "h")] == ("e", True) and got[("d", "e")] == (None, False)


def test_reach_ends_on_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "s int, d int")
    got = {(r["root"], r["node"]): r["depth"] for r in graphs.reach(df, "s", "d").collect()}
    assert got == {(a, b): (b - a) % 3 or 3 for a in (1, 2, 3) for b in (1, 2, 3)}


def test_expressions_follow_c_precedence(spark):
    assert [t[1] or t[2] or t[3] for t in E.parse("a + 2 * (b - 1) == c")] == ["a", 2, "b", 1, "Sub", "Mul", "Add", "c", "Eq"]
    assert E.parse("a +") is None and E.parse("(a") is None and E.parse(None) is None and E.parse("a b") is None
    parse = F.udf(E.parse, f"array<{E.TOKEN}>")
    rows = [("1 << 64", 0), ("0xFF & 0x0F | 0x30", 0x3F), ("7 / 0", None), ("x * 3 - 1", 14), ("y", 0), ("2 < 3 && 1", 1)]
    df = spark.createDataFrame(rows, "t string, want long").select("want", E.evaluate(parse("t"), F.create_map(F.lit("x"), F.lit(5).cast("bigint"))).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_report_diff_sides(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, v int")
    b = spark.createDataFrame([(2, 5), (3, None), (4, 4)], "k int, v int")
    assert {r["k"]: (r["side"], r["changed"]) for r in relational.report_diff(a, b, "k", ["v"]).collect()} == {1: ("removed", None), 2: ("changed", ["v"]), 3: ("same", []), 4: ("added", None)}
