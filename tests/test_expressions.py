"""Unsigned arithmetic, expression trees, runs, nesting and limits against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import accesses as A
from tracewell.functions import cexpr as X
from tracewell.functions import expressions as E
from tracewell.operators import graphs as G
from tracewell.operators import interpreter as I
from tracewell.operators import traces as T
from tracewell.operators import variants as V

ONES = (1 << 64) - 1
EDGES = [0, 1, 2, 3, 10, (1 << 31) - 1, 1 << 32, (1 << 62) + 1, (1 << 63) - 1, 1 << 63, (1 << 63) + 5, ONES - 1, ONES]


def bits(n):
    return (n & ONES) - ((n & ONES) >> 63 << 64)


def test_operators_are_unsigned(spark):
    r = random.Random(1)
    pairs = [(a, b) for a in EDGES for b in EDGES] + [(r.getrandbits(64), r.getrandbits(r.choice([3, 33, 64]))) for _ in range(300)]
    df = spark.createDataFrame([(i, bits(a), bits(b)) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    got = {x["i"]: x for x in df.select("i", *[f(F.col("a"), F.col("b")).alias(n) for n, f in E.OPERATORS.items()]).collect()}
    for i, (a, b) in enumerate(pairs):
        for n in E.OPERATORS:
            want = X.operate(n, a, b)
            assert got[i][n] == (None if want is None else bits(want)), (n, a, b)


@pytest.mark.parametrize(
    "text,env,value",
    [("0xFFFFFFFFFFFFFFFF > 1", {}, 1), ("0xFFFFFFFFFFFFFFFF / 2", {}, (1 << 63) - 1), ("0xFFFFFFFFFFFFFFFF % 10", {}, 5), ("0x7FFFFFFFFFFFFFFF + 1", {}, 1 << 63), ("0x8000000000000000 * 2", {}, 0), ("010 + k", {"k": 1}, 9), ("k ? a : b", {"a": 3, "b": 4}, 4), ("1 / zero", {}, None), ("!k && ~k", {"k": 0}, 1)],
)
def test_values(spark, text, env, value):
    tree = X.parse(text)
    assert X.evaluate(tree, env) == value
    row = spark.range(1).select(E.compiled(X.tokens(tree), {k: F.lit(v) for k, v in env.items()}).alias("c"), E.evaluate(X.token_column(F.lit(text)), F.create_map(*[x for k, v in env.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if env else F.expr("cast(map() as map<string,bigint>)")).alias("e")).first()
    want = None if value is None else bits(value)
    assert (row["c"], row["e"]) == (want, want)


def test_trees_survive_printing():
    r = random.Random(3)

    def tree(depth):
        if not depth or r.random() < 0.2:
            return r.choice([("Const", r.getrandbits(9)), ("Var", "x"), ("Var", "d->y")])
        return r.choice([("Bin", r.choice(list(X.SIGN)), tree(depth - 1), tree(depth - 1)), ("Ite", tree(depth - 1), tree(depth - 1), tree(depth - 1))])

    for _ in range(300):
        t = tree(4)
        assert X.parse(X.display(t)) == t
        env = {"x": r.getrandbits(8), "d->y": r.getrandbits(8)}
        if (v := X.evaluate(t, env)) is not None and X.evaluate(X.fold(t), env) is not None:
            assert X.evaluate(X.fold(t), env) == v
    assert X.parse("a b +") == ("Var", "a b +") and X.parse(None) == X.TOP and X.parse("(" * 3000) [0] == "Var"


def test_runs_are_unsigned_and_keep_indexed_state():
    bin_ = lambda op, a, b: {"BinOp": {"op": op, "left": a, "right": b}}
    program = json.dumps([
        {"StateWrite": {"field": "s", "index": {"Var": "k2"}, "width": "B8", "value": bin_("Gt", {"Var": "k"}, {"Const": 1})}}, {"StateRead": {"field": "s", "index": {"Const": 2}, "var": "a"}},
        {"Read": {"var": "b", "width": "B1", "addr": {"Symbolic": {"device": "d", "register": "R"}}}}, {"Return": {"value": bin_("Add", {"Var": "a"}, {"Var": "GENMASK(7, 4)"})}},
    ])
    trace, result, state, _, error = I.run(program, {"k": -1, "k2": 2}, {"R": 4}, 64, {"d": 16})
    assert (result, state, error) == (1 + 0xF0, {"s[2]": 1}, None) and trace[0][:2] == ("R", 20)


def test_nothing_is_too_deep_or_too_many(spark):
    deep = spark.createDataFrame([(1, 1, [str(k) for k in range(40)]), (1, 2, [str(k) for k in range(39)])], "g int, o int, s array<string>")
    assert [x["inside"] for x in T.nested(deep, ["g"], ["o"], "s").orderBy("o").collect()] == [[1] * 40, [1] * 39]
    assert T.nested(deep.where("false"), ["g"], ["o"], "s").count() == 0
    assert T.nested(spark.createDataFrame([(1, 1, None), (1, 2, ["a"]), (1, 3, ["a", None]), (1, 4, ["b"])], deep.schema), ["g"], ["o"], "s").orderBy("o").select("inside").collect() == [([],), ([2],), ([2, 3],), ([4],)]
    nodes = [("m", 3 * k + j, None if j == 0 else 3 * k, 0 if j == 0 else 1, ("body", "then", "else")[j], k if j == 0 else 0, "Cond" if j == 0 else "Read", k * 2 + j) for k in range(18) for j in range(3)]
    df = spark.createDataFrame(nodes, "module string, node_id int, parent_id int, depth int, branch string, ord int, kind string, offset int")
    small = spark.createDataFrame([("n", 1, None, 0, "body", 0, "Read", 4), ("n", 2, None, 0, "body", 1, "Cond", None)], df.schema)
    got = {x["module"]: (x["too_many"], x["variants"]) for x in V.branch_variants(df.unionByName(small), ["module"]).collect()}
    assert got["m"] == (True, None) and got["n"] == (False, [[("R", 4)]])
    edges = spark.createDataFrame([("g", "a", "b", "a")] * 3, "g string, s string, d string, entry string")
    assert G.dominators(edges, "g", "s", "d", "entry").count() == 2


@pytest.mark.parametrize("text,args", [("f(a, g(b, c), {d, e}[1])", ["a", "g(b, c)", "{d, e}[1]"]), ("f()", [""]), ("f", []), ("f(a", []), (None, []), ("f( a ,b )", ["a", "b"])])
def test_call_arguments(spark, text, args):
    assert spark.range(1).select(A.call_arguments(F.lit(text).cast("string")).alias("x")).first()["x"] == args
