"""Build files, rules, runs of op trees, listings, comparisons and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import expressions as E
from tracewell.functions import rules as C
from tracewell.operators import graphs as G
from tracewell.operators import interpreter as I
from tracewell.operators import oracles as O
from tracewell.sources import aliases as A
from tracewell.sources import builds as B
from tracewell.sources import listings as K
from tracewell.sources import logs as L
from tracewell.streaming import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text,value",
    [("0x20", 32), ("7UL", 7), ("BIT(3)", 8), ("bit ( 31 )", 1 << 31), ("(1 << 5)", 32), ("~0", 0xFFFFFFFF), ("~ 0x00", 0xFFFFFFFF), ("-5", -5), ("0xFFFFFFFFFFFFFFFF", -1), ("010", None), ("NAME", None), ("", None), ("1 + 2", None)],
)
def test_int_literal(spark, text, value):
    assert one(spark, B.int_literal(F.lit(text))) == value


def test_defines(spark):
    text = "#define A 0x10 /* c */\n # define B(x, y) ((x)<<(y))\n#define C (A | 1)\n#define D ((2 + 3) << 1)\n#define E 010\n#define F HSOTG_REG(0x8)\n#define G 6 / 2\nint x;"
    df = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string")
    got = {r.name: (r.line_no, r.params, r.value) for r in B.defines(L.lines(df, "file"), "file").collect()}
    assert got == {"A": (1, None, 16), "B": (2, ["x", "y"], None), "D": (4, None, 10), "F": (6, None, 8)}


def test_flags_and_databases(spark):
    db = [{"file": "a.c", "command": "gcc -I inc -x c++ -DX='a b' -c a.c -include"}, {"directory": "/k/d", "file": "../a.c", "arguments": ["gcc", "-I/abs/../x"]}, {"directory": "/k", "file": "b.c", "command": "gcc 'open"}]
    files = spark.createDataFrame([("/k", json.dumps(db)), ("/k", "no json"), ("/k", None)], "directory string, text string")
    got = {r.source: r for r in B.compile_commands(files).withColumn("flags", B.parser_flags(F.col("tokens"), F.col("directory"), F.col("source"))).collect()}
    assert set(got) == {"/k/a.c", "/k/b.c"} and got["/k/b.c"].tokens is None
    assert got["/k/a.c"].flags == ["-I", "/k/inc", "-x", "c++", "-DX=a b", "-I", "/k"]
    only = B.parser_flags(F.array(*map(F.lit, ["-I/abs/../x", "-isystem$S", "-O2", "-m32"])), F.lit("/k"), F.lit("/k/s/a.c"))
    assert one(spark, only) == ["-x", "c", "-I/abs/../x", "-isystem$S", "-m32", "-I", "/k/s"]


@pytest.mark.parametrize(
    "init,guard,step,count",
    [("int i = 0", "i < 10", "i++", 10), ("i = 0;", "i <= 10", "++i", 11), ("u32 i = 0", "i < N", "i += 3", 4), ("i = 9", "i < 3", "i++", 0), ("i = 0", "i < 257", "i++", None),
     ("i = 0", "j < 4", "i++", None), ("i = 0", "i < 4", "j++", None), ("i = 0", "i < 4", "i += 0", None), ("i = 0", "i < M", "i++", None), ("", "", "", None), ("i = 0", "i < 4", "i", None)],
)
def test_loop_bound(spark, init, guard, step, count):
    macros = F.create_map(F.lit("N"), F.lit(12).cast("bigint"))
    got = one(spark, C.loop_bound(F.lit(init), F.lit(guard), F.lit(step), macros))
    assert (got and got["count"]) == count


def test_rules(spark):
    text = "a -> regs = devm_platform_ioremap_resource(pdev, 0);\nb = devm_platform_ioremap_resource(p, 2);\na->regs = devm_platform_ioremap_resource(p, 1);"
    assert one(spark, C.resource_bindings(F.lit(text))) == {"a->regs": 1, "b": 2}
    assert one(spark, C.resource_bindings(F.lit(""))) == {}
    macros = F.create_map(F.lit("DEV"), F.lit(17).cast("bigint"))
    assert one(spark, C.device_ids(F.lit("{ PCI_DEVICE(0x8086, DEV) }, { PCI_DEVICE(1, 2) }"), macros)) == [0x8086, 17]
    assert one(spark, C.device_ids(F.lit("PCI_DEVICE(VENDOR, DEV)"), macros)) is None
    assert one(spark, C.without_calls(F.lit("a;\n\twritel(x, b + IO_DMA_CMD);\nc;\n"), "IO_DMA_CMD")) == "a;\nc;\n"
    assert one(spark, C.hinted(F.lit("foo_unmask_irq"), C.ROLE_HINTS)) == "interrupt_mask"
    assert one(spark, C.hinted(F.lit("x"), C.ROLE_HINTS)) is None
    assert [one(spark, C.is_noise(F.lit(n), ("PAGE_", "NR_"))) for n in ("PAGE_SIZE", "linux", "lower_long_name", "CTRL", "_1")] == [True, True, False, False, False]
    assert one(spark, C.sources_listed(F.lit("obj-y += a.o b.o"), F.array(F.lit("/x/a.c"), F.lit("b.c"))))
    assert not one(spark, C.sources_listed(F.lit("obj-y += a.o"), F.array(F.lit("c.c"))))
    assert [tuple(one(spark, C.line_counts(F.lit(t)))) for t in ("a\n\n b", "a\n", "", "\n")] == [(3, 2), (1, 1), (0, 0), (1, 0)]
    assert tuple(one(spark, C.line_counts(F.lit(None).cast("string")))) == (0, 0)


def test_lowerable(spark):
    def ask(*tokens):
        rows = ", ".join(f"named_struct('tok', '{t}', 'op', cast(null as string), 'ival', cast(null as bigint), 'name', '{n}')" for t, n in tokens)
        return one(spark, C.lowerable(F.expr(f"cast(array({rows}) as array<{E.TOKEN}>)")))

    assert ask(("Var", "p->base"), ("Const", ""), ("Op", "")) and ask(("Var", "sizeof x")) and ask(("Var", "a.b->hpi.regstep"))
    assert not ask(("Var", "p->other")) and not ask(("Top", "")) and not ask()


def test_clock(spark):
    ask = lambda *a: tuple(one(spark, C.clock(*[F.lit(x) for x in a])))
    assert ask(1, 2, 100_000_000, 0) == (0, 100_000_000, 2)
    assert ask(1, 9 << 20 | 2 << 16, 100_000_000, 0) == (0, 250_000_000, 9 << 20 | 2 << 16)
    assert ask(3, 2 << 1, 600_000_000, 0) == (0, 150_000_000, 4)
    assert ask(7, 0xA5A5A5A5, 96_000_000, 480_000_000) == (-22, 0, 0xA5A5A5A5)
    assert ask(7, 0xA5A5A5A5, 120_000_000, 480_000_000) == (0, 0, 2)
    # 500 MHz needs x8 to pass the least frequency, and 4 GHz / 24 MHz is 167 turns.
    assert ask(8, 3 << 28, 500_000_000, 24_000_000) == (0, 0, 3 << 28 | 166 << 20 | 3 << 16 | 1)
    assert one(spark, C.clock(F.lit(9), F.lit(0), F.lit(1), F.lit(1))) is None


def _run(ops, env=None, registers=None, size=64):
    return I.run(json.dumps(ops), env, registers, size)


def test_runs_of_op_trees():
    const = lambda n: {"Const": n}
    fixed = lambda n: {"Fixed": {"offset": n}}
    ret = {"Return": {"value": {"Var": "v"}}}
    big = {"Read": {"var": "v", "width": "B2", "addr": fixed(0), "evidence": {"byte_order": "big"}}}
    assert _run([big, ret])[:2] == ([("R", 0, 0x5A7F)], 0x5A7F)
    write = {"Write": {"width": "B1", "addr": fixed(3), "value": const(0x1FF)}}
    assert _run([write, {"Read": {"var": "v", "width": "B1", "addr": fixed(3)}}, ret, write])[:2] == ([("W", 3, 255), ("R", 3, 255)], 255)
    minus = {"Return": {"value": {"BinOp": {"op": "Sub", "left": const(0), "right": const(1)}}}}
    assert _run([minus])[1] == -1
    assert _run([{"Return": {"value": {"BinOp": {"op": "Div", "left": const(1), "right": const(0)}}}}])[4] == "division by zero"
    assert _run([{"Loop": {"count": const(2), "body": [write]}}])[4] == "unproved loop"
    assert _run([{"Loop": {"count": const(300), "bounded": True, "reliability": "Exact", "body": []}}])[4] == "loop count"
    assert _run([write, {"Write": {"width": "B4", "addr": fixed(61), "value": const(1)}}]) == ([("W", 3, 255)], None, {}, {}, "address outside the memory")
    assert _run([{"Write": {"addr": {"Symbolic": {"register": "X"}}, "value": const(1)}}])[4] == "unknown address"
    state = [{"StateWrite": {"field": "s", "width": "B1", "value": const(300)}}, {"StateRead": {"field": "s", "var": "v"}}, {"OutputWrite": {"target": "o", "value": {"Ite": {"guard": {"Var": "v"}, "then": {"Bits": {"expr": {"Var": "v"}, "hi": 3, "lo": 2}}, "else": const(9)}}}}]
    assert _run(state)[2:] == ({"s": 44}, {"o": 3}, None)
    assert I.run(None, None, None, 8) is None and I.run("[]", None, None, 8) == ([], None, {}, {}, None)
    assert I.run("{", None, None, 8)[4].startswith("bad program") and I.run("[1]", None, None, 8)[4].startswith("bad program")


def test_listing_and_bindings(spark):
    assert K.listing(None) is None and K.listing("x") is None and K.listing("{}") is None
    ops = [{"Loop": {"loop_kind": "while", "guard": {"Var": "g"}, "guard_ops": [{"StateRead": {"var": "x", "field": "f"}}], "guard_var": "g", "guard_value": None, "body": [{"Delay": {"cycles": {"Const": 16}}}]}},
           {"Return": {"value": {"Top": None}, "op_id": "o1", "evidence": {"source": "a.c", "line": 3}}}, {"Other": {}}]
    assert K.listing(json.dumps({"driver": "d", "version": 2, "modules": [{"name": "m", "ops": ops}]})).split("\n") == [
        "driver d v2 {", "  module m {", "    LOOP while g [Unknown] {", "      GUARD {", "        x := STATE(f)", "        g := ⊤", "      }", "      DELAY(0x10)", "    }", "    RETURN ⊤ @o1 [Unknown] a.c:3", "    ?", "  }", "}",
    ]
    text = 'backend linux for device d {\n# note\n  include <a.h>\n  type T -> "struct x *"\n  callback ops.get = f\n  export f as "g"\n  map MmioRead(B4) -> "readl"\n  map dev.lock -> "d->lock"\n}'
    rows = K.bindings(L.lines(spark.createDataFrame([("f", text), ("n", None)], "k string, text string"), "k"), "k").orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in rows] == [("include", "<a.h>", None), ("type", "T", "struct x *"), ("callback", "ops.get", "f"), ("export", "f", "g"), ("primitive", "MmioRead(B4)", "readl"), ("state", "dev.lock", "d->lock")]


def test_comparisons(spark):
    steps = "c string, step int, v int"
    a = spark.createDataFrame([("x", 0, 1), ("x", 1, None), ("y", 0, 1)], steps)
    b = spark.createDataFrame([("x", 0, 1), ("x", 1, None), ("y", 0, 2), ("z", 0, 1)], steps)
    assert {r.c: tuple(r)[1:] for r in O.trace_diff(a, b, ["c"], "step", ["v"]).collect()} == {"x": (2, 0, None, None), "y": (1, 1, 0, "v"), "z": (1, 1, 0, "extra")}
    assert O.trace_diff(a.limit(0), b.limit(0), ["c"], "step", ["v"]).count() == 0
    base = spark.createDataFrame([("x", "1"), ("y", "2")], "c string, f string")
    mutants = spark.createDataFrame([("x", "m1", "9"), ("y", "m1", "8"), ("x", "m2", "1"), ("y", "m2", None)], "c string, m string, f string")
    assert {r.m: (r.cases, r.caught, r.complete) for r in O.mutations_caught(base, mutants, ["c"], "m", "f").collect()} == {"m1": (2, 2, True), "m2": (2, 1, False)}
    parts = [spark.createDataFrame(rows, "k string, v string") for rows in ([("a", "1")], [("a", "2"), ("b", "4"), ("b", "3")])]
    assert sorted(map(tuple, O.merged_first(parts, "k", "v").collect())) == [("a", "1", 0), ("b", "3", 1)]


def test_streams_end_as_tables_do(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES ('u', 1, true, timestamp'2024-01-01 00:10:00'), ('u', 2, false, timestamp'2024-01-01 00:50:00'), ('w', 3, null, timestamp'2024-01-01 05:00:00') AS t(k, n, marker, at)")
    for part in (1, 2, 3):
        df.where(F.col("n") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    versions = W.drained(W.running_segments(stream, "k", "n", "marker"), "t", "update")
    last = versions.groupBy("k").agg(F.max_by(F.struct("segments", "rows"), "_batch").alias("s")).select("k", "s.*")
    assert sorted(map(tuple, last.collect())) == [("u", 1, 2), ("w", 0, 1)]
    # The last window stays open: only later rows could close it.
    closed = W.drained(W.windowed_counts(stream, "at", ["k"]), "t")
    assert [(r.k, r.n) for r in closed.collect()] == [("u", 2)]
    assert sorted((r.k, r.n) for r in W.windowed_counts(df, "at", ["k"]).collect()) == [("u", 2), ("w", 1)]


def test_value_traces(spark):
    text = "[x] early\n[trace 1] R 0x1 = 0x2\n[x-begin]\n[trace 2] R 0x1 = 0x2\n[x] one\n[trace 3] W 0x10 = 0xffffffffffffffff\n[x-result] 0x5\n[x-output] a=0x7\n[x-state] s=0x1 t=0x2\n[x] two\nnoise\n[x-end]\n[trace 4] R 0x1 = 0x2\n[x-begin]\n[trace 5] R 0x1 = 0x2\n[x] one\n[trace 6] R 0x3 = 0x4"
    df = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "log string, text string")
    got = sorted((r.line_no, r.call_no, r.module, r.kind, r.name, r.offset, r.value) for r in L.value_traces(L.lines(df, "log"), "log", "x").collect())
    assert [g[1:] for g in got] == [
        (1, "one", "W", None, 16, -1), (1, "one", "result", None, None, 5), (1, "one", "output", "a", None, 7), (1, "one", "state", "s", None, 1), (1, "one", "state", "t", None, 2),
        (2, "two", None, None, None, None), (3, "one", "R", None, 3, 4),
    ]


def test_manifests(spark):
    def m(**more):
        return json.dumps({"schema": 1, "name": "n", "sources": ["a.c", "b.c", "../c.c", "/d.c"], "kbuild": "Kbuild", **more})

    rows = [("ok", m()), ("schema", m(schema=2)), ("name", m(name="")), ("few", m(sources=["a.c"])), ("c", m(sources=["a.c", "b.c", "c.c", "d.h"])), ("text", "x"), ("null", None)]
    df = spark.createDataFrame([(k, t, "/k/d") for k, t in rows], "k string, text string, directory string")
    got = {r.k: r for r in B.manifests(df, "k").collect()}
    assert {k: r.problem for k, r in got.items()} == {"ok": None, "schema": "schema", "name": "name", "few": "too few sources", "c": "not C", "text": "not a manifest", "null": "not a manifest"}
    assert got["ok"].sources == ["/k/d/a.c", "/k/d/b.c", "/k/c.c", "/d.c"] and got["ok"].build_file == "/k/d/Kbuild"


def test_code_only(spark):
    text = "readl(a); // writel(\n/* readl(\n */ s = \"readl( \\\" x\"; c = '('; xreadl(b); readl (c); writel(d)"
    assert one(spark, C.call_count(C.code_only(F.lit(text)), ("readl", "writel"))) == 3
    assert one(spark, C.call_count(C.code_only(F.lit("\"" + "x" * 200_000 + "\"")), ("x",))) == 0


def test_aliases(spark):
    text = 'head\n1 var1[@probe] %a { "ln": 12, "fl": "d.c" }\n2 var2[m@isr] %b\n3 plain\n2 var2[g] %c\nMayAlias var1[@p] -- var2[@q]\nMayAlias var3[x] -- var1[p]\nNoAlias var1[p] -- var9[x]\nMayAlias var1[p] -- var4[p]\nMayAlias var2[p] -- var3[p]\nMayAlias plain -- var3[p]'
    lines = L.lines(spark.createDataFrame([("f", text), ("g", None)], "k string, text string"), "k")
    assert {r.var: (r.function, r.line, r.file) for r in A.symbols(lines, "k").collect()} == {1: ("probe", 12, "d.c"), 2: ("g", 0, ""), 3: ("", 0, "")}
    found = A.pairs(lines, "k")
    assert found.count() == 5
    origins = spark.createDataFrame([("f", 1), ("f", 4), ("f", 4)], "k string, var long")
    assert sorted((r.alias_var, r.origin_var) for r in A.aliased(found, origins, "k").collect()) == [(2, 1), (3, 1)]
    assert A.aliased(found, origins.limit(0), "k").count() == 0


def test_edges_and_entries(spark):
    refs = spark.createDataFrame([("f", 1, 2, "a"), ("f", 5, 6, "a"), ("f", 8, 9, "b"), ("f", 11, 12, "x")], "file string, s int, e int, sym string")
    callees = spark.createDataFrame([("f", 1, 2), ("f", 8, 9)], "file string, s int, e int")
    targets = spark.createDataFrame([("a",), ("b",)], "sym string")
    assert [r.sym for r in G.callback_entries(refs, callees, targets, ["file", "s", "e"], "sym").collect()] == ["a"]
    functions = spark.createDataFrame([("s1", "f", "u1"), ("s2", "g", "u2"), ("s3", "h", "u1"), ("s4", "h", "u2")], "symbol string, name string, unit string")
    sites = spark.createDataFrame([("m", "f", "s1", "u1"), ("m", "g", "s2", "u1"), ("m", "g", None, "u1"), ("m", "h", None, "u1"), ("m", "z", "s9", "u1")], "caller string, callee string, symbol string, unit string")
    got = sorted((r.callee, r.target_unit or "", r.how) for r in G.resolved_edges(sites, functions).collect())
    assert got == [("f", "u1", "same unit"), ("g", "u2", "other unit"), ("g", "u2", "other unit"), ("h", "", "unresolved"), ("z", "", "unresolved")]


def test_pruned(spark):
    rows = [(0, None, 0, "Cond", 0), (1, 0, 1, "Read", 1), (2, 0, 1, "Seq", 0), (3, 2, 2, "Write", 0), (4, None, 0, "Loop", 0), (5, 4, 1, "Read", 1), (6, None, 0, "Read", 0), (7, None, 0, "Seq", 0), (8, 7, 1, "Cond", 0), (9, 8, 2, "Read", 1)]
    nodes = spark.createDataFrame([("m", *r) for r in rows], "m string, node_id int, parent_id int, depth int, kind string, good int")
    assert sorted(r.node_id for r in G.pruned(nodes, ["m"], F.col("good") == 1).collect()) == [0, 1, 7, 8, 9]
    assert G.pruned(nodes.limit(0), ["m"], F.col("good") == 1).count() == 0
