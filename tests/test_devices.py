"""Extraction, binds, plans and source models on odd, empty and repeated input."""

from pyspark.sql import functions as F

from tracewell.operators import backends as B
from tracewell.operators import banks as G
from tracewell.operators import devices as D
from tracewell.operators import extraction as X

EVENTS = "f string, ord int, event string, name string, args array<string>, lhs string, op string, text string, guards array<string>"


def _ops(spark, rows):
    got = X.operations(spark.createDataFrame(rows, EVENTS), ["f"]).orderBy("f", "ord").collect()
    return [(r.f, r.ord, r.kind, r.address, r.value) for r in got]


def test_a_write_takes_what_the_variable_holds(spark):
    call = lambda f, o, name, args, lhs=None: (f, o, "call", name, args, lhs, None, None, None)
    set_ = lambda f, o, lhs, op, text, guards=None: (f, o, "assign", None, None, lhs, op, text, guards)
    rows = [
        call("g", 1, "readl", ["A"], "v"), set_("g", 2, "v", "=", "v | 4"), call("g", 3, "writel", ["v", "A"]),
        set_("g", 4, "v", "=", "7"), call("g", 5, "writel", ["v", "A"]),  # no longer what was read
        call("h", 1, "writel", ["v", "A"]),  # another function's variable is unknown
        call("h", 2, "writel", ["w + 1", "A"]), call("h", 3, "mdelay", ["2"]), call("h", 4, "udelay", ["n"]), call("h", 5, "other", None), call("h", 6, None, None),
        call("i", 1, "regmap_update_bits", ["m", "R", "0xf", "3"]), ("i", 2, None, None, None, None, None, None, None), ("i", 3, "return", None, None, None, None, None, None),
    ]
    assert _ops(spark, rows) == [
        ("g", 1, "Read", "A", None), ("g", 3, "ReadModifyWrite", "A", "v | 4"), ("g", 5, "Write", "A", "7"),
        ("h", 1, "Write", "A", "v"), ("h", 2, "Write", "A", "w + 1"), ("h", 3, "Delay", None, "2000000"),
        ("i", 1, "ReadModifyWrite", "m + R", "((__old & ~(0xf)) | ((3) & (0xf)))"), ("i", 3, "Return", None, None),
    ]
    assert _ops(spark, []) == []


CASE = "id int, offsets map<string,bigint>, width int, flags array<string>, plan array<struct<table:string,args:map<string,bigint>>>"


def test_banks(spark):
    get = [("gpio_chip.get", {"offset": 1})]
    df = spark.createDataFrame(
        [(1, {"dat": 0}, 1, [], get), (2, {"set": 0}, 1, None, get), (3, {"dat": 0}, 1, None, None), (4, {"dat": 0}, 1, [], [("gpio_chip.odd", {})]), (5, {"dat": 0}, 1, [], []), (6, None, None, None, get)], CASE
    ).withColumn("made", F.col("flags"))
    got = {r.id: r for r in G.bank_differential(df, "offsets", "width", "flags", "made", "plan").collect()}
    assert [(got[i].calls, got[i].first_difference, got[i].passed) for i in range(1, 7)] == [(1, None, True), (0, "error", False), (0, None, False), (0, "error", False), (0, None, True), (0, "error", False)]
    run = D.bank_traces(df.where("id = 1"), "offsets", "width", "flags", "plan").first().run
    assert run.data == 0x5A and run.calls[0].trace == [("R", 0, 0x5A)] and run.calls[0].result == 1
    assert {r.callback for r in G.callback_programs(df, ["id"], "offsets", "width", "flags").where("id = 1").collect()} == {"init", "get", "get_multiple", "set", "set_multiple"}


def test_power_traces(spark):
    df = spark.createDataFrame([(1, 1, [0]), (2, 0, []), (3, 0, None)], "id int, flags int, ports array<int>")
    rows = D.power_traces(df, ["id"], "flags", "ports").orderBy("phase", "step").collect()
    assert {r.id for r in rows} == {1} and len(rows) == 18
    assert [(r.kind, r.offset) for r in rows if r.phase == "resume"][-1] == ("W", 0x40)
    assert [(r.kind, r.offset, r.value) for r in rows if r.phase == "suspend"][-1] == ("W", 0x44, 0xFEFEFEFE)


def test_binds_and_plans(spark):
    devices = spark.createDataFrame([("a-b", None, None, None)], "device string, cls string, base string, state_only boolean")
    functions = spark.createDataFrame([], "device string, ord int, name string, role string, is_entry boolean, callback_table string, module string, params array<struct<name:string,type:string>>, portable boolean, ops int, returns boolean")
    binds = B.default_binds(devices, functions, ("harness",)).collect()
    assert {r.section for r in binds} == {"type", "primitive", "state"} and len(binds) == 4 + 13 + 2
    assert [r.value for r in binds if r.name == "DeviceState"] == ["struct a_b_priv"]
    assert B.callback_plans(devices, functions, spark.createDataFrame([], "device string, name string, offset bigint")).count() == 0
    one = spark.createDataFrame([("a-b", 1, "f", None, None, "gpio_chip.get", "m", None, True, 1, False)], functions.schema)
    assert [(r.table, r.args) for r in B.callback_plans(devices, one.union(one), spark.createDataFrame([], "device string, name string, offset bigint")).collect()] == [("gpio_chip.get", {})]


def test_contexts(spark):
    cases = spark.createDataFrame([("c", "s.c"), ("c", "s.c"), (None, None)], "case_id string, source string")
    recipes = spark.createDataFrame([("c", "p", "s.o")], "case_id string, profile string, target string")
    profiles = spark.createDataFrame([("p", "k", "arm", "b", None)], "profile string, kind string, arch string, build_dir string, defconfig string")
    commands = spark.createDataFrame([("b", "s.c", "cc 2"), ("b", "s.c", "cc 1")], "directory string, source string, command string")
    got = B.holdout_contexts(cases, recipes, profiles, commands).collect()
    assert sorted((r.command or "", r.problem or "") for r in got) == [("", "case without a recipe"), ("cc 1", ""), ("cc 1", "")]


def test_variants_and_banks(spark):
    fields = "id int, field string, expr string, condition string, switch string, branch string"
    rows = [(1, "dirin", "b", "(i) == 2", "i", "case"), (1, "dirout", "b ", "", "i", "default"), (1, "dirout", "b", "", "i", "default"), (2, "dirin", None, None, None, None), (2, "dirout", None, None, None, None)]
    sources = spark.createDataFrame([(1, 'i = of_alias_get_id(pdev->dev.of_node, "g");'), (2, None)], "id int, text string")
    assert G.direction_variants(spark.createDataFrame(rows, fields), sources, ["id"]).count() == 0  # two entries of one field; nulls
    got = G.direction_variants(spark.createDataFrame(rows[:2], fields), sources, ["id"]).collect()
    assert [r.source_condition for r in got] == ['(of_alias_get_id(pdev->dev.of_node, "g")) == 2']
    places = "id int, field string, base string, resource_index int, expr string"
    macros = spark.createDataFrame([], "id int, name string, value bigint")
    bank = [(1, "dat", "g->r", 0, "g->r + p->i"), (1, "dirout", "g->r", 0, "p->i * 4"), (2, "dat", None, None, None), (2, "set", None, None, None)]
    kept = spark.createDataFrame([(1, "c->n = p->i;"), (2, None)], "id int, text string")
    assert [tuple(r) for r in G.bank_models(spark.createDataFrame(bank, places), kept, macros, ["id"]).collect()] == [(1, "p->i", "g->r", 0, None, None, None)]
    assert G.bank_models(spark.createDataFrame([], places), kept, macros, ["id"]).count() == 0


def test_lowered_arrays_leave_other_loops(spark):
    ops = spark.createDataFrame([(1, 1, ("Write", 4, "a", None, None, "c->x", None)), (2, 1, None)], "id int, ord int, op struct<kind:string,width:int,address:string,field:string,var:string,value:string,guard:string>")
    loops = spark.createDataFrame([(1, "for (i = 1; ...)"), (2, None)], "id int, source string")
    got = X.lowered_arrays(ops, loops, ["id"]).collect()
    assert sorted((r.id, r.sub, r.op and r.op.value) for r in got) == [(1, 0, "c->x"), (2, 0, None)]
