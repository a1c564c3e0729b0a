"""Log and program sources, branch variants and trace verdicts on small cases with known results."""

import json

from tracewell.operators import variants as V
from tracewell.sources import logs, programs


def at(kind, register):
    return {kind: {"addr": {"Symbolic": {"register": register}}}}


DOC = json.dumps({
    "register_map": [{"name": "STATUS", "offset": 4}, {"name": "CONTROL", "offset": 8}, {"name": "DATA", "offset": 16}],
    "modules": [
        {"name": "probe", "ops": [at("Read", "STATUS"), at("Write", "CONTROL")]},
        {"name": "callback", "ops": [at("ReadModifyWrite", "DATA")]},
        {"name": "conditional", "ops": [{"Cond": {"then_ops": [at("Write", "DATA")]}}, {"Cond": {"then_ops": [at("Write", "CONTROL")]}}]},
        {"name": "lost", "ops": [{"Seq": {"ops": [at("Read", "NONE"), {"Loop": {"ops": [at("Read", "NONE")]}}, {"Write": {"addr": {"Fixed": {"offset": 32}}}}]}}]},
        {"name": "loop", "ops": [{"Loop": {"ops": [at("Read", "NONE")]}}]},
        {"name": "none", "ops": []},
    ],
})


def variants(spark):
    df = spark.createDataFrame([("d", DOC), ("bad", "{"), ("null", None)], "doc string, text string")
    nodes = programs.placed(programs.op_nodes(df, "doc"), programs.register_map(df, "doc"), "doc")
    return V.branch_variants(nodes, ["doc", "module"])


def test_branch_variants(spark):
    got = {r["module"]: ([[tuple(a) for a in v] for v in r["variants"]], r["traceable"]) for r in variants(spark).collect()}
    assert got == {
        "probe": ([[("R", 4), ("W", 8)]], True),
        "callback": ([[("R", 16), ("W", 16)]], True),
        "conditional": ([[("W", 16), ("W", 8)], [("W", 16)], [("W", 8)]], True),
        "lost": ([[("W", 32)]], False),
        "loop": ([], True),
        "none": ([], True),
    }


def test_trace_verdicts(spark):
    both = "[rhfn] runtime_probe\n[rh] R 0x4\n[rh] W 0x8\n[rhfn] runtime_callback\nx [rh] R 0x10 y\n[rh] W 0x10"
    cases = [
        ("ok", both, ["probe=runtime_probe", "callback=runtime_callback"], "ok", 2, 4, 3),
        ("branch", "[rhfn] runtime_conditional\n[rh] W 0x10", ["conditional=runtime_conditional"], "ok", 1, 1, 1),
        ("reuse", both, ["probe=runtime_probe", "callback=runtime_callback", "callback=runtime_callback"], "missing", 2, 4, 3),
        ("exact", "[rhfn] runtime_probe__callback\n[rh] R 0x4\n[rh] W 0x8", ["probe=runtime_probe"], "missing", 0, 0, 0),
        ("unknown", both, ["absent=runtime_probe"], "unknown module", 0, 0, 0),
        ("lost", both, ["lost=runtime_probe"], "untraceable", 0, 0, 0),
        ("bare", "[rh] R 0x4", ["probe=runtime_probe"], "no segments", 0, 0, 0),
    ]
    files = spark.createDataFrame([(n, t) for n, t, *_ in cases], "log string, text string")
    calls = spark.createDataFrame([(n, k, *c.split("=")) for n, _, cs, *_ in cases for k, c in enumerate(cs, 1)], "log string, call_no int, formal string, runtime string")
    events = logs.trace_events(logs.lines(files, "log"), "log")
    v = variants(spark)
    got = V.verdicts(V.match_calls(events, calls, v, "log"), v, events, "log").collect()
    assert {r["log"]: (r["verdict"], r["passed"], r["ops_matched"], r["registers_matched"]) for r in got} == {n: tuple(rest) for n, _, _, *rest in cases}


def test_reports(spark):
    text = "generation_readiness:\n ris_quality: 0.5\n ris_quality: 0.75\n ready: True\nblockers:\n - a: b\n - c"
    df = spark.createDataFrame([("x", text), ("y", "blockers: []\n- z"), ("z", None)], "f string, text string")
    got = {(r["f"], r["name"]): (r["value"], r["blockers"]) for r in logs.scores(logs.lines(df, "f"), "f").collect()}
    assert got == {("x", "ris_quality"): ("0.75", ["a: b", "c"]), ("x", "ready"): ("True", ["a: b", "c"]), ("y", None): (None, [])}
    line = "driver metrics: 3 ops | symbolic 2 fixed 1 computed 0 | rmw 1 unknown_value 0 | cond 4 loop 5 | pct_symbolic 66.7 pct_non_top None | clang_diag 0 | regs 7\nmore"
    m = logs.metrics(spark.createDataFrame([("x", line)], "f string, text string"), "f").first()
    assert (m["ops"], m["loops"], m["pct_symbolic"], m["pct_non_top"], m["registers"]) == (3, 5, 66.7, None, 7)


def test_build_commands_and_older_listings(spark):
    df = spark.createDataFrame([("x", "a\nsavedcmd_d/x.o := gcc -c x.c ; rm y\ncmd_z := no"), ("y", "none")], "f string, text string")
    assert [r[0] for r in df.orderBy("f").select(logs.build_command(df["text"])).collect()] == ["gcc -c x.c", None]
    device = spark.createDataFrame([("x", "register A: B4 at base + 0x10\nregister B: B4 at base + 0x14")], "f string, text string")
    listing = spark.createDataFrame([("x", "module m {\n    R(B4, d.A)\n    RMW(B4, d.B) -- W(B4, d.A)\n    W(B4, d[0x20])\n    R(B4, d.C)\n  }\nmodule n {\n    nothing\n  }")], "f string, text string")
    got = logs.listed_modules(listing, logs.register_offsets(device, "f"), "f").collect()
    assert [(r["module"], [tuple(o) for o in r["ops"]]) for r in got] == [("m", [("R", 16), ("R", 20), ("W", 20), ("W", 32)])]
