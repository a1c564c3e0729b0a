"""Syntax, control flow, paths, propagation, pointers, automata and places against brute force and on odd input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.functions import cexpr
from tracewell.operators import automata as M
from tracewell.operators import facts as P
from tracewell.operators import graphs as G
from tracewell.operators import paths
from tracewell.operators import pointers as A
from tracewell.operators import syntax as X
from tracewell.operators import variants as V
from tracewell.sources import code as K
from tracewell.sources import places as L

NODE = "unit string, node long, ord long, parent long, branch string, kind string, text string, extra int"


def node(unit, i, parent, branch, kind, text=None):
    return (unit, i, i, parent, branch, kind, text, 0)


def test_intervals_of_odd_trees(spark):
    deep = [node("deep", i, i - 1 if i else None, None, "expr") for i in range(70)]
    wide = [node("wide", i, None if i == 0 else 0, None, "expr") for i in range(9000)]
    lost = [node("lost", 1, 99, None, "expr"), node("lost", 2, 1, None, "expr"), node("lost", 3, None, None, "expr"), node(None, 1, None, None, "expr")]
    df = spark.createDataFrame(deep + wide + lost, NODE)
    got = {(r["unit"], r["node"]): (r["pre"], r["last"], r["depth"]) for r in X.intervals(df, "unit").collect()}
    assert all(got["deep", i] == (i, 69, i) for i in range(70))
    assert got["wide", 0] == (0, 8999, 0) and all(got["wide", i] == (i, i, 1) for i in range(1, 9000))
    assert X.intervals(df.where("false"), "unit").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        X.intervals(spark.createDataFrame([node("c", 1, 2, None, "expr"), node("c", 2, 1, None, "expr")], NODE), "unit")


def test_running_totals_over_blocks(spark):
    r = random.Random(1)
    rows = [(k, i, r.randint(-5, 9)) for k in ("a", None) for i in r.sample(range(200), 90)]
    got = X.running_total(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", "v", "t", block=16).collect()
    assert {(x["k"], x["o"]): x["t"] for x in got} == {(k, o): sum(v for k2, o2, v in rows if k2 == k and o2 < o) for k, o, _ in rows}


def test_guards_of_a_function_with_every_kind_of_exit(spark):
    rows = [
        node("f", 0, None, None, "if", "n == 0"), node("f", 1, 0, "then", "return"), node("f", 2, 0, "else", "if", "!m"), node("f", 3, 2, "then", "expr"), node("f", 4, 2, "else", "return"),
        node("f", 5, None, None, "switch", "n"), node("f", 6, 5, "body", "case", "1"), node("f", 7, 5, "body", "return"), node("f", 8, 5, "body", "case", "2"), node("f", 9, 5, "body", "break"),
        node("f", 10, None, None, "if", "p->x"), node("f", 11, 10, "then", "return"), node("f", 12, None, None, "while", "m"), node("f", 13, 12, "body", "goto", "out"), node("f", 14, None, None, "expr"),
        node("f", 15, None, None, "label", "out"), node("f", 16, None, None, "return"), node("f", 17, None, None, "goto", "nowhere"),
    ]
    at = X.intervals(spark.createDataFrame(rows, NODE), "unit")
    params = spark.createDataFrame([("f", ["n", "m"])], "unit string, params array<string>")
    got = {(r["after"], r["before"], r["guard"], r["source"]) for r in X.continuation_guards(at, params, "unit").collect()}
    assert got == {(4, None, "((!(n == 0)) && (!m))", "early-exit"), (9, None, "!((n == 1))", "switch-exit"), (16, None, "0", "early-exit"), (13, 15, "!((m))", "forward-goto")}
    assert {r["node"] for r in X.modeled_transfers(at, params, "unit").collect()} == {1, 4, 7, 13, 16}
    edges = {(r["src"], r["dst"], r["kind"]) for r in X.cfg_edges(at, "unit").collect()}
    assert {(0, 1, "branch-true"), (2, 4, "branch-false"), (3, 5, "fallthrough"), (9, 10, "break"), (12, 13, "loop-body"), (13, 15, "goto-forward"), (17, None, "goto"), (-1, 0, "entry"), (16, -2, "return")} <= edges
    none = at.where("false")
    assert X.cfg_edges(none, "unit").count() == X.continuation_guards(none, params, "unit").count() == X.control_frames(none, "unit", F.lit(True)).count() == 0


def brute_dominators(edges, entry):
    succ = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)

    def reached(without):
        seen, todo = set(), [entry] if entry != without else []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for b in succ.get(n, ()) if b != without]
        return seen

    live = reached(None)
    return {n: {d for d in live if d == n or n not in reached(d)} for n in live}


def test_dominators_loops_and_components_of_random_graphs(spark):
    r = random.Random(4)
    graphs = {g: {(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(r.randint(1, 20))} | {("n0", "n1")} for g in range(25)}
    df = spark.createDataFrame([(g, a, b, "n0") for g, e in graphs.items() for a, b in e for _ in (0, 1)], "g int, a string, b string, entry string")
    tree = G.dominators(df, "g", "a", "b", "entry").collect()
    back = {(x["g"], x["src"], x["dst"]) for x in G.backedges(df, spark.createDataFrame(tree), "g", "a", "b").collect()}
    loops = {(x["g"], x["header"], x["node"]) for x in G.natural_loops(df, G.backedges(df, spark.createDataFrame(tree), "g", "a", "b"), "g", "a", "b").collect()}
    for g, e in graphs.items():
        dom = brute_dominators(e, "n0")
        got = {x["node"]: (x["idom"], x["dom_size"]) for x in tree if x["g"] == g}
        assert got == {n: (max(d - {n}, key=lambda m: len(dom[m]), default=None), len(d)) for n, d in dom.items()}
        want = {(g, a, b) for a, b in e if a in dom and b in dom[a]}
        assert want == {x for x in back if x[0] == g}
        for h in {b for _, _, b in want}:
            body, todo = {h}, [a for _, a, b in want if b == h]
            while todo:
                n = todo.pop()
                if n not in body:
                    body.add(n)
                    todo += [a for a, b in e if b == n]
            assert body == {n for k, head, n in loops if (k, head) == (g, h)}
    nodes = spark.createDataFrame([(f"{g}{a}", f"{g}{b}") for g, e in graphs.items() for a, b in e] + [(None, "x")], "a string, b string")
    got = {x["node"]: x["component"] for x in G.components(nodes, "a", "b").collect()}
    for g, e in graphs.items():
        names = {n for p in e for n in p}
        reach = {n: set(brute_dominators(e, n)) for n in names}
        assert {n: got[f"{g}{n}"] for n in names} == {n: f"{g}" + max(m for m in names if m in reach[n] and n in reach[m]) for n in names}
    assert G.components(nodes.where("false"), "a", "b").count() == 0


def test_paths_are_never_called_infeasible_wrongly(spark):
    r = random.Random(2)

    def term(deep=2):
        k = r.randrange(8 if deep else 5)
        v, c = r.choice("ab"), r.randrange(12)
        if k < 3:
            return f"{v} {r.choice(['==', '!=', '<', '>', '<=', '>='])} {c}"
        if k == 3:
            return f"({v} & {r.choice([1, 3, 4, 6])}) {r.choice(['==', '!='])} {r.randrange(5)}"
        if k == 4:
            return r.choice([v, f"!{v}", f"!({v} & 2)", f"{c} < {v}", "1", "a + b == 3"])
        inner = f"({term(deep - 1)}) {r.choice(['&&', '||'])} ({term(deep - 1)})"
        return f"!({inner})" if k == 7 else inner

    sets = [[term() for _ in range(r.randint(0, 3))] for _ in range(300)] + [None, [None], ["a == b"], [""], ["x->y == 1", "x->y == 2"], ["0x10 == a", "a < 0x10"], ["a >= 18446744073709551615", "a != 18446744073709551615"]]
    got = paths.decided(spark.createDataFrame(list(enumerate(sets)) + [(0, sets[0])], "id int, guards array<string>")).collect()
    assert len(got) == len(sets) + 1
    status = {x["id"]: x["status"] for x in got}
    for i, s in enumerate(sets[:300]):
        trees = [cexpr.parse(g) for g in s]
        able = any(all(cexpr.evaluate(t, {"a": a, "b": b}) for t in trees) for a in range(40) for b in range(40))
        assert status[i] == "unknown" or (status[i] == "satisfiable") == able, (s, status[i])
    assert Counter(list(status.values())[:300])["unknown"] < 60
    assert [status[300 + k] for k in range(7)] == ["satisfiable", "satisfiable", "unknown", "unknown", "infeasible", "infeasible", "infeasible"]


def test_operations_are_carried_with_arguments_and_cycles_end(spark):
    functions = spark.createDataFrame([(x,) for x in "abcd"], "symbol string")
    ops = spark.createDataFrame([("c", 1, "Write", 0, None), ("c", 2, "Read", None, "fixed"), ("b", 3, "Write", 1, None), ("d", 1, "Read", None, "d")], "symbol string, pos int, kind string, param int, text string")
    calls = spark.createDataFrame([("a", 1, "b", [(None, "x"), (0, None)]), ("b", 5, "c", [(1, None)]), ("b", 6, "c", []), ("c", 9, "b", [(None, "z")]), ("a", 2, "a", []), ("a", 3, "gone", [])], "caller string, pos int, callee string, args array<struct<param:int,text:string>>")
    rows, totals = G.summaries(functions, ops, calls, 2)
    of = lambda df, s: sorted((x["path"], x["kind"], x["param"], x["text"]) for x in df.collect() if x["symbol"] == s)
    assert of(rows, "a") == [([1, 3], "Write", 0, None), ([1, 5, 1], "Write", 0, None), ([1, 5, 2], "Read", None, "fixed"), ([1, 6, 1], "Write", None, "?"), ([1, 6, 2], "Read", None, "fixed")]
    assert totals[0] == (0, 4, 4) and len(totals) == 3 and G.summary_propagation(ops.groupBy("symbol").count().select("symbol", F.col("count").alias("own_ops")).union(spark.createDataFrame([("a", 0)], "s string, n long")), calls, 2).collect()[-1]["total_ops"] == totals[-1][2]
    rows, totals = G.summaries(functions, ops, calls, None)
    assert of(rows, "c") == [([1], "Write", 0, None), ([2], "Read", None, "fixed")] and of(rows, "a") == [([1, 3], "Write", 0, None)] and len(totals) <= 4
    assert G.summaries(functions, ops.where("false"), calls.where("false"), None)[0].count() == 0


def test_points_to_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice(["address", "copy", "load", "store"]), f"v{r.randrange(12)}", f"v{r.randrange(12)}") for _ in range(40)] + [("copy", "v1", "v2"), ("copy", "v2", "v1"), ("address", None, "v1")]
    pts = {f"v{k}": set() for k in range(12)}
    for _ in range(60):
        for kind, a, b in rows:
            if a is None:
                continue
            if kind == "address":
                pts[a] |= {b}
            elif kind == "copy":
                pts[a] |= pts[b]
            elif kind == "load":
                for o in list(pts[b]):
                    pts[a] |= pts[o]
            else:
                for o in list(pts[a]):
                    pts[o] |= pts[b]
    df = spark.createDataFrame(rows, "kind string, left string, right string")
    got = A.points_to(df)
    assert {(x["pointer"], x["object"]) for x in got.collect()} == {(p, o) for p, os in pts.items() for o in os} and got.count() == sum(map(len, pts.values()))
    named = {(x["pointer"], x["origin"]) for x in A.aliases(got, spark.createDataFrame([("v1",)], "pointer string")).collect()}
    assert named == {(p, "v1") for p in pts if p != "v1" and pts[p] & pts["v1"]}
    assert A.points_to(df.where("false")).count() == 0


def best_of(variants, trace):
    best = None
    for v in variants:
        k = 0
        for t in trace:
            k += k < len(v) and v[k] == t
        best = max(filter(None, (best, (k == len(v), k, k - len(v)))))
    return best


def test_automata_match_as_all_variants_do(spark):
    r, rows, count = random.Random(8), [], 0

    def build(m, parent, depth, branch, n):
        nonlocal count
        for o in range(n):
            i, count = count, count + 1
            kind = r.choice(["Read", "Write", "ReadModifyWrite", "Cond", "Seq", "Loop", "Delay", None] if depth < 3 else ["Read", "Write"])
            rows.append((m, i, parent, depth, branch, o, kind, r.choice([None if r.random() < 0.1 else 4, 8, 12]) if kind in ("Read", "Write", "ReadModifyWrite") else None))
            for b in {"Cond": ("then", "else"), "Seq": ("body",), "Loop": ("body",)}.get(kind, ()):
                build(m, i, depth + 1, b, r.randint(0, 2))

    for m in range(30):
        build(m, None, 0, "body", r.randint(1, 4))
    schema = "module int, node_id int, parent_id int, depth int, branch string, ord int, kind string, offset long"
    many = [(99, 3 * k + j, None if j == 0 else 3 * k, 0 if j == 0 else 1, ("body", "then", "else")[j], k if j == 0 else 0, "Cond" if j == 0 else "Read", None if j == 0 else k * 2 + j) for k in range(30) for j in range(3)]
    nodes = spark.createDataFrame(rows + many, schema)
    listed = {x["module"]: x for x in V.branch_variants(nodes, ["module"]).collect()}
    automata = M.automata(nodes, ["module"])
    assert {x["module"]: x["traceable"] for x in automata.collect()} == {m: x["traceable"] for m, x in listed.items()} and listed[99]["too_many"]
    traces = [(m, i, [(r.choice("RW"), r.choice([4, 8, 12])) for _ in range(r.randint(0, 8))]) for m in range(30) for i in range(8)]
    traces += [(99, 0, [("R", k * 2 + 1 + k % 2) for k in range(30)]), (99, 1, [("R", k * 2 + 1) for k in range(29)])]
    df = spark.createDataFrame(traces, "module int, i int, actual array<struct<kind:string,offset:bigint>>")
    got = {(x["module"], x["i"]): x["m"] for x in df.join(automata, "module").where("positions IS NOT NULL").select("module", "i", M.matched(F.col("actual"), F.col("positions"), F.col("shortest")).alias("m")).collect()}
    for m, i, trace in traces[:-2]:
        vs = [[(a["kind"], a["offset"]) for a in v] for v in listed[m]["variants"]]
        assert (tuple(got[m, i])[:2] + (-got[m, i]["missing"],) if (m, i) in got else None) == best_of(vs, trace)
    assert tuple(got[99, 0]) == (True, 30, 0) and tuple(got[99, 1]) == (False, 29, 1)
    assert M.automata(nodes.where("false"), ["module"]).count() == 0


def test_alignment_over_blocks_equals_the_fold(spark):
    r, logs, calls, want = random.Random(9), [], [], {}
    for g in range(30):
        names, asked, at = [r.choice("abc") for _ in range(r.randint(0, 60))], [r.choice("abc") for _ in range(r.randint(1, 20))], 0
        logs += [(g, i + 1, x) for i, x in enumerate(names)]
        calls += [(g, i + 1, x) for i, x in enumerate(asked)]
        for i, x in enumerate(asked):
            at = next((j + 1 for j in range(at, len(names)) if names[j] == x), None) if at is not None else None
            want[g, i + 1] = at
    c, s = spark.createDataFrame(calls, "log int, call_no int, name string"), spark.createDataFrame(logs, "log int, seg long, name string")
    assert {(x["log"], x["call_no"]): x["seg"] for x in M.aligned(c, s, "log").collect()} == want
    points = s.select("log", "name", F.col("seg").alias("at"))
    near = {(x["log"], x["name"], x["at"]): x["next"] for x in M.next_occurrence(points, points, ["log", "name"], block=4).collect()}
    assert near == {(g, n, p): min((q for h, q, m in logs if (h, m) == (g, n) and q > p), default=None) for g, p, n in logs}
    assert M.aligned(c.where("false"), s, "log").count() == 0 and M.aligned(c, s.where("false"), "log").where("seg IS NOT NULL").count() == 0


def test_places_of_odd_texts(spark):
    texts = {"a": "été\nx = f(1);\n\n\U0001f642 tail", "b": "", "c": None, "d": "\n" * 700 + "end"}
    files = spark.createDataFrame(list(texts.items()), "key string, text string")
    refs = [("a", 0, 5), ("a", 0, 1), ("a", 6, 7), ("a", 17, 21), ("a", 3, 2), ("a", None, 2), ("b", 0, 0), ("c", 0, 1), ("gone", 0, 1), ("d", 700, 703), ("d", 300, 301)]
    got = [tuple(x) for x in L.source_slices(files, spark.createDataFrame(refs, "key string, begin long, end long"), "key").select("key", "begin", "end", "slice", "line", "column").collect()]
    assert Counter(got) == Counter([("a", 0, 5, "été", 1, 1), ("a", 0, 1, "�", 1, 1), ("a", 6, 7, "x", 2, 1), ("a", 17, 21, "\U0001f642", 4, 1), ("a", 3, 2, "", None, None), ("a", None, 2, "", None, None), ("b", 0, 0, "", 1, 1), ("c", 0, 1, "", None, None), ("gone", 0, 1, "", None, None), ("d", 700, 703, "end", 701, 1), ("d", 300, 301, "\n", 301, 1)])
    assert [(x["line"], x["column"], x["callee"], x["assigned"]) for x in L.source_calls(files, "key").collect()] == [(2, 5, "f", "x")]


def brute_states(lines):
    out, state = [], 0
    for t in lines:
        out.append(state)
        i = 0
        while i < len(t):
            if state:
                mark = '"""' if state == 1 else "'''"
                j = t.find(mark, i)
                if j < 0:
                    break
                i, state = j + 3, 0
            elif t.startswith('"""', i) or t.startswith("'''", i):
                state, i = (1 if t[i] == '"' else 2), i + 3
            elif t[i] == "#":
                break
            elif t[i] in "\"'":
                j = i + 1
                while j < len(t) and t[j] != t[i]:
                    j += 2 if t[j] == "\\" else 1
                i = j + 1
            else:
                i += 1
    return out


def test_line_states_equal_a_scan(spark):
    r = random.Random(6)
    piece = ['"""', "'''", '"', "'", "#", "a", " ", "\\", '""', "x = 1"]
    files = {k: ["".join(r.choice(piece) for _ in range(r.randint(0, 7))) for _ in range(60)] for k in range(12)}
    rows = [(k, i, t) for k, ls in files.items() for i, t in enumerate(ls)]
    got = K.line_states(spark.createDataFrame(rows, "k int, line int, text string"), "k", block=8)
    assert {(x["k"], x["line"]): x["state"] for x in got.collect()} == {(k, i): s for k, ls in files.items() for i, s in enumerate(brute_states(ls))}
    c = [(1, 0, "a /* b"), (1, 1, "c */ d // */"), (1, 2, None), (1, 3, 's = "/*"; e')]
    assert [(x["line"], x["code"]) for x in K.code_lines(spark.createDataFrame(c, "k int, line int, text string"), "k", K.C).orderBy("line").collect()] == [(0, "a /* b"), (1, " d "), (2, ""), (3, 's = "/*"; e')]


def test_names_are_found_by_join(spark):
    symbols = spark.createDataFrame([(1, "load @my_base_1"), (2, None), (3, "x = ioremap(y)"), (4, "mybase"), (5, "")], "id int, ir string")
    names = spark.createDataFrame([("base",), ("my_base",), (None,)] + [(f"g{k}",) for k in range(12000)], "name string")
    assert sorted(r["id"] for r in P.mapping_origins(symbols, names).collect()) == [1, 3, 4]
    files = spark.createDataFrame([("f", "a\nMy_Dev; my_dev2\nmy_dev"), ("g", "xmy_dev my_devx"), ("h", None)], "path string, text string")
    ids = spark.createDataFrame([("my_dev",), ("dev",), ("--",), ("a",)], "identifier string")
    assert {tuple(r) for r in P.identifier_hits(files, ids, "path").collect()} == {("f", "my_dev", 2), ("f", "dev", 2), ("f", "a", 1), ("g", "dev", 1)}
