"""Text folds, the walk of a function, and state rewriting against plain Python on random and odd input."""

import random
import re

from pyspark.sql import functions as F

from tracewell.functions import cexpr as X
from tracewell.functions import folds
from tracewell.operators import extraction as W
from tracewell.operators import summaries as S
from tracewell.operators import syntax
from tracewell.sources import reports as R

r = random.Random(12)


def test_names_are_replaced_as_in_python(spark):
    texts = ["".join(r.choice(["a", "b1", "->", ".", " ", "+", "0x1f", "(", ")", "9a", "_c", "é", "-", ">"]) for _ in range(r.randint(0, 14))) for _ in range(200)] + [None, ""]
    maps = [{n: r.choice(["X", "y + 1", "", "a"]) for n in r.sample(["a", "b1", "_c", "zz"], r.randint(0, 4))} for _ in texts]
    maps[-3] = None
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(zip(texts, maps))], "i int, t string, m map<string,string>")
    got = {x["i"]: x["s"] for x in df.select("i", folds.substituted(F.col("t"), F.col("m")).alias("s")).collect()}
    # a name next to a letter beyond ASCII is one word to Python only
    for i, (t, m) in enumerate(zip(texts, maps)):
        if t is None or not re.search(r"\wé|é\w", t):
            assert got[i] == (X.substitute(t, m or {}) if t is not None else None), (t, m)
    one = spark.range(1).select(folds.with_macros(F.lit("A + p->A - N"), F.create_map(F.lit("A"), F.lit(31).cast("long"), F.lit("N"), F.lit(-2).cast("long"))).alias("x"))
    assert one.first()["x"] == "0x1f + p->A - -2"


def guards():
    return r.choice([[], ["g"], ["h", "!k"], ["!(g)"], ["x"]])


def test_merges_equal_python(spark):
    returns = [[(r.choice(["0", "-E", "v"]), guards(), r.random() < 0.9) for _ in range(r.randint(0, 4))] for _ in range(150)] + [[("1", [" "], True), ("0", [], True)], None]
    pointers = [[(r.choice(["p", "q + 4"]), guards()) for _ in range(r.randint(0, 5))] for _ in range(150)] + [None]
    changes = [[(r.choice(["=", "|=", "<<="]), r.choice(["1", " m "]), guards()) for _ in range(r.randint(0, 5))] for _ in range(150)] + [None]
    branches = [[(r.choice([[], ["A"], ["B", "C"]]), [(r.choice(["=", "|="]), "1") for _ in range(r.randint(0, 2))]) for _ in range(r.randint(0, 4))] for _ in range(150)] + [None]

    def column(rows, kind, f):
        df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}")
        return [x["y"] for x in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]

    assert column(returns, "array<struct<t:string,g:array<string>,p:boolean>>", folds.returned) == [X.returned_value(x) for x in returns]
    assert column(pointers, "array<struct<t:string,g:array<string>>>", folds.pointer_value) == [X.pointer_value(x) for x in pointers]
    for initial in (None, "", "a + 1"):
        assert column(changes, "array<struct<o:string,t:string,g:array<string>>>", lambda c: folds.updated_value(F.lit("v"), F.lit(initial).cast("string"), c)) == [X.updated_value("v", initial, x) for x in changes]
    assert column(branches, "array<struct<l:array<string>,c:array<struct<o:string,t:string>>>>", lambda c: folds.switched_value(F.lit("v"), F.lit("s"), c)) == [X.switched_value("v", "s", x) for x in branches]


STATEMENTS = "unit string, node long, ord long, parent long, branch string, kind string, text string, event string, name string, args array<string>, lhs string, op string, value string"


def walk_in_python(units, params, entries, depth):
    """Operations by recursive descent over statements that only read, write constants, wait, call and return."""
    def frames(tree, i, exits):
        out, up = [], i
        while up is not None:
            s = tree[up]
            if s["kind"] in ("while",) and s["text"]:
                out.insert(0, s["text"])
            p = tree.get(s["parent"])
            if p and p["kind"] == "if" and p["text"]:
                out.insert(0, p["text"] if s["branch"] == "then" else f"!({p['text']})")
            up = s["parent"]
        return [g for at, g in reversed(exits) if at < i] + out

    def own(unit):
        tree, exits, rows = units[unit], [], []
        for i, s in sorted(tree.items()):
            if s["parent"] is None and s["kind"] == "if" and any(c["parent"] == i and c["kind"] == "return" for c in tree.values()):
                last = max(j for j in tree if j == i or tree[j]["parent"] == i)
                gone = {c["branch"] for c in tree.values() if c["parent"] == i and c["kind"] == "return"}
                if re.fullmatch(r"[ab!]+", s["text"]):
                    no = s["text"][1:] if s["text"].startswith("!") else f"!({s['text']})"
                    left = [g for b, g in (("then", f"(({s['text']}))"), ("else", f"(({no}))")) if b not in gone]
                    exits.append((last, " || ".join(left) if left else "0"))
            if s["parent"] is None and s["kind"] == "return":
                exits.append((i, "0"))
        for i, s in sorted(tree.items()):
            if s["event"]:
                rows.append((i, s, frames(tree, i, exits)))
        return rows

    def put(text, m):
        return X.substitute(text, m) if text is not None else None

    def ops(unit, d):
        out = []
        for i, s, g in own(unit):
            if s["event"] == "return":
                out.append(((i,), "Return", None, s["value"], g))
            elif s["name"] == "readl":
                out.append(((i,), "Read", s["args"][0], None, g))
            elif s["name"] == "writel":
                out.append(((i,), "Write", s["args"][1], s["args"][0], g))
            elif s["name"] in units and s["name"] != unit and s["name"] not in entries and d > 0:
                m = dict(zip(params[s["name"]], s["args"]))
                out += [((i, *p), k, put(a, m), put(v, m), g + [put(x, m) for x in h]) for p, k, a, v, h in ops(s["name"], d - 1) if k != "Return"]
        return out

    return {u: sorted(ops(u, depth)) for u in units}


def test_the_walk_equals_recursion(spark):
    units, params, rows = {}, {}, []
    names = [f"f{k}" for k in range(12)]
    for u in names:
        tree, params[u] = {}, ["a", "b"]
        for i in range(r.randint(1, 14)):
            inner = [j for j in tree if tree[j]["kind"] in ("if", "while") and tree[j]["parent"] is None]
            parent = r.choice(inner) if inner and r.random() < 0.5 else None
            if parent is not None and parent != max(j for j in tree if tree[j]["parent"] is None):
                parent = None  # children follow their parent
            kind = r.choice(["expr"] * 5 + ["return"] + (["if", "while"] if parent is None else []))
            s = dict(unit=u, node=i, ord=i, parent=parent, branch=None, kind=kind, text=None, event=None, name=None, args=None, lhs=None, op=None, value=None)
            if parent is not None:
                s["branch"] = r.choice(["then", "else"]) if tree[parent]["kind"] == "if" else "body"
            if kind in ("if", "while"):
                s["text"] = r.choice(["a", "!b", "p->x", "b"])
            if kind == "return":
                s.update(event="return", value=f"a + {i}")
            if kind == "expr":
                call = r.choice(["readl", "writel", *r.sample(names, 2), "unknown"])
                args = {"readl": [f"a + R{i}"], "writel": [f"b | {i}", f"p->b + R{i}"]}.get(call, [r.choice(["x", "a", "q->a"])] + ([f"y{i}"] if r.random() < 0.7 else []))
                s.update(event="call", name=call, args=args, lhs=f"v{i}" if call == "readl" else None)
            tree[i] = s
        # the place in pre-order is the node's number only if then comes before else
        order, out = {None: [i for i in tree if tree[i]["parent"] is None]}, []
        for i in order[None]:
            out += [i] + sorted((j for j in tree if tree[j]["parent"] == i), key=lambda j: j)
        units[u] = {k: {**tree[i], "node": k, "ord": k, "parent": out.index(tree[i]["parent"]) if tree[i]["parent"] is not None else None} for k, i in enumerate(out)}
        rows += [tuple(x[c.split()[0]] for c in STATEMENTS.split(", ")) for x in units[u].values()]
    at = syntax.intervals(spark.createDataFrame(rows, STATEMENTS), "unit")
    p = spark.createDataFrame(list(params.items()), "unit string, params array<string>")
    e = spark.createDataFrame([("f3",)], "unit string")
    for depth in (0, 2):
        got = {u: [] for u in units}
        for x in W.walk(at, p, "unit", e, depth).collect():
            got[x["unit"]].append((tuple(x["path"]), x["kind"], x["address"], x["value"], [f["guard"] for f in x["frames"]]))
        assert {u: sorted(v) for u, v in got.items()} == walk_in_python(units, params, {"f3"}, depth)
    assert W.walk(at.where("false"), p, "unit").count() == 0


def test_stores_frames_and_contracts_on_odd_rows(spark):
    a = spark.createDataFrame([("u", 2, "y", "x + N"), ("u", 1, "x", "base"), ("u", 3, "x", "f(y)"), ("u", 4, None, "1"), ("u", 5, "z", None), ("u", 6, "base", "y"), ("w", 1, "x", "x->x + x")], "unit string, ord long, name string, text string")
    seeds = spark.createDataFrame([("u", "base"), ("u", "base"), ("v", "p"), ("u", None)], "unit string, name string")
    macros = spark.createDataFrame([("u", "N", 16), ("u", "M", None)], "unit string, name string, value long")
    got = {(x["unit"], x["name"]): x["expr"] for x in S.base_store(a, seeds, macros, "unit").collect()}
    assert got == {("u", "base"): "base + 0x10", ("u", "x"): "base", ("u", "y"): "base + 0x10", ("v", "p"): "p", ("w", "x"): "x->x + x"}
    frame = ("loop", "while", "sizeof ( struct x_devids )", "", None, None, None)
    ops = spark.createDataFrame([("k", 1, "virtqueue_get_buf", "p", None), ("k", 2, None, "p", [frame, (None, None, None, None, None, None, None)]), ("j", 1, "virtqueue_get_buf", "p", [frame])], f"key string, ord int, queue_operation string, prefix string, frames {S.LOOP_FRAMES}")
    got = {(x["key"], x["ord"]): x["frames"] for x in S.bounded_loop_frames(ops, ["key"]).collect()}
    assert got["k", 1] is None and got["k", 2][0]["guard"] == "8" and got["k", 2][1]["guard"] == "" and got["j", 1][0]["guard"] == "__virtio_i < vi->p_completed"
    nodes = spark.createDataFrame([("d", "m", None, None, None, None, None, None, None, None), ("e", "m", "StateRead", None, None, None, "linux.virtqueue", None, None, None)], "d string, m string, kind string, addr_kind string, lowerable boolean, origin string, contract string, summary string, reliability string, bounded boolean")
    modules, drivers = S.contract_verdicts(nodes, "d", "m")
    assert {x["d"]: (x["gpio"], x["sdhci"]) for x in modules.collect()} == {"d": (False, False), "e": (False, False)}
    assert {x["d"]: (x["accessor_only"], x["state_only"]) for x in drivers.collect()} == {"d": (False, False), "e": (False, True)}
    facts = spark.createDataFrame([("k", "s.c")], "k string, source string").select("*", *[F.expr(f"cast(array() AS array<{t}>)").alias(n) for n, t in (("includes", "string"), ("structs", "struct<name:string,fields:array<struct<name:string,ctype:string>>>"), ("constants", "struct<name:string,value:bigint>"), ("callbacks", "struct<name:string,function:string>"), ("resources", "struct<name:string,acquisition:string,binds_to:string>"), ("error_paths", "string"), ("helper_calls", "string"), ("snippets", "struct<name:string,calls:array<string>>"))])
    assert R.facts_text(facts, "k").first()["text"] == "source: s.c"
