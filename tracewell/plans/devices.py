"""Queries of extraction, backend binds, callback plans, holdout contexts and source models of devices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.batches import spread
from tracewell.operators import backends as B
from tracewell.operators import banks as G
from tracewell.operators import devices as D
from tracewell.operators import extraction as X
from tracewell.operators import interpreter as I
from tracewell.operators import oracles as O
from tracewell.plans import contracts as C
from tracewell.plans.registry import collector
from tracewell.plans.traces import read

QUERIES, ORACLE_SQL, query = collector()


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- extraction: a function an order, of which every third has a guarded change -------

@query("""WITH b AS (SELECT o_orderkey AS k, 'REG_' || o_orderkey % 5 AS r, 'REG_' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 ELSE 9 END AS w, o_custkey AS c FROM orders),
o AS (SELECT k, unnest([
 {'ord': 1, 'kind': 'Read', 'address': r, 'width': 4, 'var': 'v', 'value': NULL},
 CASE WHEN k % 2 = 0 THEN {'ord': 4, 'kind': 'ReadModifyWrite', 'address': w, 'width': 4, 'var': 'v', 'value': CASE WHEN k % 3 = 0 THEN '(((on)) ? ((v & (~2))) : ((v | (' || c || '))))' ELSE '((v | (' || c || ')) & (~2))' END}
  ELSE {'ord': 4, 'kind': 'Write', 'address': w, 'width': 4, 'var': NULL, 'value': 'v'} END,
 {'ord': 5, 'kind': 'Delay', 'address': NULL, 'width': 0, 'var': NULL, 'value': CAST(1000 * c AS VARCHAR)},
 {'ord': 8, 'kind': 'Write', 'address': 'END', 'width': 2, 'var': NULL, 'value': CASE WHEN k % 3 = 0 THEN '(((sel)) ? (2) : (1))' ELSE '2' END},
 {'ord': 9, 'kind': 'Return', 'address': NULL, 'width': NULL, 'var': NULL, 'value': 'v'}]) AS x FROM b)
SELECT k, x.ord AS ord, x.kind AS kind, x.address AS address, x.width AS width, x.var AS var, x.value AS value FROM o""")
def extracted_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    guard = lambda g: F.when(k % 3 == 0, F.array(F.lit(g))).otherwise(F.array().cast("array<string>"))
    no_args = F.array().cast("array<string>")

    def event(ord: int, what: str, name=none, args=no_args, lhs=none, op=none, text=none, guards=no_args):
        return F.struct(F.lit(ord).alias("ord"), F.lit(what).alias("event"), name.alias("name"), args.alias("args"), lhs.alias("lhs"), op.alias("op"), text.alias("text"), guards.alias("guards"))

    place = _text("REG_", k % 5)
    rows = F.array(
        event(1, "call", F.lit("readl"), F.array(place), F.lit("v")),
        event(2, "assign", lhs=F.lit("v"), op=F.lit("|="), text=F.col("o_custkey").cast("string")),
        event(3, "assign", lhs=F.lit("v"), op=F.lit("&="), text=F.lit("~2"), guards=guard("on")),
        event(4, "call", F.lit("writel"), F.array(F.lit("v"), F.when(k % 2 == 0, place).otherwise("REG_9"))),
        event(5, "call", F.lit("udelay"), F.array(F.col("o_custkey").cast("string"))),
        event(6, "assign", lhs=F.lit("x"), op=F.lit("="), text=F.lit("1")),
        event(7, "assign", lhs=F.lit("x"), op=F.lit("="), text=F.lit("2"), guards=guard("sel")),
        event(8, "call", F.lit("writew"), F.array(F.lit("x"), F.lit("END"))),
        event(9, "return", text=F.lit("v")), event(10, "call", F.lit("helper"), F.array(F.lit("v"))),
    )
    events = read(spark, sf_dir, "orders").select(k.alias("k"), F.inline(rows))
    return X.operations(events, ["k"]).drop("guards")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS yes FROM orders)
SELECT k, yes AND x.i AS "index", x.t AS op FROM (SELECT k, yes, unnest(CASE WHEN yes THEN [{'i': true, 't': 'StateRead|ports_idx|bank|'}, {'i': false, 't': 'Read||loop_state_dir_value|'}, {'i': true, 't': 'StateWrite|ports_ctx_dir||loop_state_dir_value'},
 {'i': true, 't': 'StateRead|ports_ctx_data|loop_state_data|'}, {'i': true, 't': 'StateRead|ports_ctx_dir|loop_state_dir|'}, {'i': false, 't': 'Write|||loop_state_dir | loop_state_data << bank'}]
 ELSE [{'i': false, 't': 'Read||ctx->dir|'}, {'i': false, 't': 'Write|||ctx->dir | ctx->data << g->ports[i].idx'}] END) AS x FROM b)""")
def lowered_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.operators.summaries import operation

    k = F.col("o_orderkey")
    row = lambda o, op: F.struct(F.lit(o).alias("ord"), op.alias("op"))
    ops = read(spark, sf_dir, "orders").select(k.alias("k"), F.inline(F.array(row(1, operation("Read", 4, "A", var="ctx->dir")), row(2, operation("Write", 4, "B", value="ctx->dir | ctx->data << g->ports[i].idx")))))
    text = _text("for (i = 0; i < n; i++) { bank = g->ports[i].idx; *ctx = g->", F.when(k % 3 > 0, "ports").otherwise("others"), "[i].ctx; }")
    got = X.lowered_arrays(ops, read(spark, sf_dir, "orders").select(k.alias("k"), text.alias("source")), ["k"])
    return got.select("k", F.col("index").isNotNull().alias("index"), F.concat_ws("|", "op.kind", *[F.coalesce(f"op.{c}", F.lit("")) for c in ("field", "var", "value")]).alias("op"))


# ---- backends -------------------------------------------------------------------------

_OWNERS = ("irq_chip", "gpio_chip.get", "platform_driver.probe", "private_ops.run", None, "irq_chip.irq_ack")
_ROLES = ("interrupt_ack", "read_config", "probe", "remove", "unknown", "helper", "interrupt_mask")
_NAMES = {b: [(f"{p}.{w}", v) for p, w, v in B.primitives(b)] for b in B.TYPES}


def _pairs(rows) -> str:
    return "[" + ", ".join(f"{{'n': '{n}', 'v': '{v}'}}" for n, v in rows) + "]"


@query(f"""WITH d AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'gpio_controller' ELSE 'other' END AS cls, CASE WHEN s_suppkey % 3 > 0 THEN 'p->regs' END AS base FROM supplier),
f AS (SELECT ps.l_suppkey AS k, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INT) AS ord, {C.sql_pick(_ROLES, 'l_orderkey')} AS role, l_linenumber < 4 AS entry, {C.sql_pick(_OWNERS, 'l_partkey')} AS t FROM lineitem ps),
g AS (SELECT *, entry AND t IS NOT NULL AND role NOT IN ('unknown', 'helper') AND split_part(t, '.', 1) IN ('irq_chip', 'gpio_chip', 'platform_driver') AS pub FROM f),
c AS (SELECT k, ord, CASE WHEN pub THEN CASE WHEN contains(t, '.') THEN t WHEN role = 'interrupt_ack' THEN t || '.irq_ack' WHEN role = 'interrupt_mask' THEN t || '.irq_mask' END WHEN role IN ('probe', 'remove') THEN 'platform_driver.' || role END AS name FROM g),
fixed AS (
 {' UNION ALL '.join(f"SELECT '{b}' AS backend, '{s}' AS section, unnest(generate_series({at}, {at + len(r) - 1}))::INT AS ord, unnest({_pairs(r)}) AS x" for b in B.TYPES for s, at, r in (("type", 1, list(B.TYPES[b].items())), ("primitive", 0, _NAMES[b])))}
 UNION ALL SELECT 'linux', 'include', unnest([0, 1])::INT, unnest([{{'n': '<linux/io.h>', 'v': ''}}, {{'n': '<linux/platform_device.h>', 'v': ''}}]))
SELECT k, backend, section, ord, x.n AS name, x.v AS value FROM d, fixed
UNION ALL SELECT k, b, 'type', 0, 'DeviceState', 'struct dev_' || k || CASE WHEN cls = 'other' THEN '_priv' ELSE '' END FROM d, (SELECT unnest(['linux', 'baremetal', 'harness']) AS b)
UNION ALL SELECT k, b, 'state', 0, 'dev.base', CASE WHEN b = 'linux' THEN coalesce(base, 'g->base') ELSE 'dev->base' END FROM d, (SELECT unnest(['linux', 'baremetal', 'harness']) AS b)
UNION ALL SELECT k, 'linux', 'callback', ord, name, 'f' || ord FROM c WHERE name IS NOT NULL
UNION ALL SELECT k, 'baremetal', 'export', ord, role, 'dev-' || k || '_' || role FROM f""")
def default_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    devices = read(spark, sf_dir, "supplier").select(_text("dev-", k).alias("device"), F.when(k % 2 == 0, "gpio_controller").otherwise("other").alias("cls"), F.when(k % 3 > 0, "p->regs").alias("base"))
    ord_ = F.expr("cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS int)")
    functions = read(spark, sf_dir, "lineitem").select(
        _text("dev-", F.col("l_suppkey")).alias("device"), ord_.alias("ord"), _text("f", ord_).alias("name"), C.pick(_ROLES, "l_orderkey").alias("role"), (F.col("l_linenumber") < 4).alias("is_entry"), C.pick(_OWNERS, "l_partkey").alias("callback_table"),
    )
    return B.default_binds(devices, functions).select(F.expr("cast(substring(device, 5) AS bigint)").alias("k"), "backend", "section", "ord", "name", "value")


def _shown_args():
    return F.array_join(F.transform(F.array_sort(F.map_entries("args")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


_CALLBACKS = ("gpio_chip.set", "sdhci_ops.write_w", "sdhci_ops.read_l", "gpio_chip.get_multiple", None)
_ROLE3 = ("remove", "probe", "odd", "suspend")


@query(f"""WITH f AS (SELECT l_suppkey AS k, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INT) AS ord, {C.sql_pick(_CALLBACKS, 'l_partkey')} AS t, {C.sql_pick(_ROLE3, 'l_orderkey')} AS role, l_linenumber % 3 > 0 AS portable, l_linenumber % 2 AS ops FROM lineitem),
l AS (SELECT k, t, max(ord) AS ord FROM f WHERE portable AND t IS NOT NULL GROUP BY 1, 2),
v AS (SELECT k, coalesce(t, role) AS t, ord, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE role WHEN 'probe' THEN 0 WHEN 'suspend' THEN 3 WHEN 'remove' THEN 5 ELSE 2 END, 'm' || ord) - 1 AS INT) AS pos FROM f WHERE ops > 0 AND k % 3 = 1)
SELECT k, 'gpio' AS kind, t AS "table", 5 + i AS pos, 'm' || ord AS module, 'offset=1,value=' || (1 - i) AS args FROM l, (SELECT unnest([0, 1]) AS i) WHERE t = 'gpio_chip.set'
UNION ALL SELECT k, 'gpio', t, 3, 'm' || ord, 'offset=1,value=1' FROM l WHERE t = 'gpio_chip.get_multiple'
UNION ALL SELECT k, 'sdhci', t, p, 'm' || ord, 'offset=1,value=1' FROM l, (SELECT unnest([0, 1]) AS p) WHERE t = 'sdhci_ops.read_l' AND k % 3 = 0
UNION ALL SELECT k, 'sdhci', t, x.p, 'm' || ord, 'offset=1,value=' || x.v FROM l, (SELECT unnest([{{'p': 7, 'v': 4660}}, {{'p': 8, 'v': 22136}}, {{'p': 9, 'v': 43981}}]) AS x) WHERE t = 'sdhci_ops.write_w' AND k % 3 = 0
UNION ALL SELECT k, 'virtio', t, pos, 'm' || ord, 'offset=1,value=1' FROM v""")
def callback_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    devices = read(spark, sf_dir, "supplier").select(k.alias("device"), F.when(k % 3 == 0, "sdhci").when(k % 3 == 1, "virtio_mmio").otherwise("gpio").alias("cls"), F.lit(True).alias("state_only"))
    ord_ = F.expr("cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS int)")
    param = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"))
    functions = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("device"), ord_.alias("ord"), _text("m", ord_).alias("module"), C.pick(_CALLBACKS, "l_partkey").alias("callback_table"), C.pick(_ROLE3, "l_orderkey").alias("role"),
        F.array(param("gc", "DeviceState"), param("offset", "UInt"), param("value", "UInt")).alias("params"), (F.col("l_linenumber") % 3 > 0).alias("portable"), (F.col("l_linenumber") % 2).alias("ops"),
    )
    registers = devices.select("device", F.lit("SDHCI_COMMAND").alias("name"), F.col("device").cast("bigint").alias("offset"))
    return B.callback_plans(devices, functions, registers).select(F.col("device").alias("k"), "kind", "table", "pos", "module", _shown_args().alias("args"))


@query("""SELECT o_custkey AS device, 'm' || o_orderkey % 40 AS module, min(o_orderkey) AS loop FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2 HAVING count(*) = 1 AND min(o_orderkey % 40) < 30""")
def drain_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device"), _text("m", F.col("o_orderkey") % 40).alias("module"), F.when(F.col("o_orderkey") % 3 > 0, "masked_w1c_drain").otherwise("other").alias("proof_kind"), F.col("o_orderkey").alias("loop"))
    return B.drain_plans(o.where("cast(substring(module, 2) AS int) < 30").select("device", "module"), o)


@query("""SELECT s_suppkey AS case_id, 'd/s' || s_suppkey || '.c' AS source, CASE WHEN s_suppkey % 11 > 0 THEN 'p' || s_nationkey END AS profile, CASE WHEN s_suppkey % 11 > 0 AND s_nationkey < 20 THEN 'arch' || s_nationkey % 3 END AS arch,
 CASE WHEN s_suppkey % 11 > 0 AND s_nationkey < 20 AND s_suppkey % 7 > 0 THEN sha256('cc -c s' || s_suppkey) END AS raw_command_sha256,
 CASE WHEN s_suppkey % 11 = 0 THEN 'case without a recipe' WHEN s_nationkey >= 20 THEN 'missing profile p' || s_nationkey WHEN s_suppkey % 7 = 0 THEN s_suppkey || ' produced no saved build command' END AS problem FROM supplier""")
def holdout_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    source, profile, k = _text("d/s", F.col("s_suppkey"), ".c"), _text("p", F.col("s_nationkey")), F.col("s_suppkey")
    cases = s.select(k.alias("case_id"), source.alias("source"))
    recipes = s.where(k % 11 > 0).select(k.alias("case_id"), profile.alias("profile"), _text("d/s", k, ".o").alias("target"))
    n = F.col("n_nationkey")
    profiles = read(spark, sf_dir, "nation").where(n < 20).select(_text("p", n).alias("profile"), F.lit("full").alias("kind"), _text("arch", n % 3).alias("arch"), _text("b/", n).alias("build_dir"), F.lit("defconfig").alias("defconfig"))
    commands = s.where(k % 7 > 0).select(_text("b/", F.col("s_nationkey")).alias("directory"), source.alias("source"), _text("cc -c s", k).alias("command"))
    return B.holdout_contexts(cases, recipes, profiles, commands).select("case_id", "source", "profile", "arch", "raw_command_sha256", "problem")


# ---- source models --------------------------------------------------------------------

#: The little-endian word of the test memory at a place, as SQL.
_SEED = "({0} * 37 + 90) % 256 + ((({0} + 1) * 37 + 90) % 256) * 256 + ((({0} + 2) * 37 + 90) % 256) * 65536 + ((({0} + 3) * 37 + 90) % 256) * 16777216"


@query(f"""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS pair, CAST(1 AS BIGINT) << CAST(o_custkey % 32 AS INT) AS line, o_custkey % 3 > 0 AS high, CAST(16 + 16 * (o_orderkey % 50) AS BIGINT) AS a0 FROM orders),
s AS (SELECT *, CAST({_SEED.format('a0')} AS BIGINT) AS dat, CAST({_SEED.format('(a0 + 12)')} AS BIGINT) AS dir FROM b),
n AS (SELECT *, CASE WHEN high THEN dat | line ELSE dat & (4294967295 - line) END AS d2, CASE WHEN pair THEN dir | line ELSE (4294967295 - dir) | line END AS o2 FROM s)
SELECT k, CASE WHEN pair THEN 'W' || (a0 + CASE WHEN high THEN 4 ELSE 8 END) || '=' || line || ' W' || (a0 + 12) || '=' || o2 ELSE 'W' || a0 || '=' || d2 || ' W' || (a0 + 12) || '=' || (4294967295 - o2) END
 || ' R' || a0 || '=' || CASE WHEN pair THEN dat ELSE d2 END || ' R' || (a0 + 12) || '=' || CASE WHEN pair THEN o2 ELSE 4294967295 - o2 END AS trace,
 CASE WHEN pair THEN CAST((dat & line) > 0 AS BIGINT) ELSE CAST(high AS BIGINT) END AS level, CAST(0 AS BIGINT) AS "input", CASE WHEN pair THEN dat ELSE d2 END AS data, o2 AS direction FROM n""")
def bank_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), (F.col("o_orderkey") % 50 * 16 + 16).cast("bigint")
    num = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("bigint") for x in kv])
    offsets = F.when(k % 2 == 0, num("dat", at, "set", at + 4, "clr", at + 8, "dirout", at + 12)).otherwise(num("dat", at, "dirin", at + 12))
    args = num("offset", F.col("o_custkey") % 32, "value", F.when(F.col("o_custkey") % 3 > 0, 1).otherwise(0))
    plan = F.array(*[F.struct(F.lit(f"gpio_chip.{t}").alias("table"), args.alias("args")) for t in ("direction_output", "get", "get_direction")])
    cases = read(spark, sf_dir, "orders").select(k.alias("k"), offsets.alias("offsets"), F.lit(4).alias("width"), F.array().cast("array<string>").alias("flags"), plan.alias("plan"))
    got = D.bank_traces(cases, "offsets", "width", "flags", "plan")
    text = F.array_join(F.transform(F.flatten(F.col("run.calls.trace")), lambda a: F.concat(a["kind"], a["offset"], F.lit("="), a["value"])), " ")
    call = lambda i: F.get(F.col("run.calls"), F.lit(i))
    return got.select("k", text.alias("trace"), call(1)["result"].alias("level"), call(2)["result"].alias("input"), call(2)["data"].alias("data"), call(2)["direction"].alias("direction"))


_FLAGS = ("unreadable_set", "no_set_on_input", "unreadable_dir", "big_endian", "read_output_set")


@query("""SELECT o_orderkey AS k, CAST(7 AS INT) AS calls, o_orderkey % 7 <> 0 AS passed, CASE WHEN o_orderkey % 7 = 0 THEN 'gpio_chip.direction_output' END AS first_difference FROM orders""")
def bank_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of banks of all kinds against their drivers; every seventh loses the flag that turns a line before it is set."""
    k, at = F.col("o_orderkey"), (F.col("o_orderkey") % 50 * 20 + 16).cast("bigint")
    fields = [("dat", F.lit(True)), ("set", k % 3 > 0), ("clr", k % 3 > 1), ("dirout", k % 2 == 0), ("dirin", k % 2 == 1)]
    entries = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("key"), (at + 4 * i).alias("value"))) for i, (n, c) in enumerate(fields)]), lambda e: e.isNotNull())
    lost = k % 7 == 0
    flags = F.filter(F.array(*[F.when((k % (i + 2) == 1) | (lost if n == "no_set_on_input" else F.lit(False)), F.lit(n)) for i, n in enumerate(_FLAGS)]), lambda f: f.isNotNull())
    num = lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n), v.cast("bigint"))])
    args = num(offset=k % 8, value=F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(0), mask=F.col("o_custkey") % 256, bits=k % 256)
    plan = F.array(*[F.struct(F.lit(t).alias("table"), args.alias("args")) for t in B.GPIO_TABLES])
    cases = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(k.alias("k"), F.map_from_entries(entries).alias("offsets"), C.pick((1, 2, 4), "o_custkey").alias("width"), flags.alias("flags"), F.when(lost, F.array_remove(flags, "no_set_on_input")).otherwise(flags).alias("made"), plan.alias("plan"))
    return G.bank_differential(cases, "offsets", "width", "flags", "made", "plan").select("k", F.col("calls").cast("int").alias("calls"), "passed", "first_difference")


@query("""SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 5 ELSE 8 END AS BIGINT) AS programs, o_orderkey % 5 > 0 AS turns FROM orders WHERE o_orderkey % 3 > 0""")
def bank_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = lambda *fields: F.create_map(*[x for i, n in enumerate(fields) for x in (F.lit(n), (k % 90 + 4 * i).cast("bigint"))])
    offsets = F.when(k % 3 == 0, place("set")).when(k % 5 == 0, place("dat", "set")).otherwise(place("dat", "dirin"))
    cases = read(spark, sf_dir, "orders").select(k.alias("k"), offsets.alias("offsets"), F.lit(4).alias("width"), F.array().cast("array<string>").alias("flags"))
    return G.callback_programs(cases, ["k"], "offsets", "width", "flags").groupBy("k").agg(F.count(F.lit(1)).alias("programs"), F.bool_or(F.col("callback") == "get_direction").alias("turns"))


@query("""SELECT o_orderkey AS k, 'id' AS source_variable, 'of_alias_get_id((pdev->dev.of_node), "gpio")' AS source_expr, '(of_alias_get_id((pdev->dev.of_node), "gpio")) == ' || o_custkey AS source_condition FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0""")
def direction_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    row = lambda field, branch, expr: F.struct(F.lit(field).alias("field"), expr.alias("expr"), _text("(id) == (", F.col("o_custkey"), ")").alias("condition"), F.lit("id").alias("switch"), F.lit(branch).alias("branch"))
    fields = o.select(k.alias("k"), F.inline(F.array(row("dirin", "case", F.lit("b + 4")), row("dirout", "default", F.when(k % 3 > 0, "b + 4").otherwise("b + 8")))))
    sources = o.select(k.alias("k"), F.when(k % 5 > 0, F.when(k % 2 == 0, 'np = pdev->dev.of_node; id = of_alias_get_id(np, "gpio");').otherwise("id = 3;")).otherwise("idx = 1;").alias("text"))
    return G.direction_variants(fields, sources, ["k"])


@query("""SELECT o_orderkey AS k, 'port->idx' AS selector, 'g->regs' AS base, 1 AS resource_index, CASE o_orderkey % 4 WHEN 0 THEN CAST(4 AS BIGINT) WHEN 1 THEN CAST(16 AS BIGINT) END AS max_count, CASE WHEN o_orderkey % 5 > 0 THEN 'reg' END AS property,
 CASE WHEN o_orderkey % 7 > 0 THEN CAST(0 AS BIGINT) END AS irq_selector FROM orders WHERE o_orderkey % 3 > 0""")
def bank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    row = lambda field, expr: F.struct(F.lit(field).alias("field"), F.lit("g->regs").alias("base"), F.lit(1).alias("resource_index"), expr.alias("expr"))
    fields = o.select(k.alias("k"), F.inline(F.array(row("dat", F.lit("g->regs + 0x50 + port->idx * 4")), row("set", F.when(k % 3 > 0, "g->regs + port->idx * 12").otherwise("g->regs + 12")))))
    limit = F.when(k % 4 == 0, "MAX_PORTS").when(k % 4 == 1, "0x10").when(k % 4 == 2, "999").otherwise("UNKNOWN")
    text = _text("if (port->idx >= ", limit, ") return; gpio->nr = port->idx; ", F.when(k % 5 > 0, 'fwnode_property_read_u32(f, "reg", &port->idx); ').otherwise(""), F.when(k % 7 > 0, "if (port->idx == 0) config_irqs(g);").otherwise(""))
    macros = o.select(k.alias("k"), F.lit("MAX_PORTS").alias("name"), F.lit(4).cast("bigint").alias("value"))
    return G.bank_models(fields, o.select(k.alias("k"), text.alias("text")), macros, ["k"])


_SAVED = [*D.PM_SAVED[0], *D.PM_SAVED[1], "intmask"]
_RESTORED = [*D.PM_RESTORED[0], *D.PM_RESTORED[1], "eoi"]
_PM_SQL = f"""t AS ({' UNION ALL '.join(f"SELECT '{p}' AS phase, {n} AS n, '{'W' if p == 'resume' or n == 8 else 'R'}' AS kind, '{r}' AS r, {D.PM_REGISTERS[r]} AS a0, {D.PM_STRIDE.get(r, 0)} AS stride" for p, rs in (('suspend', _SAVED), ('resume', _RESTORED)) for n, r in enumerate(rs))}),
b AS (SELECT s_suppkey AS k, s_suppkey % 2 AS flags, CASE WHEN s_suppkey % 3 = 0 THEN [2, 0, 3, 1] ELSE [0, 1] END AS ports FROM supplier),
e AS (SELECT k, flags, ports, unnest(ports) AS bank, unnest(generate_series(1, len(ports))) AS j FROM b),
p AS (SELECT k, flags, phase, kind, r, j, CAST(n + CASE WHEN list_position(ports, 0) < j THEN 6 ELSE 0 END + 3 * (j - 1) AS INT) AS step, a0 + bank * stride AS raw FROM e, t WHERE n < 3 OR bank = 0),
q AS (SELECT *, CAST(CASE WHEN flags = 1 THEN CASE raw WHEN 52 THEN 68 WHEN 56 THEN 52 WHEN 60 THEN 56 WHEN 64 THEN 60 WHEN 76 THEN 64 ELSE raw END ELSE raw END AS BIGINT) AS o FROM p),
pm AS (SELECT k, flags, phase, step, kind, o AS "offset", CAST(CASE WHEN r = 'eoi' THEN 4294967295 WHEN kind = 'W' AND phase = 'suspend' THEN 4294967295 - 16843009 * j ELSE {_SEED.format('o')} END AS BIGINT) AS value FROM q)"""


def _powers(spark: SparkSession, sf_dir: str, flags) -> DataFrame:
    ports = F.when(F.col("s_suppkey") % 3 == 0, F.array(*map(F.lit, (2, 0, 3, 1)))).otherwise(F.array(F.lit(0), F.lit(1)))
    cases = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), flags.alias("flags"), ports.alias("ports"))
    return D.power_traces(cases, ["k"], "flags", "ports")


@query(f"WITH {_PM_SQL} SELECT k, phase, step, kind, \"offset\", value FROM pm")
def power_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _powers(spark, sf_dir, (F.col("s_suppkey") % 2).cast("int"))


@query("""SELECT s_suppkey AS k, p AS phase, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 18 ELSE 12 END AS INT) AS steps, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0 WHEN p = 'suspend' THEN 4 ELSE 4 END AS INT) AS differing,
 CASE WHEN s_suppkey % 2 = 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 3 END END AS first_difference, CASE WHEN s_suppkey % 2 = 1 THEN 'offset,value' END AS reason FROM supplier, (SELECT unnest(['suspend', 'resume']) AS p)""")
def power_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces against those of a model that never moves a register: version 2 differs in what it moves, version 1 nowhere."""
    k = F.col("s_suppkey")
    expected, actual = _powers(spark, sf_dir, (k % 2).cast("int")), _powers(spark, sf_dir, F.lit(0))
    got = O.trace_diff(expected, actual, ["k", "phase"], "step", ["kind", "offset", "value"])
    return got.select("k", "phase", F.col("steps").cast("int").alias("steps"), F.col("differing").cast("int").alias("differing"), "first_difference", "reason")


_MODES = ("read", "write", "read_reg", "write_reg", "set_bits", "other")


@query(f"""WITH b AS (SELECT o_orderkey AS k, {C.sql_pick(_MODES, 'o_orderkey')} AS m, o_custkey % 4 + 1 AS s, o_orderkey % 400 AS r, o_custkey * 7 AS v, o_orderkey % 65536 AS c FROM orders)
SELECT k, CASE m WHEN 'read' THEN 'R' || r * s || '=' || c WHEN 'write' THEN 'W' || r * s || '=' || (v % 65536) WHEN 'read_reg' THEN 'W' || 2 * s || '=' || r || ' R0=' || c
 WHEN 'write_reg' THEN 'W' || 2 * s || '=' || r || ' W0=' || (v % 65536) WHEN 'set_bits' THEN 'W' || 2 * s || '=' || r || ' R0=' || c || ' W' || 2 * s || '=' || r || ' W0=' || ((c | v) % 65536) END AS trace FROM b""")
def port_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    got = D.port_traces(C.pick(_MODES, "o_orderkey"), c % 4 + 1, k % 400, c * 7, k % 65536)
    return read(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(F.transform(got, lambda a: F.concat(a["kind"], a["offset"], F.lit("="), a["value"])), " ").alias("trace"))


def _path_program(then: int) -> str:
    value = {"Ite": {"guard": {"Var": "select"}, "then": {"Const": then}, "else": {"Const": 1}}}
    return json.dumps([{"Write": {"addr": {"Symbolic": {"device": "dev", "register": "VALUE_REG"}}, "width": "B4", "value": value}}])


@query("""SELECT o_orderkey AS k, m AS mutation, CAST(1 AS INT) AS steps, m = 'none' OR o_orderkey % 2 = 0 AS matched, CASE WHEN m <> 'none' AND o_orderkey % 2 = 1 THEN 'value' END AS reason FROM orders, (SELECT unnest(['none', 'value']) AS m)""")
def path_trace_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a function's program, and of one with a changed value, against what the original code writes."""
    k = F.col("o_orderkey")
    base = spread(read(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("k"), (k % 2).alias("select"))
    mutants = F.array(*[F.struct(F.lit(n).alias("mutation"), F.lit(_path_program(v)).alias("program")) for n, v in (("none", 2), ("value", 0xDEAD))])
    cases = base.select("k", "select", F.inline(mutants)).withColumn("env", F.create_map(F.lit("select"), "select")).withColumn("registers", F.create_map(F.lit("VALUE_REG"), F.lit(0x20).cast("bigint")))
    actual = I.interpreted(cases, "program", "env", "registers").select("k", "mutation", F.posexplode("run.trace").alias("step", "t")).select("k", "mutation", "step", "t.*")
    original = cases.select("k", "mutation", F.lit(0).alias("step"), F.lit("W").alias("kind"), F.lit(0x20).cast("bigint").alias("offset"), F.when(F.col("select") == 1, 2).otherwise(1).cast("bigint").alias("value"))
    got = O.trace_diff(original, actual, ["k", "mutation"], "step", ["kind", "offset", "value"])
    return got.select("k", "mutation", F.col("steps").cast("int").alias("steps"), (F.col("differing") == 0).alias("matched"), "reason")
