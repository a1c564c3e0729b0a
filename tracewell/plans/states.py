"""Queries of state rewriting, base stores, contracts of portable modules, printed listings and old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import cexpr as X
from tracewell.functions import rules
from tracewell.operators import banks as B
from tracewell.operators import summaries as S
from tracewell.plans.contracts import pick, sql_pick
from tracewell.plans.registry import collector
from tracewell.plans.traces import read
from tracewell.sources import aliases as A
from tracewell.sources import logs as L
from tracewell.sources import reports as R

QUERIES, ORACLE_SQL, query = collector()


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_CALLS = ("virtqueue_get_buf", "virtqueue_kick", "virtqueue_add_inbuf_cache_clean", "", "virtqueue_detach_unused_buf")
_LINES = "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey AS p, l_suppkey AS s FROM lineitem"


@query(f"""WITH l AS ({_LINES}), f AS (SELECT k, n, p, {sql_pick(_CALLS, 'p')} AS q, unnest([{{'i': 0, 'kind': 'loop', 'guard': 'i < sizeof(struct a_devids)', 'source': CASE WHEN s % 2 = 0 THEN 'while (' || s % 3 || ')' ELSE '' END}}, {{'i': 1, 'kind': 'cond', 'guard': 'c' || s % 3, 'source': NULL}}, {{'i': 2, 'kind': CASE WHEN p % 4 = 0 THEN 'cond' ELSE 'loop' END, 'guard': 'j' || s % 2, 'source': NULL}}]) AS f FROM l),
w AS (SELECT *, f.i AS i, coalesce(nullif(f.source, ''), f.guard) AS name, CASE q WHEN 'virtqueue_get_buf' THEN 'completed' WHEN 'virtqueue_detach_unused_buf' THEN 'outstanding' WHEN 'virtqueue_add_inbuf_cache_clean' THEN 'queue_depth' END AS c FROM f),
b AS (SELECT k, name, arg_max(c, n * 10 + i) AS c FROM w WHERE c IS NOT NULL AND f.kind = 'loop' GROUP BY ALL)
SELECT w.k AS l_orderkey, CAST(n AS INT) AS n, string_agg(CASE WHEN b.c IS NOT NULL THEN 'loop/for/__virtio_i < vi->evt_' || b.c ELSE w.f.kind || '//' || replace(w.f.guard, 'sizeof(struct a_devids)', '8') END, '; ' ORDER BY i) AS frames FROM w LEFT JOIN b ON b.k = w.k AND b.name = w.name GROUP BY ALL""")
def bounded_loop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    frame = lambda kind, guard, source: F.struct(kind.alias("kind"), F.lit("").alias("loop_kind"), guard.alias("guard"), source.cast("string").alias("source"), F.lit(None).cast("string").alias("init"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("contract"))
    s, none = F.col("l_suppkey"), F.lit(None)
    frames = F.array(
        frame(F.lit("loop"), F.lit("i < sizeof(struct a_devids)"), F.when(s % 2 == 0, _text("while (", s % 3, ")")).otherwise("")), frame(F.lit("cond"), _text("c", s % 3), none),
        frame(F.when(F.col("l_partkey") % 4 == 0, "cond").otherwise("loop"), _text("j", s % 2), none),
    )
    ops = read(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("ord"), pick(_CALLS, "l_partkey").alias("queue_operation"), F.lit("evt").alias("prefix"), frames.alias("frames"))
    shown = F.array_join(F.transform("frames", lambda f: F.concat_ws("/", f["kind"], f["loop_kind"], f["guard"])), "; ")
    return S.bounded_loop_frames(ops, ["l_orderkey"]).select("l_orderkey", F.col("ord").alias("n"), shown.alias("frames"))


_ASSIGNED = "CASE p % 5 WHEN 0 THEN ('v' || s % 4) WHEN 1 THEN ('v' || s % 4 || ' + N') WHEN 2 THEN ('q->v' || s % 4) WHEN 3 THEN ('f(v1)') ELSE ('(v' || s % 4 || ' | ' || p % 7 || ')') END"


@query(f"""WITH RECURSIVE l AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) AS n, 'v' || (p + n) % 4 AS name, p % 5 AS t, p, 'v' || s % 4 AS v FROM (SELECT k, n, p, s FROM ({_LINES})) WHERE p % 5 <> 3),
w AS (SELECT DISTINCT l_orderkey AS k, 0::BIGINT AS n, MAP {{'v0': 'v0', 'v3': 'v3'}} AS m FROM lineitem
 UNION ALL SELECT w.k, l.n, map_from_entries(list_concat(list_filter(map_entries(w.m), lambda e: e.key <> l.name), [{{'key': l.name, 'value': CASE l.t WHEN 0 THEN coalesce(w.m[l.v], l.v) WHEN 1 THEN coalesce(w.m[l.v], l.v) || ' + 0x' || lower(hex(l.k)) WHEN 2 THEN 'q->' || l.v ELSE '(' || coalesce(w.m[l.v], l.v) || ' | ' || l.p % 7 || ')' END}}])) FROM w JOIN l ON l.k = w.k AND l.n = w.n + 1)
SELECT k AS l_orderkey, unnest(map_keys(m)) AS name, unnest(map_values(m)) AS expr FROM w WHERE n = (SELECT coalesce(max(n), 0) FROM l WHERE l.k = w.k)""")
def base_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", n.cast("long").alias("ord"), F.col("l_partkey").alias("p"), (F.col("l_suppkey") % 4).cast("string").alias("s"))
    v = F.concat(F.lit("v"), "s")
    text = F.when(F.col("p") % 5 == 0, v).when(F.col("p") % 5 == 1, _text(v, " + N")).when(F.col("p") % 5 == 2, _text("q->", v)).when(F.col("p") % 5 == 3, "f(v1)").otherwise(_text("(", v, " | ", F.col("p") % 7, ")"))
    orders = rows.select("l_orderkey").distinct()
    seeds = orders.select("l_orderkey", F.explode(F.array(F.lit("v0"), F.lit("v3"))).alias("name"))
    macros = orders.select("l_orderkey", F.lit("N").alias("name"), F.col("l_orderkey").alias("value"))
    return S.base_store(rows.select("l_orderkey", "ord", _text("v", (F.col("p") + F.col("ord")) % 4).alias("name"), text.alias("text")), seeds, macros, "l_orderkey")


_ACCESSOR = ("write_b", "read_w", "read_l")


@query(f"""WITH b AS (SELECT p_partkey AS k, {sql_pick(_ACCESSOR, 'p_partkey')} AS f, p_size % 2 = 0 AS big, 'r' || p_size AS r FROM part),
o AS (SELECT k, 0 AS ord, 0 AS sub, 'StateRead|4||s|x||' AS op FROM b UNION ALL
 SELECT k, 1, 0, CASE WHEN f = 'write_b' THEN CASE WHEN big THEN 'ReadModifyWrite|4|host->ioaddr + ((' || r || ') & ~0x3)||__old|((__old & ~(0xff << (((' || r || ') & 0x3) * 8))) | (((v) & 0xff) << (((' || r || ') & 0x3) * 8)))|g' ELSE 'Write|1|host->ioaddr + ' || r || '|||v|g' END
  ELSE 'Read|' || CASE f WHEN 'read_w' THEN 2 ELSE 4 END || '|host->ioaddr + ' || CASE WHEN f = 'read_w' AND big THEN '((' || r || ') ^ 0x2)' ELSE r END || '||value||g' END FROM b
 UNION ALL SELECT k, 1, 1, 'Return|0||||value|g' FROM b WHERE f <> 'write_b' UNION ALL SELECT k, 2, 0, 'Write|4|other|||1|' FROM b)
SELECT k AS p_partkey, ord, sub, op FROM o""".replace("(((v) & 0xff)", "(((v) & 0xff)"))
def private_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", pick(_ACCESSOR, "p_partkey").alias("field"), (F.col("p_size") % 2 == 0).alias("big"), _text("r", F.col("p_size")).alias("reg"))
    none = F.lit(None).cast("string")
    name = F.concat(F.when(F.col("big"), "sdhci_be32bs_").otherwise("sdhci_"), F.when(F.col("field") == "write_b", "writeb").when(F.col("field") == "read_w", "readw").otherwise("readl"))
    access = S.operation("Read", 4, "a", guard="g").withField("kind", F.when(F.col("field") == "write_b", "Write").otherwise("Read"))
    row = lambda n, op, callee: F.struct(F.lit(n).alias("ord"), op.cast(S.OP).alias("op"), callee.alias("callee"))
    ops = p.select("p_partkey", "field", F.lit("host->ioaddr").alias("base"), "reg", F.lit("v").alias("value"), F.inline(F.array(row(0, S.operation("StateRead", 4, field="s", var="x"), none), row(1, access, name), row(2, S.operation("Write", 4, "other", value="1"), none))))
    returns = p.select("p_partkey", "field", F.lit("value").alias("text"))
    got = S.expanded_accessors(ops, returns, ["p_partkey"])
    return got.select("p_partkey", "ord", "sub", F.concat_ws("|", F.col("op.kind"), F.col("op.width").cast("string"), *[F.coalesce(f"op.{c}", F.lit("")) for c in ("address", "field", "var", "value", "guard")]).alias("op"))


_LEAF = ("Read", "Write", "StateRead", "Return", "Delay", "StateWrite", "OutputWrite", "Cond", "Loop")
_CONTRACT = ("linux.gpio_generic_chip_config", "linux.sdhci_ops", "linux.virtqueue")
_NODES = f"""n AS (SELECT o_custkey AS d, o_custkey % 5 AS c, o_orderkey % 2 AS m, {sql_pick(_LEAF, 'o_orderkey * 7 % (7 + o_custkey % 3)')} AS kind, CASE WHEN o_orderkey % 29 = 0 THEN 'computed' ELSE 'symbolic' END AS addr, o_orderkey % 58 = 0 AS low,
 CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'subsystem_summary' END AS origin, {sql_pick(_CONTRACT, 'o_custkey')} AS contract, CASE WHEN o_custkey % 3 = 1 THEN 'sdhci_accessor' END AS summary, {sql_pick(('Exact', 'Conservative', 'Unknown', 'Unsupported'), 'CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey % 4 ELSE 0 END')} AS rel, o_orderkey % 37 <> 0 AS bounded FROM orders),
x AS (SELECT *, kind NOT IN ('Cond', 'Loop') AS leaf, kind NOT IN ('Read', 'Write') OR addr = 'symbolic' OR low AS address FROM n)"""


def _contract_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("driver"), (o % 2).alias("module"), pick(_LEAF, "o_orderkey * 7 % (7 + o_custkey % 3)").alias("kind"), F.when(o % 29 == 0, "computed").otherwise("symbolic").alias("addr_kind"), (o % 58 == 0).alias("lowerable"),
        F.when(o % 31 != 0, "subsystem_summary").alias("origin"), pick(_CONTRACT, "o_custkey").alias("contract"), F.when(F.col("o_custkey") % 3 == 1, "sdhci_accessor").alias("summary"),
        pick(("Exact", "Conservative", "Unknown", "Unsupported"), "CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey % 4 ELSE 0 END").alias("reliability"), (o % 37 != 0).alias("bounded"),
    )


@query(f"""WITH {_NODES} SELECT d AS driver, m AS module, coalesce(bool_and(kind IN ('Read', 'Write', 'StateRead', 'StateWrite', 'Return', 'OutputWrite') AND origin IS NOT NULL AND contract = 'linux.gpio_generic_chip_config' AND rel <> 'Unsupported' AND address) FILTER (leaf), false) AND count(*) FILTER (kind = 'Loop') = 0 AS gpio,
 coalesce(bool_and(kind = 'Delay' OR (kind <> 'OutputWrite' AND contract = 'linux.sdhci_ops' AND rel NOT IN ('Unsupported', 'Unknown') AND address)) FILTER (leaf), false) AND count(*) FILTER (kind = 'Loop') = 0 AS sdhci FROM x GROUP BY ALL""")
def portable_by_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contract_verdicts(_contract_nodes(spark, sf_dir), "driver", "module")[0]


@query(f"""WITH {_NODES} SELECT d AS driver, coalesce(bool_and(kind = 'Delay' OR (kind <> 'OutputWrite' AND origin IS NOT NULL AND coalesce(summary = 'sdhci_accessor', false) AND rel NOT IN ('Unsupported', 'Unknown') AND address)) FILTER (leaf), false) AND count(*) FILTER (kind = 'Loop') = 0 AS accessor_only,
 coalesce(bool_and(CASE WHEN kind = 'Loop' THEN rel = 'Exact' AND bounded ELSE kind = 'Return' OR (kind IN ('StateRead', 'StateWrite') AND contract = 'linux.virtqueue' AND rel NOT IN ('Unsupported', 'Unknown')) END) FILTER (kind <> 'Cond'), false) AND count(*) FILTER (kind IN ('StateRead', 'StateWrite')) > 0 AS state_only FROM x GROUP BY ALL""")
def drivers_by_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contract_verdicts(_contract_nodes(spark, sf_dir), "driver", "module")[1]


@query("""SELECT p_partkey, 'device d' || p_partkey || ' {' || chr(10) || '  class gpio' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '  source "a.c"' ELSE '' END || CASE WHEN p_size % 3 > 0 THEN chr(10) || '  state {' || chr(10) || '    lock: bool bind g->lock' || chr(10) || '    n: u32' || chr(10) || '  }' ELSE '' END
 || chr(10) || '  resource mem: Mmio { required true bind 0 }' || chr(10) || '  register R0: B4 at base + 0x' || lower(hex(p_partkey * 4)) || CASE WHEN p_size % 5 = 0 THEN chr(10) || '  invariant n < ' || p_size ELSE '' END || chr(10) || '  function f' || chr(10) || '}' AS text FROM part""")
def device_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    none = F.lit(None).cast("string")
    s = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    state = F.array(s(name=F.lit("lock"), type=F.lit("bool"), bind=F.lit("g->lock")), s(name=F.lit("n"), type=F.lit("u32"), bind=none))
    devices = read(spark, sf_dir, "part").select(
        "p_partkey", _text("d", F.col("p_partkey")).alias("name"), F.lit("gpio").alias("class"), F.when(size % 2 == 0, "a.c").alias("source"), F.when(size % 3 > 0, state).otherwise(F.slice(state, 1, 0)).alias("state"),
        F.array(s(name=F.lit("mem"), type=F.lit("Mmio"), required=F.lit(True), bind=F.lit("0"))).alias("resources"), F.array(s(name=F.lit("R0"), width=F.lit("B4"), base=F.lit("base"), offset=F.col("p_partkey") * 4)).alias("registers"),
        F.when(size % 5 == 0, F.array(_text("n < ", size))).otherwise(F.array().cast("array<string>")).alias("invariants"), F.array(F.lit("  function f")).alias("functions"),
    )
    return R.device_text(devices, "p_partkey")


@query("""SELECT s_suppkey, 'source: a.c' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || 'includes:' || chr(10) || '  - x.h' || chr(10) || '  - y.h' ELSE '' END || chr(10) || 'structs:' || chr(10) || '  dev:' || chr(10) || '    fields:' || chr(10) || '      base: "void *"' || chr(10) || '  empty:' || chr(10) || '    fields:'
 || chr(10) || 'constants:' || chr(10) || '  N: ' || CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE '' END || '0x' || lower(hex(s_suppkey + 1)) || chr(10) || 'callbacks:' || chr(10) || '  t.f: g' || chr(10) || 'resources:' || chr(10) || '  mem:' || chr(10) || '    acquisition: "ioremap(x)"' || CASE WHEN s_suppkey % 5 = 0 THEN chr(10) || '    binds_to: "base"' ELSE '' END
 || chr(10) || 'error_paths:' || chr(10) || '  - "return -EIO"' || chr(10) || 'source_snippets:' || chr(10) || '  probe:' || chr(10) || '    - "a();"' AS text FROM supplier""")
def facts_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    fields = F.array(s(name=F.lit("base"), ctype=F.lit("void *")))
    none = F.array().cast("array<string>")
    facts = read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("a.c").alias("source"), F.when(k % 2 == 0, F.array(F.lit("x.h"), F.lit("y.h"))).otherwise(none).alias("includes"), F.array(s(name=F.lit("dev"), fields=fields), s(name=F.lit("empty"), fields=F.slice(fields, 1, 0))).alias("structs"),
        F.array(s(name=F.lit("N"), value=F.when(k % 3 == 0, -k - 1).otherwise(k + 1))).alias("constants"), F.array(s(name=F.lit("t.f"), function=F.lit("g"))).alias("callbacks"),
        F.array(s(name=F.lit("mem"), acquisition=F.lit("ioremap(x)"), binds_to=F.when(k % 5 == 0, "base"))).alias("resources"), F.array(F.lit("return -EIO")).alias("error_paths"), none.alias("helper_calls"), F.array(s(name=F.lit("probe"), calls=F.array(F.lit("a();")))).alias("snippets"),
    )
    return R.facts_text(facts, "s_suppkey")


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey % 4 AS c, o_orderkey % 3 AS m FROM orders)
SELECT k AS o_orderkey, 'probe' AS module, CASE m WHEN 0 THEN 'R' || c * 4 || ' W16' WHEN 1 THEN 'R' || c * 4 || ' W' || c * 4 || ' R8' ELSE 'W8' END AS ops FROM b
UNION ALL SELECT k, 'irq', 'R' || c * 4 FROM b WHERE m = 0""")
def legacy_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one to three modules; of two named alike the last counts, unknown registers and empty modules do not."""
    c = F.col("o_custkey") % 4
    line = lambda *p: _text("    ", *p, "\n")
    first = F.concat(F.lit("  module probe {\n"), line("R(B4, dev.R", c, ") -- a note W(B4, dev.R2)"), F.when(F.col("o_orderkey") % 3 == 1, line("W(B4, dev.R", c, ") = v")).otherwise(line("W(B2, base[0x10]) = 1")), F.when(F.col("o_orderkey") % 3 == 1, line("R(B4, dev.R2)")).otherwise(""), F.lit("  }\n"))
    more = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  module irq {\n"), line("R(B4, dev.R", c, ")"), line("R(B4, dev.MISSING)"), F.lit("  }\n  module none {\n    DELAY(3)\n  }\n"))).when(F.col("o_orderkey") % 3 == 2, "  module probe {\n    W(B1, dev.R2) = 0\n  }\n").otherwise("")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("driver d {\n"), first, more, F.lit("}\n")).alias("text"), F.concat(*[F.lit(f"  register R{i}: B4 at base + 0x{i * 4:x}\n") for i in range(4)]).alias("listing"))
    registers = L.register_offsets(o, "o_orderkey", "listing")
    got = L.listed_modules(o, registers, "o_orderkey")
    return got.select("o_orderkey", "module", F.array_join(F.transform("ops", lambda x: F.concat(x["kind"], x["offset"].cast("string"))), " ").alias("ops"))


_ADDRESSES = (("p->base + 0x10", True), ("regs + (off << 2)", True), ("p->secret + 4", False), ("f(x)", False), ("a[i] + 4", False), ("x ? p->ioaddr : p->regs", True), ("hw->hpi.base + hw->hpi.regstep * 3", True), ("", False), ("*q", False))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{', '.join(str(ok).lower() for _, ok in _ADDRESSES)}][(l_partkey * 3 + l_linenumber) % {len(_ADDRESSES)} + 1] AS lowerable FROM lineitem""")
def lowerable_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pick([t for t, _ in _ADDRESSES], "l_partkey * 3 + l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.lowerable(X.token_column(texts)).alias("lowerable"))


@query("""WITH p AS (SELECT s_suppkey AS k, n, n % 5 AS line, CASE (s_suppkey + n) % 4 WHEN 0 THEN '' WHEN 1 THEN 'a.c' WHEN 2 THEN '/k/y/b.c' ELSE 'x/c.c' END AS file FROM supplier, range(1, 12) t(n)),
lv AS (SELECT s_suppkey AS k, u.source, l.line, 'v' || l.line || u.t AS name FROM supplier, (VALUES ('/k/x/a.c', 0), ('/k/y/b.c', 1), ('/k/z/b.c', 2)) u(source, t), range(1, 5) l(line) WHERE (s_suppkey + l.line * (u.t + 1)) % 3 > 0),
s AS (SELECT p.*, CASE file WHEN 'a.c' THEN '/k/x/a.c' END AS src FROM p WHERE line > 0 AND n > 1),
m AS (SELECT s.*, l.name AS own, (SELECT count(*) FROM lv WHERE lv.k = s.k AND lv.line = s.line) AS c FROM s LEFT JOIN lv l ON l.k = s.k AND l.source = s.src AND l.line = s.line)
SELECT k AS s_suppkey, CAST(n AS BIGINT) AS alias_var, CASE WHEN own IS NOT NULL THEN src ELSE (SELECT min(source) FROM lv WHERE lv.k = m.k AND lv.line = m.line) END AS source, CAST(line AS INT) AS line, coalesce(own, (SELECT min(name) FROM lv WHERE lv.k = m.k AND lv.line = m.line)) AS name
FROM m WHERE own IS NOT NULL OR c = 1""")
def linked_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven variables a program of three units, two of them with one file name; all but the first may alias it."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    each = s.withColumn("n", F.explode(F.expr("sequence(1L, 11L)")))
    file = F.when((k + F.col("n")) % 4 == 0, "").when((k + F.col("n")) % 4 == 1, "a.c").when((k + F.col("n")) % 4 == 2, "/k/y/b.c").otherwise("x/c.c")
    code = _text(F.col("n"), " var", F.col("n"), '[m@f] %a { "ln": ', F.col("n") % 5, ', "fl": "', file, '" }\n', F.when(F.col("n") > 1, _text("MayAlias var", F.col("n"), "[q] -- var1[p]\n")).otherwise(""))
    lines = L.lines(each.groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", code.alias("c"))))["c"], "").alias("text")), "s_suppkey")
    units = s.withColumn("u", F.explode(F.array(*[F.struct(F.lit(p).alias("source"), F.lit(t).alias("t")) for p, t in (("/k/x/a.c", 0), ("/k/y/b.c", 1), ("/k/z/b.c", 2))]))).select("s_suppkey", "u.*")
    lvalues = units.withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("(s_suppkey + line * (t + 1)) % 3 > 0").select("s_suppkey", "source", "line", _text("v", F.col("line"), F.col("t")).alias("name"), F.lit("void *").alias("type"))
    found = A.aliased(A.pairs(lines, "s_suppkey"), s.withColumn("var", F.lit(1).cast("long")), "s_suppkey")
    return A.linked_names(found, A.symbols(lines, "s_suppkey"), units, lvalues, "s_suppkey").select("s_suppkey", "alias_var", "source", "line", "name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 AND l_orderkey % 4 > 0 THEN 'base' WHEN l_partkey % 3 = 0 THEN 'g->regs' ELSE 'other' END AS base,
 CASE WHEN l_partkey % 3 = 0 AND l_orderkey % 4 > 0 THEN '(vi->bank << ' || l_suppkey % 5 || ') + port->idxs + vi->bank' ELSE '(port->idx << ' || l_suppkey % 5 || ') + port->idxs + port->idx' END AS expr FROM lineitem""")
def applied_bank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    ops = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 3 == 0, "g->regs").otherwise("other").alias("base"), _text("(port->idx << ", F.col("l_suppkey") % 5, ") + port->idxs + port->idx").alias("expr"))
    models = read(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("port->idx").alias("selector"), F.lit("g->regs").alias("base"), F.lit("vi->bank").alias("state_field")).distinct()
    return B.applied_bank_models(ops, models, ["l_orderkey"])
