"""Queries of register accesses, their accounting, quality metrics, scores and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import accesses as A
from tracewell.functions import annotations as N
from tracewell.operators import facts as P
from tracewell.operators import quality as Q
from tracewell.operators import relational as R
from tracewell.plans import contracts as C
from tracewell.plans.registry import collector
from tracewell.plans.traces import read

QUERIES, ORACLE_SQL, query = collector()
_K = ", ".join(C.KEY)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_KIND = """CASE WHEN callee IN ('readl', 'ioread8', 'readq', 'dwc2_readl', 'sdhci_readw', 'gpio_generic_read_reg', 'virtio_cread_le', 'virtio_cread_bytes', 'virtqueue_get_buf', 'regmap_read') THEN 'read'
 WHEN callee IN ('writel', 'iowrite16', 'dwc2_writel', 'sdhci_writeb', 'gpio_generic_write_reg', 'virtio_cwrite_le', 'virtqueue_kick', 'virtqueue_add_outbuf', 'regmap_write') THEN 'write'
 WHEN callee = 'regmap_update_bits' THEN 'rmw' WHEN callee = 'regmap_bulk_read' THEN 'unsupported' WHEN callee = 'gpio_generic_chip_init' THEN 'summary' END"""
_DOMAIN = "CASE WHEN callee IN ('regmap_read', 'regmap_write', 'regmap_update_bits') THEN 'regmap' WHEN callee LIKE 'virtio_c%' THEN 'virtio_config' WHEN callee LIKE 'virtqueue_%' THEN 'virtqueue' ELSE 'mmio' END"
_WIDTH = """CASE WHEN callee = 'virtio_cread_bytes' THEN 1 WHEN callee IN ('virtio_cread_le', 'virtio_cwrite_le', 'gpio_generic_read_reg') AND type_size IN (1, 2, 4, 8) THEN type_size
 WHEN right(callee, 2) = '64' OR right(callee, 1) = 'q' THEN 8 WHEN right(callee, 2) = '32' OR right(callee, 1) = 'l' THEN 4 WHEN right(callee, 2) = '16' OR right(callee, 1) = 'w' THEN 2
 WHEN right(callee, 1) IN ('8', 'b') THEN 1 ELSE 4 END"""


@query(f"""WITH {C.CALLS_SQL} SELECT {_K}, callee, {_KIND} AS kind, {_DOMAIN} AS domain,
 CASE WHEN callee LIKE 'sdhci%' THEN 'sdhci_accessor' WHEN callee IN ('gpio_generic_read_reg', 'gpio_generic_write_reg') THEN 'gpio_generic_accessor' WHEN callee LIKE 'virtio_c%' THEN 'virtio_config'
  WHEN callee LIKE 'virtqueue_%' THEN 'virtqueue' WHEN callee = 'gpio_generic_chip_init' THEN 'gpio_generic_chip' END AS summary_kind,
 callee IN ('kfree', 'pr_info') AS framework FROM calls""")
def access_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("callee")
    return C.calls(spark, sf_dir).select(*C.KEY, "callee", A.kind(c).alias("kind"), A.domain(c).alias("domain"), A.summary_kind(c).alias("summary_kind"), A.is_framework(c).alias("framework"))


@query(f"WITH {C.CALLS_SQL} SELECT {_K}, CAST({_WIDTH} AS INT) AS width, 'B' || ({_WIDTH}) AS name FROM calls")
def access_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = A.width(F.col("callee"), F.col("type_size"))
    return C.calls(spark, sf_dir).select(*C.KEY, w.alias("width"), N.width_name(w).alias("name"))


_N = "len(args)"


@query(f"""WITH {C.CALLS_SQL} SELECT {_K},
 CASE WHEN callee IN ('readl', 'ioread8', 'readq') THEN coalesce(args[1], '') WHEN callee = 'dwc2_readl' THEN CASE WHEN {_N} >= 2 THEN args[1] || '->regs + ' || args[2] ELSE '' END
  WHEN callee = 'sdhci_readw' THEN CASE WHEN {_N} >= 2 THEN args[1] || '->ioaddr + ' || args[2] ELSE '' END WHEN callee = 'gpio_generic_read_reg' THEN coalesce(args[2], '')
  WHEN callee = 'virtio_cread_le' THEN CASE WHEN {_N} >= 3 THEN args[1] || ' + offsetof(' || args[2] || ', ' || args[3] || ')' ELSE coalesce(args[1], '') END
  WHEN callee = 'virtio_cread_bytes' THEN CASE WHEN {_N} >= 2 THEN args[1] || ' + ' || args[2] ELSE coalesce(args[1], '') END
  WHEN callee = 'virtqueue_get_buf' THEN CASE WHEN {_N} >= 1 THEN args[1] || ' + 4' ELSE '' END WHEN callee = 'regmap_read' THEN CASE WHEN {_N} >= 3 THEN args[1] || ' + ' || args[2] ELSE '' END END AS read_address,
 CASE WHEN callee IN ('writel', 'iowrite16') THEN coalesce(args[1], '') WHEN callee IN ('dwc2_writel', 'sdhci_writeb') THEN CASE WHEN {_N} >= 3 THEN args[2] ELSE '' END WHEN callee = 'gpio_generic_write_reg' THEN CASE WHEN {_N} >= 3 THEN args[3] ELSE '' END
  WHEN callee = 'virtio_cwrite_le' THEN CASE WHEN {_N} >= 4 THEN 'out' ELSE coalesce(args[1], '') END WHEN callee = 'virtqueue_kick' THEN CASE WHEN {_N} >= 1 THEN '1' ELSE '' END
  WHEN callee = 'virtqueue_add_outbuf' THEN CASE WHEN {_N} >= 4 THEN args[4] ELSE '' END WHEN callee = 'regmap_write' THEN CASE WHEN {_N} >= 3 THEN args[3] ELSE '' END END AS value,
 CASE WHEN callee IN ('writel', 'iowrite16') THEN coalesce(args[2], '') WHEN callee = 'dwc2_writel' THEN CASE WHEN {_N} >= 3 THEN args[1] || '->regs + ' || args[3] ELSE '' END WHEN callee = 'sdhci_writeb' THEN CASE WHEN {_N} >= 3 THEN args[1] || '->ioaddr + ' || args[3] ELSE '' END
  WHEN callee = 'gpio_generic_write_reg' THEN CASE WHEN {_N} >= 3 THEN args[2] ELSE '' END WHEN callee = 'virtio_cwrite_le' THEN CASE WHEN {_N} >= 4 THEN args[1] || ' + offsetof(' || args[2] || ', ' || args[3] || ')' ELSE coalesce(args[2], '') END
  WHEN callee = 'virtqueue_kick' THEN CASE WHEN {_N} >= 1 THEN args[1] || ' + 8' ELSE '' END WHEN callee = 'virtqueue_add_outbuf' THEN CASE WHEN {_N} >= 1 THEN args[1] || ' + 0' ELSE '' END
  WHEN callee = 'regmap_write' THEN CASE WHEN {_N} >= 3 THEN args[1] || ' + ' || args[2] ELSE '' END END AS write_address,
 CASE WHEN callee = 'virtio_cread_le' AND {_N} >= 4 THEN 'out' WHEN callee IN ('virtio_cread_bytes', 'regmap_read') AND {_N} >= 3 THEN args[3] ELSE assigned END AS result,
 CASE WHEN callee = 'regmap_update_bits' AND {_N} >= 4 THEN args[1] || ' + ' || args[2] || '|' || args[3] || '|' || args[4] END AS parts FROM calls""")
def argument_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, a = F.col("callee"), F.col("args")
    k, w, u = A.kind(c), A.write_parts(c, a), A.update_parts(c, a)
    return C.calls(spark, sf_dir).select(
        *C.KEY, F.when(k == "read", A.read_address(c, a)).alias("read_address"), F.when(k == "write", w["value"]).alias("value"), F.when(k == "write", w["address"]).alias("write_address"),
        A.result_variable(c, a, F.col("assigned")).alias("result"), F.concat_ws("|", u["address"], u["mask"], u["value"]).alias("parts"),
    ).withColumn("parts", F.nullif("parts", F.lit("")))


@query(f"""WITH {C.CALLS_SQL}, s AS (SELECT callee, {_KIND} AS kind, {_DOMAIN} AS domain, l_orderkey || ':' || l_linenumber AS site_id, l_partkey, l_suppkey, l_orderkey FROM calls),
f AS (SELECT site_id, arg_min(callee, l_partkey * 100000 + l_suppkey) AS callee, arg_min(kind, l_partkey * 100000 + l_suppkey) AS kind, arg_min(domain, l_partkey * 100000 + l_suppkey) AS domain FROM s WHERE kind IS NOT NULL GROUP BY 1),
o AS (SELECT l_orderkey || ':' || l_linenumber AS site_id, string_agg(DISTINCT 'op' || (l_suppkey % 5), ',' ORDER BY 'op' || (l_suppkey % 5)) AS ops FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT f.site_id, kind, domain, coalesce(ops, '') AS ops, CASE WHEN ops IS NOT NULL THEN 'emitted' WHEN callee = 'virtqueue_kick' THEN 'filtered' WHEN kind = 'unsupported' THEN 'unsupported' ELSE 'unaccounted' END AS status,
 CASE WHEN ops IS NOT NULL THEN NULL WHEN callee = 'virtqueue_kick' THEN 'explicit extractor blacklist' WHEN kind = 'unsupported' THEN 'recognized register API lacks scalar RIS model' ELSE 'recognized source MMIO call produced no RIS op' END AS reason
FROM f LEFT JOIN o USING (site_id)""")
def access_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.calls(spark, sf_dir).select("callee", F.lit(None).cast("string").alias("call_text"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("site_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"))
    ops = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("site_id"), F.expr("concat('op', l_suppkey % 5)").alias("op_id"))
    got = P.accounted(P.access_sites(s, ("virtqueue_kick",)), ops)
    return got.select("site_id", F.col("access_kind").alias("kind"), F.col("access_domain").alias("domain"), F.array_join("ris_ops", ",").alias("ops"), "status", "reason")


_OP = """ops AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_extract(['Read', 'Write', 'ReadModifyWrite'], CAST(l_partkey % 3 AS INT) + 1) AS kind,
 list_extract(['set_irq_type', 'probe', 'remove_all', 'do_work', 'ack_it'], CAST(l_suppkey % 5 AS INT) + 1) AS fn,
 list_extract(['GPIO_INT_EN', 'PWR_CLK', 'TX_DATA', 'CTRL', 'STATUS', 'FOO', NULL, 'DOORBELL', 'SOFT_RESET', 'INT_STAT'], CAST(l_partkey % 10 AS INT) + 1) AS reg,
 list_extract(['Fixed', 'Offset', 'Indirect', NULL], CAST(l_orderkey % 4 AS INT) + 1) AS ak, CASE WHEN l_linenumber % 2 = 0 THEN 'g->base' ELSE 'mode_ctl' END AS b, CAST(l_linenumber % 3 AS BIGINT) AS off,
 list_extract(['0', '0x0', 'val', NULL], CAST(l_suppkey % 4 AS INT) + 1) AS v FROM lineitem),
t AS (SELECT *, upper(coalesce(reg, '') || ' ' || CASE WHEN ak = 'Fixed' THEN '0x' || hex(off) WHEN ak IN ('Offset', 'Indirect') THEN upper(b) || CASE WHEN off <> 0 THEN ' + 0x' || hex(off) ELSE '' END ELSE '' END) AS s,
 fn IN ('set_irq_type', 'ack_it') AS irq, upper(coalesce(v, '')) IN ('0', '0X0') AS z FROM ops)"""


@query(f"""WITH {_OP} SELECT {_K}, CASE WHEN irq AND regexp_matches(s, 'INT|IRQ|CLR|MASK|EN') THEN 'Interrupt' WHEN regexp_matches(s, 'POWER|PM|SUSPEND|CLK|CLOCK') THEN 'Power' WHEN fn = 'remove_all' AND z THEN 'Power'
 WHEN regexp_matches(s, 'INIT|RESET') THEN 'Init' WHEN kind = 'Write' AND z AND NOT irq THEN 'Init' WHEN kind = 'Read' AND regexp_matches(s, 'STAT|FLAG|RAW|MASKED') THEN 'Status' WHEN regexp_matches(s, 'INT|IRQ') THEN 'Interrupt'
 WHEN regexp_matches(s, 'TX|RX|DATA|FIFO') THEN 'DataTransfer' WHEN regexp_matches(s, 'CONFIG|MODE|CTRL|DIR|PULL|DEBOUNCE|TYPE|EDGE|LEVEL|PRESCALE') THEN 'Config' WHEN regexp_matches(s, 'DOORBELL|NOTIFY|READY') THEN 'Synchronization'
 WHEN kind = 'Read' THEN 'Status' ELSE 'Config' END AS intent FROM t""")
def operation_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = C.pick(("Read", "Write", "ReadModifyWrite"), "l_partkey")
    fn = C.pick(("set_irq_type", "probe", "remove_all", "do_work", "ack_it"), "l_suppkey")
    reg = C.pick(("GPIO_INT_EN", "PWR_CLK", "TX_DATA", "CTRL", "STATUS", "FOO", None, "DOORBELL", "SOFT_RESET", "INT_STAT"), "l_partkey")
    address = N.address_text(C.pick(("Fixed", "Offset", "Indirect", None), "l_orderkey"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'g->base' ELSE 'mode_ctl' END"), F.expr("cast(l_linenumber % 3 AS bigint)"))
    return read(spark, sf_dir, "lineitem").select(*C.KEY, N.intent(kind, fn, reg, address, C.pick(("0", "0x0", "val", None), "l_suppkey")).alias("intent"))


@query(f"""WITH {C.NODES_SQL}, p AS (SELECT {_K}, CASE WHEN addr_kind IN ('symbolic', 'fixed') THEN addr_kind WHEN addr_kind = 'computed' AND lowerable THEN 'computed' ELSE 'unknown' END AS address,
 CASE WHEN value_top THEN 'unknown' ELSE 'exact' END AS value, CASE WHEN l_linenumber % 3 > 0 THEN 'syntactic' ELSE 'unconditional' END AS path, l_partkey % 6 = 0 AS other FROM nodes)
SELECT {_K}, address, value, path, CASE WHEN other THEN 'Unsupported' WHEN address = 'unknown' OR value = 'unknown' THEN 'Unknown' WHEN path = 'syntactic' THEN 'Conservative' ELSE 'Exact' END AS reliability,
 CASE WHEN other THEN 'Unsupported' WHEN value = 'unknown' THEN 'Unknown' WHEN path = 'syntactic' THEN 'Conservative' ELSE 'Exact' END AS semantic FROM p""")
def operation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.col("l_partkey") % 6 == 0
    p = N.precision(F.col("addr_kind"), ~F.col("lowerable"), F.col("value_top"), F.col("l_linenumber") % 3, F.when(other, "regmap"))
    s = N.semantic_precision(F.col("value_top"), F.col("l_linenumber") % 3, F.when(other, "unsupported_state"))
    return C.nodes(spark, sf_dir).select(*C.KEY, p.alias("p"), s["reliability"].alias("semantic")).select(*C.KEY, "p.*", "semantic")


_TEXTS = (
    "3 source MMIO access site(s) unaccounted", "2 RIS operation(s) lack source evidence", "1 source MMIO access site(s) explicitly filtered", "4 register operation(s) use unsupported access domain", "1 path predicate(s) not SMT-validated",
    "2 unsafe dynamic register address(es) (3 computed total)", "missing role for: a, b", "the missing role for: x", "linux backend has unsupported semantic bindings", "no MMIO register accesses", "7 synthesized subsystem callback(s) lack generic-backend execution oracle", "something else",
)
_CATEGORY = ("source_access_unaccounted", "ris_evidence_missing", "source_access_filtered", "unsupported_access", "path_unvalidated", "unsafe_dynamic_address", "missing_role", "unclassified", "linux_semantic_binding", "no_register_access", "subsystem_validation", "unclassified")


@query(f"""WITH b AS (SELECT o_custkey % 40 AS driver, {C.sql_pick(_CATEGORY, 'o_orderkey')} AS category FROM orders), n AS (SELECT category, count(DISTINCT driver) AS n_entities FROM b GROUP BY 1)
SELECT category, n_entities, category = (SELECT category FROM n WHERE n_entities >= 3 AND category NOT IN ('unclassified', 'linux_semantic_binding') ORDER BY n_entities DESC, category LIMIT 1) AS chosen FROM n""")
def blocker_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("driver"), N.blocker_category(C.pick(_TEXTS, "o_orderkey")).alias("category"))
    return R.cluster(b, "driver", "category", 3, ["unclassified", *N.UMBRELLA])


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderkey % 5 IN (3, 4)) AS errors, count(*) FILTER (o_orderkey % 3 = 0) AS target FROM orders GROUP BY 1""")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.concat(F.lit("clang diag["), F.expr("o_orderkey % 5"), F.lit("] "), F.when(F.col("o_orderkey") % 3 == 0, "/k/a.c").otherwise("/k/b.h"), F.lit(": text"))
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(N.is_error(w)).alias("errors"), F.count_if(N.is_target_diagnostic(w, F.lit("/k/a.c"))).alias("target"))


_REG = "kind IN ('Read', 'Write', 'ReadModifyWrite')"
_MODULES = f"""modules AS (SELECT driver, module, count(*) FILTER (kind IN ('Read', 'Write', 'ReadModifyWrite', 'Delay')) AS total_ops, count(*) FILTER ({_REG} AND addr_kind = 'symbolic') AS symbolic,
 count(*) FILTER ({_REG} AND addr_kind = 'fixed') AS fixed, count(*) FILTER ({_REG} AND addr_kind = 'computed') AS computed, count(*) FILTER ({_REG} AND addr_kind = 'computed' AND NOT lowerable) AS unsafe_computed,
 count(*) FILTER (kind = 'ReadModifyWrite') AS rmw, count(*) FILTER (kind IN ('Write', 'ReadModifyWrite') AND value_top) AS unknown_value, count(*) FILTER (kind = 'Cond') AS cond, count(*) FILTER (kind = 'Loop') AS loop,
 count(*) FILTER (kind = 'Loop' AND NOT coalesce(reliability = 'Exact' AND bounded, false)) AS conservative_loop FROM nodes GROUP BY 1, 2)"""
_PCT = "CAST(round_even({0}::DOUBLE / nullif({1}, 0), 3) AS DOUBLE)"


@query(f"WITH {C.NODES_SQL}, {_MODULES} SELECT *, {_PCT.format('symbolic', 'symbolic + fixed + computed')} AS pct_symbolic FROM modules")
def module_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.module_metrics(C.nodes(spark, sf_dir), ["driver", "module"])


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in Q.COUNTS)


@query(f"""WITH {C.NODES_SQL}, {_MODULES}, s AS (SELECT driver, {_SUMS}, count(*) AS modules FROM modules GROUP BY 1),
l AS (SELECT driver, {', '.join(f"count(*) FILTER ({_REG} AND coalesce(reliability, 'Unknown') = '{x}') AS {x.lower()}" for x in Q.LEVELS)} FROM nodes GROUP BY 1)
SELECT s.*, {_PCT.format('symbolic', 'symbolic + fixed + computed')} AS pct_symbolic, {_PCT.format('(total_ops - unknown_value)', 'total_ops')} AS pct_non_top_value, l.* EXCLUDE (driver) FROM s JOIN l USING (driver)""")
def driver_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.nodes(spark, sf_dir)
    return Q.driver_metrics(Q.module_metrics(n, ["driver", "module"]), n)


@query(f"""WITH {C.NODES_SQL} SELECT driver, count(*) FILTER (kind = 'Read') AS mmio_reads, count(*) FILTER (kind = 'Write') AS mmio_writes, count(*) FILTER (kind = 'ReadModifyWrite') AS rmw,
 count(*) FILTER (kind IN ('Cond', 'Loop')) AS conditions_recorded, count(*) FILTER ({_REG}) AS total_ops FROM nodes GROUP BY 1""")
def emitted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.emitted_stats(C.nodes(spark, sf_dir), ["driver"])


@query(f"""WITH {C.NODES_SQL}, p AS (SELECT DISTINCT driver, CASE WHEN kind = 'ReadModifyWrite' THEN 'rmw:' || addr WHEN kind IN ('Read', 'Write') AND addr_kind = 'fixed' AND "offset" <> 0 THEN 'at:' || "offset" END AS p FROM nodes),
m AS (SELECT 'd' || (s_suppkey % 20) AS driver, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1)
SELECT p.driver, CAST(count(p) + coalesce(max(n), 0) AS BIGINT) AS resolved FROM p LEFT JOIN m USING (driver) GROUP BY 1""")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    regs = read(spark, sf_dir, "supplier").select(F.expr("concat('d', s_suppkey % 20)").alias("driver"), F.col("s_nationkey").alias("name"))
    return Q.resolved_places(C.nodes(spark, sf_dir), regs)


@query("""WITH p AS (SELECT o_custkey % 30 AS driver, list_extract(['satisfiable', 'infeasible', 'unknown', 'satisfiable', 'intentionally_unreachable'], CAST(o_orderkey % (3 + o_custkey % 30) % 5 AS INT) + 1) AS s FROM orders),
c AS (SELECT o_custkey % 30 AS driver, o_custkey AS sw, o_orderkey AS o, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE [o_orderkey % 11, o_orderkey % 7 + 20] END AS v FROM orders),
q AS (SELECT a.driver, coalesce((a.v IS NULL OR len(a.v) > 0) AND (b.v IS NULL OR len(b.v) > 0) AND NOT (a.v IS NULL AND b.v IS NULL) AND NOT coalesce(list_has_any(a.v, b.v), false), false) AS e FROM c a JOIN c b ON a.sw = b.sw AND a.o < b.o),
n AS (SELECT driver, count(*) FILTER (NOT e) AS n FROM q GROUP BY 1)
SELECT driver, count(*) FILTER (s = 'satisfiable') AS satisfiable, count(*) FILTER (s = 'infeasible') AS infeasible, count(*) FILTER (s = 'unknown') AS unknown, count(*) FILTER (s = 'intentionally_unreachable') AS intentionally_unreachable,
 count(*) FILTER (s = 'unknown') = 0 AS complete, coalesce(max(n), 0) AS nonexclusive_switch_pairs FROM p LEFT JOIN n USING (driver) GROUP BY 1""")
def path_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("driver", F.col("o_custkey") % 30)
    paths = o.select("driver", C.pick(("satisfiable", "infeasible", "unknown", "satisfiable", "intentionally_unreachable"), "o_orderkey % (3 + o_custkey % 30)").alias("status"))
    values = F.expr("CASE o_orderkey % 6 WHEN 0 THEN cast(null AS array<bigint>) WHEN 1 THEN cast(array() AS array<bigint>) ELSE array(o_orderkey % 11, o_orderkey % 7 + 20) END")
    conds = o.select("driver", "o_custkey", "o_orderkey", values.alias("v"))
    return Q.path_totals(paths, Q.exclusive_pairs(conds, ["driver"], "o_custkey", "o_orderkey", "v"))


@query("""WITH t AS (SELECT o_custkey % 30 AS driver, list_extract(['goto', 'continue', 'break', 'return'], CAST(o_orderkey % 4 AS INT) + 1) AS k, o_orderkey % 3 = 0 AS m, o_orderkey % 5 = 0 AS l, o_orderkey % 7 < 4 AS sw, o_orderkey % 11 = 0 AS g, o_orderkey % 2 = 1 AS b, o_orderkey % 13 <> 0 AS r FROM orders),
g AS (SELECT driver, count(*) FILTER (k = 'return' AND m) AS modeled_early_returns, count(*) FILTER (k = 'goto' AND m) AS modeled_forward_gotos,
 count(*) FILTER ((k = 'goto' AND NOT m) OR (k = 'continue' AND l) OR (k = 'break' AND l AND NOT sw) OR (k = 'return' AND NOT m AND g AND b)) AS unsupported, count(*) FILTER (k = 'goto' AND NOT r) AS open FROM t GROUP BY 1),
e AS (SELECT l_suppkey % 25 AS driver, l_orderkey % 5 AS f, l_partkey % 6 AS src, l_partkey % 4 AS dst FROM lineitem), b AS (SELECT DISTINCT driver, f, src FROM e)
SELECT g.* EXCLUDE (open), coalesce((SELECT count(DISTINCT f) FROM b WHERE b.driver = g.driver), 0) AS function_count, coalesce((SELECT count(*) FROM b WHERE b.driver = g.driver), 0) AS block_count,
 coalesce((SELECT count(*) FROM e WHERE e.driver = g.driver), 0) AS edge_count, coalesce((SELECT count(*) FROM (SELECT driver, f, dst FROM e GROUP BY ALL HAVING count(DISTINCT src) > 1) j WHERE j.driver = g.driver), 0) AS join_count,
 unsupported = 0 AND open = 0 AS complete FROM g""")
def control_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    t = o.select((F.col("o_custkey") % 30).alias("driver"), C.pick(("goto", "continue", "break", "return"), "o_orderkey").alias("kind"), *[F.expr(x).alias(n) for n, x in (("modeled", "o_orderkey % 3 = 0"), ("in_register_loop", "o_orderkey % 5 = 0"), ("in_switch", "o_orderkey % 7 < 4"), ("guarded_by_parameters", "o_orderkey % 11 = 0"), ("before_register", "o_orderkey % 2 = 1"), ("resolved", "o_orderkey % 13 <> 0"))])
    e = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("driver"), (F.col("l_orderkey") % 5).alias("function"), (F.col("l_partkey") % 6).alias("src"), (F.col("l_partkey") % 4).alias("dst"))
    return Q.control_totals(t, e.select("driver", "function", "src").distinct(), e)


_FQ = "CASE WHEN has_facts THEN round_even(0.3 * (structs > 0)::INT + 0.3 * (callbacks > 0)::INT + 0.2 * (fact_resources > 0)::INT + 0.1 * (error_paths > 0)::INT + 0.1 * (helper_calls > 0)::INT, 3) ELSE 0 END"
_SCORED = f"""a AS (SELECT *, greatest(symbolic + fixed + computed, 1) AS n_addr, greatest(total_ops, 1) AS n_ops FROM rows_),
s AS (SELECT *, CAST(round_even(greatest(0, 0.5 * ((n_addr - unsafe_computed)::DOUBLE / n_addr) + 0.2 * (symbolic::DOUBLE / n_addr) + 0.2 * ((n_ops - unknown_value)::DOUBLE / n_ops) + 0.1 * CASE WHEN computed = 0 THEN 1.0 ELSE 0.5 END - least(0.2, clang_diag * 0.01)), 3) AS DOUBLE) AS ris_quality,
 CAST(coalesce(round_even(functions_with_role::DOUBLE / nullif(functions, 0), 3), 0) AS DOUBLE) AS function_spec_quality,
 CAST(round_even(0.5 * (least(register_map, 8)::DOUBLE / 8) + 0.3 * (resources_resolved::DOUBLE / greatest(resources, 1)) + 0.2 * (state_fields > 0)::INT, 3) AS DOUBLE) AS device_spec_quality, CAST({_FQ} AS DOUBLE) AS facts_quality,
 symbolic + fixed + computed > 0 OR subsystem_access AS access, unmodeled_callbacks = 0 AND unvalidated_callbacks = 0 AS generic FROM a),
g AS (SELECT *, strict_complete AND path_complete AND path_infeasible = 0 AND nonexclusive_switch_pairs = 0 AND access AND unsafe_computed = 0 AND unknown_value = 0 AND unsupported_ops = 0 AND unsupported_control = 0 AND conservative_loop = 0 AS base FROM s)"""
_TEXT_SQL = ", ".join(f"CASE WHEN {n} > 0 THEN {n} || ' {t}' END" for n, t in Q.COUNTED)


@query(f"""WITH {C.ROWS_SQL}, {_SCORED} SELECT driver, ris_quality, function_spec_quality, device_spec_quality, facts_quality, base AND generic AND ris_quality >= 0.7 AS harness_ready, base AND generic AND ris_quality >= 0.7 AS bare_metal_ready,
 base AND unmodeled_callbacks = 0 AND function_spec_quality >= 0.6 AND unbound IS NULL AS linux_ready, ris_quality >= 0.7 AND function_spec_quality >= 0.5 AND facts_quality >= 0.6 AND spec_registers > 0 AS llm_synthesis_ready,
 concat_ws('; ', {_TEXT_SQL}, CASE WHEN unsafe_computed > 0 THEN unsafe_computed || ' unsafe dynamic register address(es) (' || computed || ' computed total)' END, CASE WHEN unknown_value > 0 THEN unknown_value || ' unknown (Top) value(s)' END,
  CASE WHEN clang_diag > 0 THEN clang_diag || ' clang error diagnostic(s)' END, CASE WHEN conservative_loop > 0 THEN conservative_loop || ' conservative loop summary/summaries require validation' END, 'missing role for: ' || unroled, 'callback entry without table binding: ' || unbound,
  CASE WHEN NOT access THEN 'no MMIO register accesses' END, CASE WHEN unvalidated_callbacks > 0 AND NOT generic THEN unvalidated_callbacks || ' synthesized subsystem callback(s) lack generic-backend execution oracle' END) AS blockers FROM g""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Q.readiness(C.driver_rows(spark, sf_dir))
    return got.select("driver", "ris_quality", "function_spec_quality", "device_spec_quality", "facts_quality", "harness_ready", "bare_metal_ready", "linux_ready", "llm_synthesis_ready", F.array_join("blockers", "; ").alias("blockers"))


_RUN = "b % 7 <> 0 AS compiled, b % 11 = 0 AS has_todo, b % 13 = 0 AS unsupported_, b % 5 <> 0 AS trace_passed, b % 6 <> 0 AS syntax_ok, b % 2 = 0 AS callback_oracle, b % 9 <> 0 AS sources_ok"


@query(f"""WITH {C.ROWS_SQL}, {_SCORED}, r AS (SELECT *, {_RUN} FROM (SELECT p_partkey AS driver, backend, p_partkey + i AS b FROM part, (VALUES ('harness', 0), ('bare_metal', 1), ('linux', 2)) v(backend, i) WHERE (p_partkey + i) % 4 > 0)),
x AS (SELECT *, strict_complete AND path_complete AND path_infeasible = 0 AND nonexclusive_switch_pairs = 0 AND access AND unmodeled_callbacks = 0 AND unsafe_computed = 0 AND unknown_value = 0 AND unsupported_ops = 0 AND unsupported_control = 0 AS common, base AND generic AND ris_quality >= 0.7 AS plain FROM g),
j AS (SELECT x.driver, backend, common AND sources_ok AND compiled AND NOT has_todo AND NOT unsupported_ AS ran, conservative_loop, unvalidated_callbacks, callback_oracle, trace_passed, syntax_ok, function_spec_quality, unbound FROM x JOIN r USING (driver)),
v AS (SELECT driver, backend, ran AND CASE WHEN backend = 'linux' THEN function_spec_quality >= 0.6 AND unbound IS NULL AND syntax_ok ELSE conservative_loop = 0 AND (unvalidated_callbacks = 0 OR callback_oracle) AND (backend <> 'harness' OR trace_passed) END AS ok FROM j)
SELECT x.driver, coalesce((SELECT ok FROM v WHERE v.driver = x.driver AND backend = 'harness'), plain) AS harness_ready, coalesce((SELECT ok FROM v WHERE v.driver = x.driver AND backend = 'bare_metal'), plain) AS bare_metal_ready,
 coalesce((SELECT ok FROM v WHERE v.driver = x.driver AND backend = 'linux'), base AND unmodeled_callbacks = 0 AND function_spec_quality >= 0.6 AND unbound IS NULL) AS linux_ready FROM x""")
def backend_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("driver"), F.explode(F.expr("array(named_struct('b', 'harness', 'i', 0), named_struct('b', 'bare_metal', 'i', 1), named_struct('b', 'linux', 'i', 2))")).alias("v"))
    runs = s.select("driver", F.col("v.b").alias("backend"), (F.col("driver") + F.col("v.i")).alias("b")).where("b % 4 > 0").selectExpr("driver", "backend", *_RUN.replace("unsupported_", "unsupported").split(", "))
    return Q.backend_ready(Q.readiness(C.driver_rows(spark, sf_dir)), runs).select("driver", "harness_ready", "bare_metal_ready", "linux_ready")


_GATES = {
    "linked_alias_complete": "alias_complete", "all_translation_units_linked": "linked_units = units", "linked_bitcode_hashed": "bitcode_sha256 IS NOT NULL", "internal_calls_resolved": "unresolved_calls = 0", "access_accounting_strict": "strict_complete",
    "control_accounting_complete": "control_complete", "cfg_complete": "cfg_complete", "path_validation_complete": "path_complete", "path_validation_no_unknown": "path_unknown = 0", "path_validation_no_infeasible": "path_infeasible = 0",
    "switch_paths_exclusive": "nonexclusive_switch_pairs = 0", "operation_ids_unique": "op_ids = distinct_op_ids", "operation_evidence_complete": "ris_ops_without_evidence = 0", "computed_addresses_lowerable": "unsafe_computed = 0",
    "values_complete": "unknown_value = 0", "loops_proved": "conservative_loop = 0", "access_domains_supported": "unsupported_ops = 0",
}


@query(f"""WITH {C.ROWS_SQL} SELECT driver, {' AND '.join(f'({x})' for x in _GATES.values())} AS whole_program_complete, concat_ws(',', {', '.join(f"CASE WHEN NOT ({x}) THEN '{n}' END" for n, x in _GATES.items())}) AS failed FROM rows_""")
def program_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Q.program_gates(C.driver_rows(spark, sf_dir))
    return got.select("driver", "whole_program_complete", F.expr("array_join(transform(filter(map_entries(gates), e -> NOT e.value), e -> e.key), ',')").alias("failed"))


@query(f"""WITH {C.ROWS_SQL}, {_SCORED} SELECT count(*) AS n, CAST(round_even(avg(total_ops), 3) AS DOUBLE) AS mean_total_ops, CAST(round_even(avg(register_map), 3) AS DOUBLE) AS mean_register_map, count(*) FILTER (has_facts) AS has_facts, count(*) FILTER (strict_complete) AS strict_complete FROM rows_""")
def paper_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.paper_totals(C.driver_rows(spark, sf_dir), ["total_ops", "register_map"], ["has_facts", "strict_complete"])


_RECOVER = "concat('  x = ', {0}, '(a + (b, c), ', l_orderkey, '); /* ', {1}, '(q) */')"


@query(f"""SELECT {_K}, CASE WHEN l_linenumber % 3 = 0 THEN 'readl' WHEN l_partkey % 2 = 0 THEN 'readl_relaxed' ELSE 'ioread32' END AS name,
 CASE WHEN l_linenumber % 3 = 0 THEN 'kept' WHEN l_partkey % 2 = 0 THEN 'a + (b, c)|' || l_orderkey ELSE 'a + (b, c)|' || l_orderkey END AS args FROM lineitem""")
def recovered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = "CASE WHEN l_partkey % 2 = 0 THEN 'readl_relaxed' ELSE 'ioread32' END"
    line = F.expr(_RECOVER.format(used, "CASE WHEN l_partkey % 2 = 0 THEN 'writel' ELSE 'readb' END"))
    args = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("kept"))).otherwise(F.array(F.lit(""), F.lit(" ")))
    # a relaxed read keeps its width by the last letter of its name, as any other
    name = F.when(F.col("l_linenumber") % 3 == 0, "readl").when(F.col("l_partkey") % 2 == 0, "readb_relaxed").otherwise("readl")
    got = A.recovered_call(name, args, line)
    return read(spark, sf_dir, "lineitem").select(*C.KEY, got.alias("c")).select(*C.KEY, "c.name", F.array_join("c.args", "|").alias("args"))
