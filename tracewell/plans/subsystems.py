"""Queries of subsystem summaries, contracts, loop proofs, old listings, fingerprints and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import annotations as N
from tracewell.operators import relational as R
from tracewell.operators import summaries as S
from tracewell.plans import contracts as C
from tracewell.plans.registry import collector
from tracewell.plans.traces import read

QUERIES, ORACLE_SQL, query = collector()


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_FIELDS = ("read_l", "read_w", "read_b", "write_l", "write_w", "write_b", "set_clock")


def _shown(op: str = "op"):
    return F.concat_ws("|", F.col(f"{op}.kind"), F.col(f"{op}.width").cast("string"), *[F.coalesce(f"{op}.{c}", F.lit("")) for c in ("address", "field", "var", "value", "guard")])


@query(f"""WITH b AS (SELECT p_partkey, {C.sql_pick(_FIELDS, 'p_partkey')} AS f, p_size % 2 = 0 AS big, 'r' || p_size AS r, 'v' || p_partkey AS v FROM part),
m AS (SELECT *, '(' || r || ') == (SDHCI_TRANSFER_MODE)' AS tm, '(' || r || ') == (SDHCI_COMMAND)' AS cm, '((' || r || ') & 0x3) * 8' AS s8, '((' || r || ') & 0x2) * 8' AS s16 FROM b),
o AS (SELECT p_partkey, CASE WHEN f IN ('read_l', 'read_w', 'read_b') THEN ['Read|' || CASE f WHEN 'read_l' THEN 4 WHEN 'read_w' THEN 2 ELSE 1 END || '|host->ioaddr + ' || CASE WHEN big AND f = 'read_w' THEN '((' || r || ') ^ 0x2)' WHEN big AND f = 'read_b' THEN '((' || r || ') ^ 0x3)' ELSE r END || '||value||', 'Return|0||||value|']
 WHEN f = 'write_l' OR (f IN ('write_w', 'write_b') AND NOT big) THEN ['Write|' || CASE f WHEN 'write_l' THEN 4 WHEN 'write_w' THEN 2 ELSE 1 END || '|host->ioaddr + ' || r || '|||' || v || '|']
 WHEN f = 'write_b' THEN ['ReadModifyWrite|4|host->ioaddr + ((' || r || ') & ~0x3)||__old|((__old & ~(0xff << (' || s8 || '))) | (((' || v || ') & 0xff) << (' || s8 || ')))|']
 WHEN f = 'write_w' THEN ['StateWrite|2||xfer_mode_shadow||' || v || '|' || tm, 'StateRead|2||xfer_mode_shadow|__xfer_mode_shadow||' || cm, 'Write|4|host->ioaddr + SDHCI_TRANSFER_MODE|||((' || v || ') << 16) | __xfer_mode_shadow|' || cm,
  'ReadModifyWrite|4|host->ioaddr + ((' || r || ') & ~0x3)||__old|((__old & ~(0xffff << (' || s16 || '))) | (((' || v || ') & 0xffff) << (' || s16 || ')))|!((' || tm || ') || (' || cm || '))'] ELSE [] END AS ops FROM m)
SELECT p_partkey, CAST(generate_subscripts(ops, 1) - 1 AS INT) AS ord, unnest(ops) AS op FROM o""")
def accessor_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    callee = F.when(F.col("p_size") % 2 == 0, "sdhci_be32bs_readl").otherwise("sdhci_readl")
    ops = S.accessor_operations(C.pick(_FIELDS, "p_partkey"), callee, F.lit("host->ioaddr"), _text("r", F.col("p_size")), _text("v", F.col("p_partkey")))
    return p.select("p_partkey", F.posexplode(ops).alias("ord", "op")).select("p_partkey", "ord", _shown().alias("op"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND p_size % 2 = 0 THEN 'private' WHEN p_partkey % 5 = 1 THEN 'delegate' WHEN p_partkey % 5 = 2 THEN 'public' ELSE 'unmodeled' END AS route FROM part""")
def accessor_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "part").select("p_partkey", F.lit("ops").alias("table"), F.when(F.col("p_size") % 2 == 0, "read_w").otherwise("platform_init").alias("field"), C.pick(("own_read", "sdhci_reset", "sdhci_readw", "elsewhere", "sdhci_unknown"), "p_partkey").alias("callee"))
    return S.routed_accessors(e, spark.range(1).select(F.lit("own_read").alias("name"))).select("p_partkey", "route")


_QUEUE = ("virtqueue_add_inbuf_cache_clean", "virtqueue_add_outbuf", "virtqueue_get_buf", "virtqueue_detach_unused_buf", "virtqueue_get_vring_size", "virtqueue_kick", "other_call")


@query(f"""WITH b AS (SELECT o_orderkey, o_custkey % 3 AS c, {C.sql_pick(_QUEUE, 'o_orderkey')} AS q, 'x' || o_custkey AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'Read' ELSE 'Write' END AS k FROM orders),
o AS (SELECT o_orderkey, CASE WHEN c = 0 AND k = 'Read' THEN ['StateRead|2||virtio_cfg_u_size|' || v || '||g'] WHEN c = 0 THEN ['StateWrite|2||virtio_cfg_u_size||w|g']
 WHEN c = 1 THEN CASE q WHEN 'virtqueue_kick' THEN ['StateWrite|4||virtio_evt_notified||1|g'] WHEN 'virtqueue_add_inbuf_cache_clean' THEN ['StateRead|4||virtio_evt_available|__virtio_evt_available||g', 'StateWrite|4||virtio_evt_available||(__virtio_evt_available) + 1|g']
  WHEN 'virtqueue_add_outbuf' THEN ['StateRead|4||virtio_evt_outstanding|__virtio_evt_outstanding||g', 'StateWrite|4||virtio_evt_outstanding||(__virtio_evt_outstanding) + 1|g']
  WHEN 'virtqueue_get_buf' THEN ['StateRead|4||virtio_evt_completed|' || v || '||g', 'StateWrite|4||virtio_evt_completed||((' || v || ') > 0 ? (' || v || ') - 1 : 0)|g']
  WHEN 'virtqueue_detach_unused_buf' THEN ['StateRead|4||virtio_evt_outstanding|' || v || '||g', 'StateWrite|4||virtio_evt_outstanding||((' || v || ') > 0 ? (' || v || ') - 1 : 0)|g'] WHEN 'virtqueue_get_vring_size' THEN ['StateRead|4||virtio_evt_queue_depth|' || v || '||g'] ELSE [k || '|2|a||' || v || '|w|g'] END ELSE [k || '|2|a||' || v || '|w|g'] END AS ops FROM b)
SELECT o_orderkey, CAST(generate_subscripts(ops, 1) - 1 AS INT) AS sub, unnest(ops) AS op FROM o""")
def state_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    read_ = S.operation("Read", 2, "a", None, _text("x", F.col("o_custkey")), "w", "g")
    ops = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(0).alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, read_).otherwise(read_.withField("kind", F.lit("Write"))).alias("op"), F.when(k == 0, "linux.virtio_config").when(k == 1, "linux.virtqueue").otherwise("other").alias("contract"),
        F.lit("offsetof(struct cfg, u.Size)").alias("member"), C.pick(_QUEUE, "o_orderkey").alias("queue_operation"), F.lit("virtio_evt").alias("prefix"),
    )
    return S.state_rewritten(ops, ["o_orderkey"]).select("o_orderkey", "sub", _shown().alias("op"))


@query("""SELECT c_custkey, 'dat:' || CASE WHEN c_custkey % 3 = 0 THEN 'b + 4,b + 8' ELSE 'b + 4' END AS fields FROM customer""")
def config_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda o, x: F.struct(F.lit(o).alias("ord"), F.lit("dat").alias("field"), x.alias("expr"), F.expr("cast(array() AS array<string>)").alias("conditions"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.inline(F.array(e(0, F.lit("b + 4")), e(1, F.lit("b + 4")), e(2, F.when(F.col("c_custkey") % 3 == 0, "b + 8").otherwise("b + 4")))))
    return S.config_fields(rows, ["c_custkey"]).select("c_custkey", _text(F.col("field"), ":", F.array_join(F.transform("values", lambda v: v["expr"]), ",")).alias("fields"))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 7 = 0 THEN 'guard is not two MMIO reads' WHEN p_partkey % 11 = 0 THEN 'body is not one acknowledge write' ELSE concat_ws('; ', CASE WHEN p_partkey % 2 = 0 THEN 'ack does not target pending register' END,
 CASE WHEN p_partkey % 3 = 0 THEN 'ack lacks W1C semantics' END, CASE WHEN p_partkey % 5 = 0 THEN 'guard value is not pending & mask' END, CASE WHEN p_partkey % 13 = 0 THEN 'bound lacks explicit quiescence assumption' END) END) AS errors FROM part""")
def drain_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = lambda *x: F.array(*map(F.lit, x))
    loops = read(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 7 == 0, kinds("Read", "Write")).otherwise(kinds("Read", "Read")).alias("guard_kinds"), F.when(k % 11 == 0, kinds("Read")).otherwise(kinds("Write")).alias("body_kinds"), F.lit("PEND").alias("pending_addr"), F.lit("p").alias("pending_var"), F.lit("m").alias("mask_var"),
        F.when(k % 2 == 0, "OTHER").otherwise("PEND").alias("ack_addr"), F.when(k % 3 > 0, "w1c").alias("write_semantics"), F.when(k % 5 == 0, "(m & p)").otherwise("(p & m)").alias("guard_value"), F.when(k % 13 == 0, 2).otherwise(1).alias("max_iterations"), kinds("quiet").alias("assumptions"),
    )
    return loops.select("p_partkey", F.array_join(S.drain_errors(loops), "; ").alias("errors"))


_STATE = ("virtio_cfg_select", "virtio_cfg_subsel", "virtio_cfg_size", "virtio_evt_available", "virtio_evt_completed", "virtio_sts_outstanding", "virtio_evt_notified", "virtio_sts_notified", "ready", "other")
_MODULES = ("m_probe", "m_remove", "m_freeze", "m_restore")


@query(f"""WITH o AS (SELECT o_custkey % 60 AS driver, {C.sql_pick(_MODULES, 'o_orderkey // 10')} AS module, CASE WHEN o_orderkey % 3 > 0 THEN 'StateWrite' ELSE 'StateRead' END AS kind, {C.sql_pick(_STATE, 'o_orderkey')} AS field, CAST(o_custkey // 60 % 2 AS BIGINT) AS value, CASE WHEN o_orderkey % 97 = 0 THEN 'Unknown' ELSE 'Exact' END AS reliability FROM orders),
l AS (SELECT s_suppkey % 60 AS driver, s_suppkey % 7 > 0 AS ok, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE 8 END AS n FROM supplier)
SELECT d.driver, (SELECT count(*) FROM o WHERE o.driver = d.driver) AS ops, concat_ws('; ', (SELECT string_agg(DISTINCT module || ':' || field || ' is not reliable', '; ' ORDER BY module || ':' || field || ' is not reliable') FROM o WHERE o.driver = d.driver AND reliability = 'Unknown'),
 {', '.join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.driver = d.driver AND field = '{f}') THEN 'missing virtio state field {f}' END" for f in _STATE[:-1])},
 CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.driver = d.driver AND kind = 'StateWrite' AND field = 'virtio_evt_notified') THEN 'event queue notify transition is missing' END, CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.driver = d.driver AND kind = 'StateWrite' AND field = 'virtio_sts_notified') THEN 'status queue notify transition is missing' END,
 {', '.join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.driver = d.driver AND kind = 'StateWrite' AND field = 'ready' AND module = 'm_{m}' AND value = {v}) THEN '{m} lifecycle does not {'restore' if v else 'clear'} ready' END" for m, v in (('remove', 0), ('freeze', 0), ('probe', 1), ('restore', 1)))},
 CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.driver = d.driver) THEN 'virtqueue/config loops are not represented' END, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.driver = d.driver AND NOT ok) THEN 'virtio loop lacks an exact finite bound' END,
 (SELECT string_agg('virtio loop bound ' || n || ' exceeds source limit', '; ' ORDER BY n) FROM (SELECT DISTINCT n FROM l WHERE l.driver = d.driver AND n > 64))) AS errors FROM (SELECT DISTINCT driver FROM o) d""")
def state_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 60).alias("driver"), C.pick(_MODULES, "o_orderkey div 10").alias("module"), F.when(F.col("o_orderkey") % 3 > 0, "StateWrite").otherwise("StateRead").alias("kind"), C.pick(_STATE, "o_orderkey").alias("field"),
        F.expr("o_custkey div 60 % 2").alias("value"), F.when(F.col("o_orderkey") % 97 == 0, "Unknown").otherwise("Exact").alias("reliability"),
    )
    loops = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("driver"), F.lit("Exact").alias("reliability"), (F.col("s_suppkey") % 7 > 0).alias("bounded"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).otherwise(8).alias("count"))
    return S.state_contract(o, loops).select("driver", "ops", F.array_join("errors", "; ").alias("errors"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 3 > 0 THEN '(pend & mask)' END AS drain, CASE WHEN o_orderkey % 3 > 0 AND o_custkey % 2 = 0 THEN 'i<dev->n' || o_custkey END AS bound FROM orders""")
def loop_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(F.lit("Read"), F.lit("Read"), F.lit("Write"))
    drain = S.drain_proof(F.when(k % 4 > 0, "while").otherwise("for"), F.when(c % 3 > 0, "(st = pend & mask)").otherwise("pend & mask"), kinds, F.lit("P"), F.lit("P"), F.lit("st"), F.lit("pend"), F.lit("mask"))
    bound = S.state_bound(F.when(k % 3 == 1, "unsigned int i = 0;").when(k % 3 == 2, "i = 0").otherwise("i = 1"), _text("i < dev->n", c), F.when(c % 2 == 0, "i++").otherwise("i += 2"))
    return read(spark, sf_dir, "orders").select("o_orderkey", drain["guard_value"].alias("drain"), _text(bound["var"], "<", bound["bound"]).alias("bound"))


@query("""WITH m AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN ['mask_it'] WHEN 1 THEN ['get_x', 'set_x'] ELSE ['probe', 'get_y'] END AS mods, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY 1, 2),
e AS (SELECT user_id, user_id % 3 AS k, CASE WHEN user_id % 5 = 0 THEN NULL ELSE t END AS t FROM m), g AS (SELECT *, list_position(t, 'view') AS p FROM e), h AS (SELECT *, CASE WHEN p > 0 THEN coalesce(list_position(t[p + 1 :], 'click'), 0) ELSE 0 END AS q FROM g)
SELECT user_id, CASE WHEN k = 0 THEN 'vacuous' WHEN t IS NULL THEN 'empty' WHEN q > 0 THEN 'ok' ELSE 'missing' END AS verdict, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS checked, CASE WHEN k = 0 OR t IS NULL OR q = 0 THEN 0 WHEN k = 1 THEN 2 ELSE 1 END AS passed FROM h""")
def legacy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.operators import traces as T

    per = T.ordered_items(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "actual")
    m = F.col("user_id") % 3
    names = F.when(m == 0, F.array(F.lit("mask_it"))).when(m == 1, F.array(F.lit("get_x"), F.lit("set_x"))).otherwise(F.array(F.lit("probe"), F.lit("get_y")))
    modules = per.select("user_id", F.explode(names).alias("module"), F.array(F.lit("view"), F.lit("click")).alias("expected"))
    traced = per.select("user_id", F.when(F.col("user_id") % 5 > 0, F.col("actual")).alias("actual"))
    return S.legacy_verdicts(modules, traced, "user_id", ["get", "set"]).select("user_id", "verdict", F.col("checked").cast("int").alias("checked"), F.col("passed").cast("int").alias("passed"))


@query("""WITH c AS (SELECT o_custkey % 20 AS d, CASE o_orderkey % 3 WHEN 0 THEN 'unknown_value' WHEN 1 THEN 'missing_role' ELSE 'unclassified' END AS category, CASE o_orderkey % 3 WHEN 0 THEN '1 unknown (Top) value(s)' WHEN 1 THEN 'missing role for: x' ELSE 'odd' END AS t FROM orders)
SELECT category, count(DISTINCT d) AS n_entities, CAST(count(*) AS BIGINT) AS texts FROM c GROUP BY 1""")
def blocker_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.pick(("1 unknown (Top) value(s)", "missing role for: x", "odd"), "o_orderkey")
    b = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("driver"), t.alias("text"), N.blocker_category(t).alias("category"))
    got = S.clusters_with_evidence(b, "driver", "category", "text")
    return got.select("category", "n_entities", F.expr("aggregate(map_values(evidence), 0L, (a, x) -> a + size(x))").alias("texts"))


@query(r"""SELECT l_orderkey, sha256('[' || string_agg('{"kind":"' || l_returnflag || '","value":' || CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE '"a|' || l_partkey || '\"b"' END || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']') AS fingerprint FROM lineitem GROUP BY 1""")
def semantic_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") % 2 > 0, _text("a|", F.col("l_partkey"), '"b'))
    n = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("kind"), value.alias("value"), F.monotonically_increasing_id().alias("op_id"), F.lit("Exact").alias("reliability"))
    return S.semantic_fingerprint(n, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""SELECT s_suppkey, s_suppkey % 3 > 0 AS context, s_suppkey % 4 > 0 AS compiled, s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 6 > 0 AND s_suppkey % 7 > 0 AND s_suppkey % 8 > 0 AND s_suppkey % 9 > 0 AS accepted FROM supplier""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    runs = read(spark, sf_dir, "supplier").select(
        "s_suppkey", (k % 5 > 0).alias("guard_passed"), F.when(k % 3 > 0, "kbuild-cmd").alias("origin"), F.when(k % 6 > 0, 0).otherwise(2).alias("target_errors"), F.when(k % 7 > 0, True).alias("strict_complete"),
        F.array(F.lit(True), F.when(k % 4 > 0, True)).alias("compiled"), (k % 8 > 0).alias("semantic_equal"), k.alias("functions_before"), F.when(k % 9 > 0, k).alias("functions_after"),
    )
    return S.acceptance(runs, "s_suppkey").select("s_suppkey", F.col("imported_context_found").alias("context"), F.col("all_backends_compile").alias("compiled"), "accepted")


@query("""SELECT n_nationkey, '1|read,3|x,3|ready=' || (n_nationkey % 2) || ',7|write' AS listing FROM nation""")
def lifecycle_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    op = lambda line, ord, kind: F.struct(F.lit(line).alias("line"), F.lit(ord).alias("ord"), S.operation(kind, 4).cast(S.OP).alias("op"))
    ops = n.select("n_nationkey", F.inline(F.array(op(1, 0, "read"), op(3, 1, "x"), op(7, 2, "write"))))
    ready = n.select("n_nationkey", F.lit(3).alias("line"), F.when(F.col("n_nationkey") % 2 == 1, "vi->ready = true;").otherwise("vi->ready = false").alias("text"), F.lit(None).cast("string").alias("guard"))
    got = S.with_lifecycle(ops, ready.union(ready.withColumn("text", F.lit("vi->steady = true"))), ["n_nationkey"])
    row = F.struct("line", "ord", F.when(F.col("op.field") == "ready", _text(F.col("line"), "|ready=", F.col("op.value"))).otherwise(_text(F.col("line"), "|", F.col("op.kind"))).alias("t"))
    return got.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(row))["t"], ",").alias("listing"))


@query("""WITH m AS (SELECT p_brand, count(*) AS src, count(*) FILTER (p_size < 5) AS direct, sum(p_size) AS ris FROM part GROUP BY 1) SELECT p_brand, CAST(round_even(least(direct, src)::DOUBLE / src, 4) AS DOUBLE) AS coverage, CAST(round_even(ris::DOUBLE / nullif(direct, 0), 4) AS DOUBLE) AS amplification FROM m""")
def coverage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("src"), F.count_if(F.col("p_size") < 5).alias("direct"), F.sum("p_size").alias("ris"))
    return m.select("p_brand", R.ratio(F.least("direct", "src"), F.col("src")).alias("coverage"), R.ratio(F.col("ris"), F.col("direct")).alias("amplification"))
