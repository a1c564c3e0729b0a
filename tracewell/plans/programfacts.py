"""Queries of facts on contract tables: functions, calls, names, bindings, sources, graphs of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import facts as P
from tracewell.operators import graphs as G
from tracewell.operators import oracles as O
from tracewell.plans import contracts as C
from tracewell.plans.registry import collector
from tracewell.plans.traces import read
from tracewell.sources.logs import build_command

QUERIES, ORACLE_SQL, query = collector()


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""SELECT o_orderkey, 'f' || o_orderkey AS name FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 2 = 0 AND o_orderkey % 7 > 0""")
def target_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "__inittest").otherwise(_text("f", F.col("o_orderkey"))).alias("name"), F.when(F.col("o_custkey") % 2 == 0, "/k/a.c").otherwise("/k/a.h").alias("source"), F.lit("/k/a.c").alias("target"), (F.col("o_orderkey") % 3 > 0).alias("is_definition"))
    return P.target_functions(f).select("o_orderkey", "name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, 'c' || l_suppkey) AS INT) AS call_no FROM lineitem""")
def ordered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").select(*C.KEY, F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("offset"), F.col("l_linenumber").alias("line"), _text("c", F.col("l_suppkey")).alias("callee"))
    return P.ordered_calls(s, ["caller"]).select(*C.KEY, "call_no")


@query("""SELECT p_partkey FROM part WHERE p_size % 5 > 0 AND p_partkey % 4 IN (0, 1)""")
def mapped_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "part").select("p_partkey", C.pick(("void __iomem *", "const void *", "int", "void (*)(int)"), "p_partkey").alias("ctype"), (F.col("p_size") % 5 > 0).alias("is_global"))
    return P.mapped_globals(v).select("p_partkey")


@query("""WITH r AS (SELECT p_brand AS unit, 'M' || (p_partkey % 30) AS name, p_partkey AS ord, CASE p_size % 3 WHEN 0 THEN '0x' || hex(p_partkey) WHEN 1 THEN 'BIT(' || (p_partkey % 40) || ')' ELSE 'other' END AS raw,
 CASE p_size % 3 WHEN 0 THEN p_partkey WHEN 1 THEN 1::BIGINT << CAST(p_partkey % 40 AS INT) END AS value, p_size % 7 = 0 AS fn FROM part)
SELECT unit, name, arg_min(raw, ord) AS raw, CASE WHEN NOT arg_min(fn, ord) THEN arg_min(CAST(coalesce(value, -1) AS BIGINT), ord) END AS value, arg_min(fn, ord) AS has_params FROM r GROUP BY 1, 2""")
def preprocessor_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("0x"), F.hex("p_partkey"))).when(F.col("p_size") % 3 == 1, _text("BIT(", F.col("p_partkey") % 40, ")")).otherwise("other")
    r = read(spark, sf_dir, "part").select(F.col("p_brand").alias("unit"), _text("M", F.col("p_partkey") % 30).alias("name"), F.col("p_partkey").alias("ord"), raw.alias("raw"), F.when(F.col("p_size") % 7 == 0, F.array(F.lit("x"))).alias("params"))
    got = P.preprocessor_macros(r, ["unit"])
    value = F.when(F.col("params").isNull(), F.coalesce("value", F.lit(-1)))
    return got.select("unit", "name", "raw", value.alias("value"), F.col("params").isNotNull().alias("has_params"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '/w/d' || p_partkey || '/a.c,/w/b.c' WHEN 1 THEN '/w/x.c,/k/y.c' WHEN 2 THEN '/w/src/main.c' END AS sources, CASE WHEN p_partkey % 5 = 0 THEN 'asked' WHEN p_size % 4 = 0 THEN 'multi' WHEN p_size % 4 = 1 THEN 'x' WHEN p_size % 4 = 2 THEN 'main' ELSE 'n' END AS name,
 CASE p_size % 4 WHEN 0 THEN '/w/d' || p_partkey || '/m.json' WHEN 1 THEN '/w/x.c;/k/y.c' WHEN 2 THEN '/w/src/main.c' ELSE '/w/bad.json' END AS descriptor, CASE WHEN p_size % 4 = 3 THEN 'manifest lacks sources' END AS problem FROM part""")
def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 4
    source = F.when(m == 0, _text("d", F.col("p_partkey"), "/m.json")).when(m == 2, "src/./main.c").when(m == 3, "bad.json")
    r = read(spark, sf_dir, "part").select(
        "p_partkey", source.alias("source"), F.when(m == 1, F.array(F.lit("x.c"), F.lit("/k/y.c"))).alias("source_list"), F.when(m == 0, '{"sources": ["a.c", "../b.c"], "name": "multi"}').when(m == 3, '{"name": "n"}').alias("manifest"),
        F.lit("/w").alias("cwd"), F.when(F.col("p_partkey") % 5 == 0, "asked").alias("driver_name"),
    )
    got = P.resolved_sources(r, "p_partkey")
    return got.select("p_partkey", F.array_join("sources", ",").alias("sources"), "name", "descriptor", "problem")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'cc -c db' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'gcc -O2 -c k' || s_suppkey || '.c' END AS command, CASE WHEN s_suppkey % 3 = 0 THEN 'compile-commands' WHEN s_suppkey % 3 = 1 THEN 'kbuild-cmd' END AS origin, CASE WHEN s_suppkey % 3 = 2 THEN 'no compile context found' END AS problem FROM supplier""")
def compile_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("source"))
    text = F.when(F.col("source") % 3 < 2, _text("x := y\nsavedcmd_k.o := gcc -O2 -c k", F.col("source"), ".c ; ./objtool\nother := 1\n")).otherwise("nothing := here")
    db = s.where("source % 3 = 0").select("source", _text("cc -c db", F.col("source")).alias("command"))
    return P.compile_contexts(s, db, s.select("source", build_command(text).alias("command")), "required").withColumnRenamed("source", "s_suppkey")


@query("""WITH c AS (SELECT l_orderkey AS f, count(*) FILTER (l_partkey % 3 < 2) AS n, max(CASE WHEN l_partkey % 3 < 2 THEN l_suppkey END) AS s, max(CASE WHEN l_partkey % 3 < 2 THEN l_partkey % 3 END) AS k, max(CASE WHEN l_partkey % 3 < 2 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS g FROM lineitem GROUP BY 1)
SELECT f, CASE k WHEN 0 THEN 'Read' ELSE 'Write' END AS kind, 4 AS width, CASE k WHEN 0 THEN 'base + ' || s ELSE 'dev->regs + 8' END AS address, CASE WHEN k = 1 THEN 'v' || s END AS value FROM c WHERE n = 1 AND g = 0""")
def wrapper_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    args = F.when(k == 0, F.array(_text("base + ", F.col("l_suppkey")))).otherwise(F.array(_text("v", F.col("l_suppkey")), F.lit("dev->regs + 8")))
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.when(k == 0, "readl").when(k == 1, "writel").otherwise("pr_info").alias("callee"), args.alias("args"), F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("x > 0"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("control"))
    params = F.expr("array(named_struct('name', 'base', 'ctype', 'void *'), named_struct('name', 'dev', 'ctype', 'struct foo *'))")
    functions = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("symbol"), _text("f", F.col("o_orderkey")).alias("name"), params.alias("params"))
    return P.wrapper_summaries(functions, calls).select(F.col("symbol").alias("f"), "kind", "width", "address", "value")


@query("""WITH a AS (SELECT 't' || (l_suppkey % 40) AS r, 'f' || (l_partkey % 60) AS d, 'fn' || (l_partkey % 60 + CASE WHEN l_suppkey % 40 = 7 THEN 1 ELSE 0 END) AS fn FROM lineitem WHERE l_partkey % 60 < 50),
k AS (SELECT r || '.' || d AS key, fn FROM a UNION ALL SELECT r || '->' || d, fn FROM a UNION ALL SELECT d, fn FROM a), t AS (SELECT key, min(fn) AS fn FROM k GROUP BY 1 HAVING count(DISTINCT fn) = 1)
SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, coalesce(x.fn, y.fn) AS resolved FROM lineitem c LEFT JOIN t x ON x.key = 't' || (c.l_suppkey % 40) || '->f' || (c.l_partkey % 60) LEFT JOIN t y ON y.key = 'f' || (c.l_partkey % 60)""")
def indirect_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    fn = _text("fn", F.col("l_partkey") % 60 + F.when(F.col("l_suppkey") % 40 == 7, 1).otherwise(0))
    a = li.select(_text("t", F.col("l_suppkey") % 40).alias("root"), _text("f", F.col("l_partkey") % 60).alias("field"), fn.alias("function"))
    known = spark.range(60).where("id <> 55").select(_text("fn", F.col("id")).alias("name"))
    a = a.where(F.regexp_extract("field", r"\d+", 0).cast("int") < 50)
    sites = li.select(*C.KEY, _text("t", F.col("l_suppkey") % 40, " -> f", F.col("l_partkey") % 60).alias("callee_text"), F.lit("").alias("callee"))
    return P.resolved_calls(sites, P.indirect_targets(a, known)).select(*C.KEY, "resolved")


@query("""WITH f AS (SELECT o_orderkey, o_custkey % 20 AS driver, 'f' || (o_orderkey % 9) AS name, '/k/s-' || (o_orderkey % 5) || '.c' AS source, o_orderkey AS line, o_orderkey % 4 > 0 AS is_static FROM orders),
w AS (SELECT *, count(*) OVER (PARTITION BY driver, name) AS n, count(*) FILTER (NOT is_static) OVER (PARTITION BY driver, name) AS e FROM f),
k AS (SELECT *, CASE WHEN is_static AND n > 1 THEN 's_' || (o_orderkey % 5) || '__' || name END AS b FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY driver, b ORDER BY source, line, name) AS i FROM k)
SELECT o_orderkey, CASE WHEN b IS NULL THEN name WHEN i = 1 THEN b ELSE b || '__' || i END AS module_name, e > 1 AS duplicate_externals FROM r""")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("driver"), _text("f", k % 9).alias("name"), _text("/k/s-", k % 5, ".c").alias("source"), k.alias("line"), (k % 4 > 0).alias("is_static"))
    return P.module_names(f, "driver").select("o_orderkey", "module_name", "duplicate_externals")


@query("""WITH o AS (SELECT l_suppkey % 20 AS driver, 'R' || (l_partkey % 40) AS name, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_quantity < 10 THEN NULL ELSE CAST(l_linenumber % 4 + 1 AS INT) END AS width FROM lineitem WHERE l_returnflag <> 'A'),
f AS (SELECT driver, name, width, row_number() OVER (PARTITION BY driver, name ORDER BY ord, width) AS n FROM o) SELECT driver, name, CAST(substr(name, 2) AS BIGINT) * 4 AS "offset", coalesce(width, 4) AS width FROM f WHERE n = 1 AND CAST(substr(name, 2) AS INT) % 3 > 0""")
def register_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    ops = li.select((F.col("l_suppkey") % 20).alias("driver"), F.when(F.col("l_returnflag") != "A", _text("R", F.col("l_partkey") % 40)).alias("reg_name"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.when(F.col("l_quantity") >= 10, F.col("l_linenumber") % 4 + 1).alias("w")).alias("ord"), F.when(F.col("l_quantity") >= 10, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("width"))
    macros = spark.range(40).where("id % 3 > 0").crossJoin(F.broadcast(spark.range(20).select(F.col("id").alias("driver")))).select("driver", _text("R", F.col("id")).alias("name"), (F.col("id") * 4).alias("value"))
    return P.register_maps(ops, macros, "driver")


@query("""SELECT c_custkey AS module, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'reset' ELSE 'unknown' END WHEN c_custkey % 4 = 0 THEN 'reset' WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'helper' END AS role,
 CASE WHEN c_custkey % 3 = 0 THEN 'ops.field' END AS callback_table, c_custkey % 5 = 0 AS is_entry, CASE WHEN c_custkey % 4 = 0 THEN 'resets_device()' END AS effect FROM customer WHERE c_custkey % 10 > 0""")
def function_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey")
    modules = c.select(_text("m", k).alias("module"))
    functions = c.where("c_custkey % 10 > 0").select(k.alias("symbol"), F.when(k % 4 == 0, "my_reset").otherwise("work").alias("name"), _text("m", k).alias("module_name"))
    bindings = c.where("c_custkey % 3 = 0").select(k.alias("symbol"), F.lit("unknown").alias("role"), F.lit("thread").alias("context"), F.lit("ops").alias("table"), F.lit("field").alias("field"))
    got = P.function_specs(modules, functions, bindings, c.where("c_custkey % 5 = 0").select(k.alias("symbol")))
    return got.select(F.col("symbol").alias("module"), "role", "callback_table", "is_entry", "effect")


@query("""SELECT coalesce(b.symbol, e.symbol) AS symbol, b.field, CASE WHEN b.symbol IS NULL THEN 'unbound' WHEN e.symbol IS NOT NULL THEN 'bound' END AS entry FROM (SELECT c_custkey AS symbol, 'f' || c_nationkey AS field FROM customer WHERE c_custkey % 3 = 0) b FULL JOIN (SELECT c_custkey AS symbol FROM customer WHERE c_custkey % 2 = 0) e USING (symbol)""")
def binding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    b = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("symbol"), _text("fn", F.col("c_custkey")).alias("function"), F.lit("t").alias("table"), _text("f", F.col("c_nationkey")).alias("field"), F.lit(1).alias("line"))
    return P.binding_report(b, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("symbol"))).select("symbol", "field", "entry")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 < 3 THEN 'prim' || (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = l_linenumber % 4) END AS concrete FROM lineitem""")
def bind_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "lineitem").select(*C.KEY, (F.col("l_linenumber") % 4).alias("op"))
    t = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_regionkey").cast("int").alias("op"), _text("prim", F.col("n_nationkey")).alias("concrete"), F.col("n_nationkey").alias("ord"))
    return P.bind_lookup(w, t, ["op"], "concrete").select(*C.KEY, "concrete")


@query("""SELECT p_partkey FROM part WHERE p_size % 4 IN (0, 1)""")
def mapping_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ir = C.pick(("%1 = call devm_ioremap(%2)", "load @my_mmio", "alloca i32", None), "p_size")
    return P.mapping_origins(read(spark, sf_dir, "part").select("p_partkey", ir.alias("ir")), spark.range(1).select(F.lit("my_mmio").alias("name"))).select("p_partkey")


@query("""SELECT DISTINCT driver, module, unnest(CASE WHEN l_partkey % 5 > 1 THEN ['dev' || (l_partkey % 5) || '->base', 'dev' || (l_partkey % 5)] ELSE ['mmio' || (l_partkey % 5)] END) AS base FROM (SELECT 'd' || (l_suppkey % 20) AS driver, 'm' || (l_orderkey % 50) AS module, l_partkey, l_quantity FROM lineitem) WHERE CAST(l_quantity AS BIGINT) % 4 = 0""")
def base_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_partkey") % 5
    return P.base_expressions(C.nodes(spark, sf_dir).withColumn("device", F.when(m > 1, _text("dev", m, "->base")).otherwise(_text("mmio", m))), ["driver", "module"])


@query("""SELECT o_custkey AS driver, 'b' || (o_orderkey % 3) AS base, arg_min(CAST(o_orderkey % 7 AS INT), o_orderkey) AS resource_index FROM orders GROUP BY 1, 2""")
def bound_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.struct(_text("b", F.col("o_orderkey") % 3).alias("base"), (F.col("o_orderkey") % 7).cast("int").alias("resource_index"))
    odd = F.struct(F.lit("x->y").alias("base"), F.lit(1).alias("resource_index"))
    s = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("driver"), F.col("o_orderkey").alias("ord"), F.create_map(F.lit("dat"), F.array(odd, e)).alias("fields"))
    return P.bound_resources(s, "driver")


@query("""SELECT n_nationkey, 'ops_' || n_nationkey AS table_name, 'enable=en2,recalc_rate=rate' || n_nationkey AS fields FROM nation UNION ALL SELECT n_nationkey, 'two', 'disable=off' FROM nation WHERE n_nationkey % 2 = 0""")
def clock_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = _text("static const struct clk_ops ops_", k, " = {\n .enable = en1, .recalc_rate = &rate", k, ",\n .enable = en2 };\nstruct other x = { .a = b };\n", F.when(k % 2 == 0, "struct clk_ops two = { .disable = off };").otherwise("struct clk_ops none = { };"))
    got = P.clock_groups(read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey")
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return got.select("n_nationkey", F.col("table").alias("table_name"), pairs.alias("fields"))


@query("""SELECT n_nationkey, 'linux/io.h,dev' || n_nationkey || '.h' AS includes, CASE WHEN n_nationkey % 2 = 0 THEN 'return -EINVAL,return PTR_ERR(p)' ELSE 'return -ENOMEM' END AS error_paths, CASE WHEN n_nationkey % 3 = 0 THEN 'bgpio_init' ELSE '' END AS helper_calls, CASE WHEN n_nationkey % 3 = 0 THEN 'devm_ioremap_resource,clk_get' ELSE 'platform_get_irq' END AS resources FROM nation""")
def device_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = _text("#include <linux/io.h>\n # include \"dev", k, ".h\"\nint f(void) {\n", F.when(k % 2 == 0, "return PTR_ERR(p);\nreturn -EINVAL; return -EINVAL;").otherwise("return -ENOMEM;"), F.when(k % 3 == 0, " bgpio_init(x); clk_get (y); devm_ioremap_resource(z);").otherwise(" my_clk_get(y); platform_get_irq(z);"), "\n}")
    got = P.device_facts(read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey")
    return got.select("n_nationkey", *[F.array_join(c, ",").alias(c) for c in ("includes", "error_paths", "helper_calls", "resources")])


@query("""SELECT p_brand AS driver, name, arg_min(p_partkey, p_partkey) AS value FROM (SELECT p_brand, p_partkey, CASE p_size % 6 WHEN 0 THEN 'CONFIG_X' WHEN 1 THEN 'GPIO_' || p_partkey WHEN 2 THEN '_HIDDEN' WHEN 3 THEN 'USED_' || p_partkey WHEN 4 THEN 'OTHER_' || p_partkey ELSE upper(split_part(p_brand, '#', 1)) || '_' || p_partkey END AS name, p_size FROM part)
WHERE p_size % 6 IN (1, 3) OR (p_size % 6 = 5) GROUP BY 1, 2""")
def device_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 6
    own = F.upper(F.substring_index("p_brand", "#", 1))
    name = F.when(m == 0, "CONFIG_X").when(m == 1, _text("GPIO_", F.col("p_partkey"))).when(m == 2, "_HIDDEN").when(m == 3, _text("USED_", F.col("p_partkey"))).when(m == 4, _text("OTHER_", F.col("p_partkey"))).otherwise(_text(own, "_", F.col("p_partkey")))
    macros = read(spark, sf_dir, "part").select(F.col("p_brand").alias("driver"), name.alias("name"), F.col("p_partkey").alias("value"))
    regs = macros.select("driver").distinct().select("driver", F.lit("GPIO_DIR").alias("name"))
    # a driver's own prefix is what its name begins with, up to the first other sign
    mine = macros.select("driver").distinct().select("driver", F.concat(F.upper(F.substring_index("driver", "#", 1)), F.lit("_REG")).alias("name"))
    return P.device_constants(macros, regs.union(mine), macros.where("startswith(name, 'USED_')").select("driver", "name"), "driver")


@query("""WITH c AS (SELECT s_suppkey AS case_id, 'drivers/a' || s_suppkey || '.c' AS source FROM supplier WHERE s_suppkey % 5 > 0), r AS (SELECT s_suppkey AS case_id, 'p' || (s_suppkey % 4) AS profile, 'drivers/a' || (s_suppkey - CASE WHEN s_suppkey % 6 = 0 THEN 1 ELSE 0 END) || '.o' AS target FROM supplier WHERE s_suppkey % 7 > 0)
SELECT case_id, unnest(list_filter([CASE WHEN r.profile IS NULL THEN 'case without a recipe' END, CASE WHEN source IS NULL THEN 'recipe without a case' END, CASE WHEN profile = 'p3' THEN 'missing profile p3' END,
 CASE WHEN source IS NOT NULL AND target IS NOT NULL AND case_id % 6 = 0 THEN 'target mismatch: expected drivers/a' || case_id || '.o, got ' || target END], lambda x: x IS NOT NULL)) AS issue FROM c FULL JOIN r USING (case_id)""")
def recipe_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier")
    cases = s.where("s_suppkey % 5 > 0").select(k.alias("case_id"), _text("drivers/a", k, ".c").alias("source"))
    recipes = s.where("s_suppkey % 7 > 0").select(k.alias("case_id"), _text("p", k % 4).alias("profile"), _text("drivers/a", k - F.when(k % 6 == 0, 1).otherwise(0), ".o").alias("target"))
    return P.recipe_issues(cases, recipes, spark.range(3).select(_text("p", F.col("id")).alias("profile")))


@query(r"""WITH i AS (SELECT unnest(['License', 'token']) AS ident) SELECT doc_id, ident AS identifier, CAST(length(regexp_replace(split_part(' ' || text || ' ', regexp_extract(' ' || text || ' ', '[^A-Za-z0-9]' || ident || '[^A-Za-z0-9]', 0), 1), '[^\n]', '', 'g')) + CASE WHEN starts_with(regexp_extract(' ' || text || ' ', '[^A-Za-z0-9]' || ident || '[^A-Za-z0-9]', 0), chr(10)) THEN 1 ELSE 0 END + 1 AS INT) AS line
 FROM documents, i WHERE regexp_matches(' ' || text || ' ', '[^A-Za-z0-9]' || ident || '[^A-Za-z0-9]')""")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), ["License", "token"], "doc_id")


# ---------------------------------------------------------------- graphs of calls

_CALLS = "c AS (SELECT l_partkey % 300 AS caller, l_suppkey % 300 AS callee, l_linenumber AS pos FROM lineitem), fn AS (SELECT DISTINCT p_partkey % 300 AS symbol FROM part WHERE p_partkey % 300 % 7 > 0)"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("caller"), (F.col("l_suppkey") % 300).alias("callee"), F.col("l_linenumber").alias("pos"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("symbol")).where("symbol % 7 > 0").distinct()


@query(f"WITH {_CALLS}, e AS (SELECT DISTINCT caller, callee FROM c WHERE callee IN (SELECT symbol FROM fn)) SELECT caller, callee, callee % 3 = 0 AS propagates FROM e")
def call_edges_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.target_calls(_sites(spark, sf_dir), _functions(spark, sf_dir))
    p = G.propagating_edges(e, spark.range(300).where("id % 3 = 0").select(F.col("id").alias("symbol"))).withColumn("propagates", F.lit(True))
    return e.join(p, ["caller", "callee"], "left").withColumn("propagates", F.coalesce("propagates", F.lit(False)))


@query(f"WITH {_CALLS} SELECT DISTINCT callee AS symbol FROM c WHERE caller <> callee AND callee % 3 = 0 AND callee % 5 > 0")
def called_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(300).select(F.col("id").alias("symbol"))
    return G.called_helpers(_sites(spark, sf_dir), n.where("symbol % 3 = 0"), n.where("symbol % 5 = 0"))


@query(f"""WITH {_CALLS}, s AS (SELECT caller, callee, count(*) AS n FROM c WHERE caller <> callee AND callee IN (SELECT symbol FROM fn) GROUP BY 1, 2), o0 AS (SELECT symbol, symbol % 4 AS n FROM fn),
o1 AS (SELECT f.symbol, f.symbol % 4 + coalesce((SELECT sum(s.n * o.n) FROM s JOIN o0 o ON o.symbol = s.callee WHERE s.caller = f.symbol), 0) AS n FROM fn f),
o2 AS (SELECT f.symbol, f.symbol % 4 + coalesce((SELECT sum(s.n * o.n) FROM s JOIN o1 o ON o.symbol = s.callee WHERE s.caller = f.symbol), 0) AS n FROM fn f),
t AS (SELECT 0 AS depth, sum(n) AS t FROM o0 UNION ALL SELECT 1, sum(n) FROM o1 UNION ALL SELECT 2, sum(n) FROM o2)
SELECT depth, CAST(CASE WHEN depth = 0 THEN t ELSE greatest(0, t - lag(t) OVER (ORDER BY depth)) END AS BIGINT) AS new_ops, CAST(t AS BIGINT) AS total_ops FROM t""")
def summary_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _functions(spark, sf_dir)
    return G.summary_propagation(f.select("symbol", (F.col("symbol") % 4).alias("own_ops")), _sites(spark, sf_dir).select("caller", "callee"), 2)


_PURE = "f AS (SELECT DISTINCT o_orderkey % 500 AS symbol FROM orders), e AS (SELECT symbol, (symbol * 7 + 3) % 500 AS callee FROM f WHERE symbol % 3 > 0), p0 AS (SELECT symbol FROM f WHERE symbol % 5 > 0 AND symbol % 11 > 0)"


@query(f"""WITH RECURSIVE {_PURE}, bad0 AS (SELECT symbol FROM f WHERE NOT (symbol % 5 > 0 AND symbol % 11 > 0) UNION SELECT e.symbol FROM e WHERE callee NOT IN (SELECT symbol FROM p0) OR e.symbol % 13 = 0),
bad AS (SELECT symbol FROM bad0 UNION SELECT e.symbol FROM e JOIN bad ON e.callee = bad.symbol) SELECT symbol, 'f' || symbol AS name FROM f WHERE symbol NOT IN (SELECT symbol FROM bad)""")
def pure_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("symbol")
    f = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("symbol")).distinct()
    callee = _text("f", (k * 7 + 3) % 500)
    text = F.when((k % 3 > 0) & (k % 13 != 0), F.concat(callee, F.lit(" (x) + 1"))).otherwise("x + 1")
    functions = f.select("symbol", _text("f", k).alias("name"), F.when(k % 5 > 0, text).alias("return_expr"), F.when(k % 11 == 0, 1).otherwise(0).alias("n_ops"))
    return G.pure_functions(functions, f.where("symbol % 3 > 0").select(k.alias("caller"), callee.alias("callee")))


_INLINE = """ops AS (SELECT DISTINCT p_partkey % 100 AS symbol, CAST(p_size % 3 * 2 AS INT) AS pos FROM part), calls AS (SELECT DISTINCT p_partkey % 100 AS caller, CAST(p_size % 4 * 2 + 1 AS INT) AS pos, (p_partkey * 3 + p_size) % 100 AS callee FROM part WHERE p_size % 2 = 0)"""


@query(f"""WITH RECURSIVE {_INLINE}, roots AS (SELECT symbol AS root FROM ops UNION SELECT caller FROM calls), x AS (SELECT root, root AS symbol, [] ::INT[] AS path, [root] AS chain, 0 AS level FROM roots
UNION ALL SELECT x.root, c.callee, list_append(x.path, c.pos), list_append(x.chain, c.callee), level + 1 FROM x JOIN calls c ON c.caller = x.symbol WHERE level < 2 AND NOT list_contains(x.chain, c.callee))
SELECT root, array_to_string(list_append(path, ops.pos), '.') AS path, 's' || ops.symbol AS op, level FROM x JOIN ops ON ops.symbol = x.symbol""")
def inlined_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    ops = p.select((F.col("p_partkey") % 100).alias("symbol"), (F.col("p_size") % 3 * 2).cast("int").alias("pos")).distinct().withColumn("op", _text("s", F.col("symbol")))
    calls = p.where("p_size % 2 = 0").select((F.col("p_partkey") % 100).alias("caller"), (F.col("p_size") % 4 * 2 + 1).cast("int").alias("pos"), ((F.col("p_partkey") * 3 + F.col("p_size")) % 100).alias("callee")).distinct()
    return G.inlined(ops, calls, 2).withColumn("path", F.array_join("path", "."))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS s, p_partkey // 2 AS d FROM part WHERE p_partkey > 0), r AS (SELECT CAST(7 AS BIGINT) AS root, s AS node, 1 AS depth FROM e WHERE d = 7 UNION ALL SELECT root, e.s, depth + 1 FROM r JOIN e ON r.node = e.d) SELECT root, node, depth FROM r""")
def backward_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("s"), F.expr("p_partkey div 2").alias("d"))
    return G.reach(e, "d", "s", roots=spark.range(7, 8).select(F.col("id").alias("root")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey > o_orderkey THEN 'goto-forward' ELSE 'goto-backward' END AS kind FROM orders")
def goto_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", G.goto_kind(F.col("o_orderkey"), F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey"))).alias("kind"))


@query("""WITH s AS (SELECT l_orderkey AS caller, 'f' || (l_partkey % 50) AS callee, CASE WHEN l_linenumber % 3 > 0 THEN 's' || (l_partkey % 60) END AS symbol, l_suppkey % 5 AS unit FROM lineitem), f AS (SELECT 's' || i AS symbol, 'f' || (i % 45) AS name, i % 5 AS unit FROM range(50) r(i)),
n AS (SELECT name, min(unit) AS u FROM f GROUP BY 1 HAVING count(*) = 1), j AS (SELECT s.*, coalesce(f.unit, n.u) AS t FROM s LEFT JOIN f USING (symbol) LEFT JOIN n ON n.name = s.callee)
SELECT CASE WHEN t IS NULL THEN 'unresolved' WHEN t = unit THEN 'same unit' ELSE 'other unit' END AS how, count(*) AS n FROM j GROUP BY 1""")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), _text("f", F.col("l_partkey") % 50).alias("callee"), F.when(F.col("l_linenumber") % 3 > 0, _text("s", F.col("l_partkey") % 60)).alias("symbol"), (F.col("l_suppkey") % 5).alias("unit"))
    f = spark.range(50).select(_text("s", F.col("id")).alias("symbol"), _text("f", F.col("id") % 45).alias("name"), (F.col("id") % 5).alias("unit"))
    return G.resolved_edges(s, f).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT 'f' || (l_partkey % 90) AS symbol FROM lineitem WHERE l_partkey % 90 < 70 AND NOT (l_linenumber % 2 = 0)""")
def callback_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "lineitem").select(*C.KEY, _text("f", F.col("l_partkey") % 90).alias("symbol"))
    return G.callback_entries(refs, refs.where("l_linenumber % 2 = 0"), spark.range(70).select(_text("f", F.col("id")).alias("symbol")), C.KEY, "symbol")


@query("""WITH a AS (SELECT p_brand AS k, min(p_size) AS v FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), b AS (SELECT p_brand AS k, min(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.k IS NULL THEN 1 ELSE 0 END AS part FROM a FULL JOIN b USING (k)""")
def merged_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_size").alias("v"), "p_partkey")
    return O.merged_first([p.where("p_partkey % 3 = 0"), p.where("p_partkey % 2 = 0")], "k", "v")


@query("""SELECT o_orderkey, CAST(0 AS INT) AS pos, 'Write' AS kind, '(d' || o_custkey || ') + REG' AS address, 'v' || o_orderkey || ' | p->v' AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'c' ELSE 'on' END AS guard FROM orders WHERE o_orderkey % 3 > 0""")
def instantiated_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    args = F.array(_text("(d", F.col("o_custkey"), ")"), _text("v", k), F.lit("c"))
    calls = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 > 0, "set").otherwise("unknown").alias("callee"), F.when(k % 2 == 0, args).otherwise(F.slice(args, 1, 2)).alias("args"))
    functions = spark.range(1).select(F.lit("set").alias("symbol"), F.array(F.lit("dev"), F.lit("v"), F.lit("on")).alias("params"))
    ops = spark.range(1).select(F.lit("set").alias("symbol"), F.lit(0).alias("pos"), F.lit("Write").alias("kind"), F.lit("dev + REG").alias("address"), F.lit("v | p->v").alias("value"), F.lit("on").alias("guard"))
    return P.instantiated(calls, ops, functions).select("o_orderkey", "pos", "kind", "address", "value", "guard")


@query("""SELECT 'source hash drift for c' || s_suppkey AS issue FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'missing holdout source of c' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT 'holdout specialization my_dev in f' || n_nationkey || ':2' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'new drivers specialization(s): x1, x3'""")
def guard_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 4 != 1, _text("int x", k, ";"))
    cases = read(spark, sf_dir, "supplier").select(_text("c", k).alias("case_id"), F.sha2(F.concat(text, F.when(k % 4 == 0, " ").otherwise("")).cast("binary"), 256).alias("source_sha256"), text.alias("text"), F.array(F.lit("my_dev")).alias("identifiers"))
    files = read(spark, sf_dir, "nation").select(_text("f", F.col("n_nationkey")).alias("path"), F.when(F.col("n_nationkey") % 5 == 0, "int a;\nuse(my_dev);").otherwise("not_my_device my_dev1").alias("text"))
    values = spark.range(1, 4).select(F.lit("drivers").alias("category"), _text("x", F.col("id")).alias("value"))
    return P.guard_issues(cases, files, values, values.where("value = 'x2'"), "c2")
