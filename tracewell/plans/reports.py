"""Queries of reports: texts written and read back, documents, nesting, rows of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.operators import facts as P
from tracewell.operators import graphs as G
from tracewell.operators import oracles as O
from tracewell.operators import quality as Q
from tracewell.operators import traces as T
from tracewell.plans import contracts as C
from tracewell.plans.accounts import _MODULES, _SCORED
from tracewell.plans.registry import collector
from tracewell.plans.traces import read
from tracewell.sources import aliases as A
from tracewell.sources import builds as B
from tracewell.sources import listings as K
from tracewell.sources import logs as L
from tracewell.sources import programs as D
from tracewell.sources import reports as W

QUERIES, ORACLE_SQL, query = collector()


@query(f"""WITH {C.NODES_SQL}, {_MODULES} SELECT driver, CAST(sum(total_ops) AS INT) AS ops, CAST(sum(symbolic) AS INT) AS symbolic, CAST(sum(cond) AS INT) AS conditions, 7 AS clang_diagnostics, count(*) + 4 AS lines FROM modules GROUP BY 1""")
def metrics_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as text, read back."""
    n = C.nodes(spark, sf_dir)
    m = Q.module_metrics(n, ["driver", "module"])
    text = W.metrics_text(Q.driver_metrics(m, n).withColumns({"clang_diag": F.lit(7), "register_map": F.lit(3)}), m)
    got = L.metrics(text, "driver").join(text.select("driver", F.size(F.split("text", "\n")).cast("long").alias("lines")), "driver")
    return got.select("driver", *[F.col(c) for c in ("ops", "symbolic", "conditions", "clang_diagnostics", "lines")])


@query(f"""WITH {C.ROWS_SQL}, {_SCORED}, n AS (SELECT driver, unnest(['ris_quality', 'facts_quality', 'backend_linux_ready']) AS name, unnest([CAST(ris_quality AS VARCHAR), CAST(facts_quality AS VARCHAR), CASE WHEN base AND unmodeled_callbacks = 0 AND function_spec_quality >= 0.6 AND unbound IS NULL THEN 'True' ELSE 'False' END]) AS v FROM g)
SELECT driver, name, CASE v WHEN 'True' THEN true WHEN 'False' THEN false END AS flag, TRY_CAST(v AS DOUBLE) AS number FROM n""")
def score_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as text, read back as typed values."""
    text = W.score_text(Q.readiness(C.driver_rows(spark, sf_dir)), "driver")
    got = L.scores(L.lines(text, "driver"), "driver").where(F.col("name").isin("ris_quality", "facts_quality", "backend_linux_ready"))
    return got.select("driver", "name", W.typed_value(F.col("value")).alias("v")).select("driver", "name", "v.flag", "v.number")


@query("""SELECT n_nationkey, unnest(['include', 'type', 'callback', 'export', 'state', 'primitive']) AS kind, unnest(['<linux/io.h>', 'DeviceState', 'irq_chip.irq_ack', 'interrupt_ack', 'dev.base', 'MmioRead(B4)']) AS name,
 unnest([NULL, 'struct d' || n_nationkey, 'ack', 'my_ack', 'g->base', 'readl']) AS target FROM nation""")
def binding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding blocks as text, read back."""
    row = lambda o, k, n, t: F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.lit(n).alias("name"), (F.lit(t) if not isinstance(t, type(F.lit(1))) else t).cast("string").alias("target"))
    rows = F.array(row(5, "primitive", "MmioRead(B4)", "readl"), row(0, "include", "<linux/io.h>", None), row(1, "type", "DeviceState", F.concat(F.lit("struct d"), F.col("n_nationkey").cast("string"))), row(2, "callback", "irq_chip.irq_ack", "ack"), row(3, "export", "interrupt_ack", "my_ack"), row(4, "state", "dev.base", "g->base"))
    b = read(spark, sf_dir, "nation").select("n_nationkey", F.lit("linux").alias("backend"), F.lit("dev").alias("device"), F.inline(rows))
    return K.bindings(L.lines(W.binding_block(b, ["n_nationkey"]), "n_nationkey"), "n_nationkey").select("n_nationkey", "kind", "name", "target")


@query("""SELECT o_custkey AS driver, '{"driver":"' || o_custkey || '","version":1,"modules":[' || string_agg('{"name":"m' || o_orderkey || '","status":"' || o_orderstatus || '","role":null}', ',' ORDER BY o_orderkey) || ']}' AS text FROM orders GROUP BY 1""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("driver"), "o_orderkey", F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("role"))
    return W.json_documents(m, "driver", ["name", "status", "role"], ["o_orderkey"])


@query(r"""SELECT 'TotalOps' AS name, '\newcommand{\TotalOps}{' || count(*) || '}' AS line FROM lineitem UNION ALL SELECT 'Share', '\newcommand{\Share}{50\%}'""")
def paper_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.paper_macros(read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("total_ops"), F.lit("50%").alias("share")))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS a, CASE WHEN l_linenumber % 4 > 0 THEN l_linestatus END AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
g AS (SELECT *, CASE WHEN lag(a) OVER w IS DISTINCT FROM a THEN r END AS oa, CASE WHEN b IS NOT NULL AND (lag(a) OVER w IS DISTINCT FROM a OR lag(b) OVER w IS DISTINCT FROM b) THEN r END AS ob FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY r))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(oa IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY r ROWS UNBOUNDED PRECEDING) || CASE WHEN b IS NOT NULL THEN '.' || last_value(ob IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY r ROWS UNBOUNDED PRECEDING) ELSE '' END AS inside FROM g""")
def nested_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.array_compact(F.array("l_returnflag", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_linestatus"))))
    df = read(spark, sf_dir, "lineitem").select(*C.KEY, s.alias("stack"))
    return T.nested(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "stack").select(*C.KEY, F.array_join(F.transform("inside", lambda x: x.cast("string")), ".").alias("inside"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS ops, CASE WHEN s_suppkey % 3 = 0 THEN 'p' || (s_suppkey % 2) END AS profile, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'arm' END AS arch,
 concat_ws(',', CASE WHEN s_suppkey % 2 = 1 THEN 'metrics' END, CASE WHEN s_suppkey % 5 > 0 THEN 'score' END) AS failed FROM supplier""")
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    cases = s.select(k.alias("case_id"))
    recipes = s.where("s_suppkey % 3 = 0").select(k.alias("case_id"), F.concat(F.lit("p"), (k % 2).cast("string")).alias("profile"))
    profiles = spark.range(1).select(F.lit("p0").alias("profile"), F.lit("arm").alias("arch"))
    rows = P.run_rows(P.case_profiles(cases, recipes, profiles), "case_id", {"metrics": s.where("s_suppkey % 2 = 0").select(k.alias("case_id"), F.col("s_nationkey").alias("ops")), "score": s.where("s_suppkey % 5 = 0").select(k.alias("case_id"), F.lit(1).alias("q"))})
    return rows.select(F.col("case_id").alias("s_suppkey"), F.col("metrics.ops").alias("ops"), "profile", "arch", F.array_join("failed", ",").alias("failed"))


@query("""SELECT DISTINCT c_nationkey AS driver, unnest(CASE c_custkey % 3 WHEN 0 THEN ['version'] WHEN 1 THEN ['ready', 'features'] ELSE [] END) AS field FROM customer""")
def state_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = C.pick(("dev->version", "v.ready & v->features", "version"), "c_custkey")
    v = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("driver"), name.alias("name"))
    return P.state_fields(v, "driver", {"version": "UInt", "ready": "Bool", "features": "UInt64"}).select("driver", "field")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""SELECT p_partkey, 'g->base=' || (p_size % 4) || ',x=1' AS bindings, CASE WHEN p_size % 3 > 0 THEN '4660,' || p_partkey END AS ids, p_size % 2 = 0 AS listed, 3 AS lines, 2 AS non_blank, 'a();' || chr(10) || 'c();' || chr(10) AS cleaned, 2 AS calls FROM part""")
def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource indexes, device ids, build lists, line counts, dropped calls and counted calls of source texts."""
    k, m = F.col("p_partkey"), F.col("p_size")
    bind = R.resource_bindings(_text("x = devm_platform_ioremap_resource(pdev, 0);\n g -> base = devm_platform_ioremap_resource(pdev, ", m % 4, ");\nx = devm_platform_ioremap_resource(pdev, 1);"))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(bind), lambda e: _text(e["key"], "=", e["value"]))), ",")
    ids = R.device_ids(_text("{ PCI_DEVICE(0x1234, ", F.when(m % 3 > 0, "MY_DEV").otherwise("OTHER"), ") }"), F.create_map(F.lit("MY_DEV"), k))
    lines = R.line_counts(F.lit("a\n\n b\n"))
    code = R.code_only(F.lit('readl(x); /* readl(y) */ "readl(z)" ; // readl(w)\nwritel (1, x); my_readl(q);'))
    return read(spark, sf_dir, "part").select(
        "p_partkey", pairs.alias("bindings"), F.array_join(ids.cast("array<string>"), ",").alias("ids"), R.sources_listed(F.when(m % 2 == 0, "obj-y += a.o b.o").otherwise("obj-y += a.o"), F.array(F.lit("/k/a.c"), F.lit("/k/b.c"))).alias("listed"),
        lines["lines"].alias("lines"), lines["non_blank"].alias("non_blank"), R.without_calls(_text("a();\n  writel(", k, ", base + DMA_LINE);\nc();\n"), "DMA_LINE").alias("cleaned"), R.call_count(code, ("readl", "writel")).alias("calls"),
    )


@query("""SELECT n_nationkey, '/k/d' || n_nationkey || '/a.c' AS source, 'gcc,-c,a b' AS tokens FROM nation UNION ALL SELECT n_nationkey, '/abs/b.c', CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation) THEN 'cc' END FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)""")
def compile_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = _text('[{"file": "a.c", "command": "gcc -c \'a b\'"}, {"file": "./a.c", "command": "second"}, {"file": "/abs/b.c", "arguments": ["cc"]}]')
    files = read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"), F.format_string("/k/d%d", k).alias("directory"))
    got = B.compile_commands(files).select("source", F.array_join("tokens", ",").alias("tokens"))
    own = F.regexp_extract("source", r"^/k/d(\d+)/", 1)
    least = files.agg(F.min("n_nationkey").alias("_k"))
    return got.crossJoin(F.broadcast(least)).select(F.coalesce(F.nullif(own, F.lit("")).cast("bigint"), F.col("_k")).alias("n_nationkey"), "source", "tokens")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'not a manifest' WHEN 1 THEN 'schema' WHEN 2 THEN 'too few sources' WHEN 3 THEN 'not C' END AS problem, CASE WHEN n_nationkey % 5 = 4 THEN '/m/Kbuild' END AS build_file FROM nation""")
def source_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("n_nationkey") % 5
    ok = '{"schema": 1, "name": "n", "sources": ["a.c", "b.c", "c.c", "d.c"], "kbuild": "x/../Kbuild"}'
    text = F.when(m == 0, "{}").when(m == 1, ok.replace("1,", "2,", 1)).when(m == 2, '{"schema": 1, "name": "n", "sources": ["a.c"]}').when(m == 3, ok.replace("b.c", "b.h")).otherwise(ok)
    got = B.manifests(read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"), F.lit("/m").alias("directory")), "n_nationkey")
    return got.select("n_nationkey", "problem", F.when(F.col("problem").isNull(), F.col("build_file")).alias("build_file"))


_DOC = '{"register_map": [{"name": "CTRL", "offset": 4}], "modules": [{"name": "m", "ops": [{"Cond": {"then_ops": [{"Read": {"var": "a", "addr": {"Symbolic": {"register": "CTRL"}}}}], "else_ops": [{"Seq": {"ops": [{"Write": {"addr": {"Fixed": {"offset": %}}}}]}}]}}, {"Loop": {"body": [{"Read": {"addr": {"Symbolic": {"register": "NONE"}}}}]}}]}]}'


@query("""SELECT n_nationkey, 'Cond:|Read:4|Seq:|Write:' || (n_nationkey * 4) || '|Loop:|Read:' AS nodes, CASE WHEN n_nationkey % 2 = 0 THEN 'Cond|Read' ELSE 'Cond|Seq|Write' END AS pruned FROM nation""")
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node tables of documents with the offsets of named registers, and what is left of them after a filter on leaves."""
    head, tail = _DOC.split("%")
    docs = read(spark, sf_dir, "nation").select("n_nationkey", _text(head, F.col("n_nationkey") * 4, tail).alias("text"))
    nodes = D.placed(D.op_nodes(docs, "n_nationkey"), D.register_map(docs, "n_nationkey"), "n_nationkey")
    listed = lambda df, t, name: df.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("node_id", t.alias("t"))))["t"], "|").alias(name))
    wanted = F.when(F.col("n_nationkey") % 2 == 0, F.col("kind") == "Read").otherwise(F.col("kind") == "Write")
    left = G.pruned(nodes, ["n_nationkey", "module"], wanted)
    return listed(nodes, _text(F.col("kind"), ":", F.coalesce(F.col("offset").cast("string"), F.lit(""))), "nodes").join(listed(left, F.col("kind"), "pruned"), "n_nationkey")


@query("""SELECT mutation, cases, caught, cases = caught AS complete FROM (SELECT 'add' AS mutation, count(*) AS cases, count(*) AS caught FROM orders UNION ALL SELECT 'mask', count(*), count(*) FILTER (o_custkey & 1 = 1) FROM orders)""")
def mutation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("v"))
    mutants = base.select("o_orderkey", F.explode(F.array(F.struct(F.lit("add").alias("mutation"), (F.col("v") + 1).alias("v")), F.struct(F.lit("mask").alias("mutation"), F.col("v").bitwiseAND(F.lit(-2).cast("bigint")).alias("v")))).alias("m")).select("o_orderkey", "m.*")
    return O.mutations_caught(base, mutants, ["o_orderkey"], "mutation", "v")


@query("""SELECT n_nationkey, unnest([3, 4, 5, 5]) AS line_no, CAST(1 AS BIGINT) AS call_no, unnest(['W', 'result', 'output', 'output']) AS kind, unnest([NULL, NULL, 'a', 'b']) AS name, unnest([16, NULL, NULL, NULL]) AS "offset", unnest([n_nationkey, 255, 1, n_nationkey]) AS value FROM nation""")
def value_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.lower(F.hex("n_nationkey"))
    text = _text("[t-begin]\n[t] m\n[trace 1] W 0x10 = 0x", k, "\n[t-result] 0xff\n[t-output] a=0x1 b=0x", k, "\n[t-end]\n[trace 2] R 0x1 = 0x2")
    got = L.value_traces(L.lines(read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey"), "n_nationkey", "t")
    return got.select("n_nationkey", F.col("line_no").cast("int").alias("line_no"), "call_no", "kind", "name", "offset", "value")


@query("""SELECT n_nationkey, 'fn' || n_nationkey AS function, CAST(n_nationkey + 1 AS INT) AS line, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS BIGINT) AS origin FROM nation""")
def alias_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second variable of each report: its place, and the known origin that it may be an alias of."""
    k = F.col("n_nationkey")
    text = _text('1 var1[m@probe] %a = call devm_ioremap { "ln": 3, "fl": "a.c" }\n2 var2[m@fn', k, '] %b { "ln": ', k + 1, ', "fl": "a.c" }\n', F.when(k % 2 == 0, "MayAlias var2[q] -- var1[p]").otherwise("NoAlias var2[q] -- var1[p]"))
    lines = L.lines(read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey")
    s = A.symbols(lines, "n_nationkey")
    origins = P.mapping_origins(s.withColumnRenamed("code", "ir"), spark.range(0).select(F.lit("g").alias("name"))).select("n_nationkey", "var")
    found = A.aliased(A.pairs(lines, "n_nationkey"), origins, "n_nationkey").select("n_nationkey", F.col("alias_var").alias("var"), F.col("origin_var").alias("origin"))
    return s.where("var = 2").join(found, ["n_nationkey", "var"], "left").select("n_nationkey", "function", "line", "origin")
