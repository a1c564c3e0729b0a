"""Queries on source texts, position automata and long logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import accesses
from tracewell.operators import automata as M
from tracewell.operators import facts as P
from tracewell.plans.contracts import pick, sql_pick
from tracewell.plans.registry import collector
from tracewell.plans.traces import read
from tracewell.sources import code as K
from tracewell.sources import places as L

QUERIES, ORACLE_SQL, query = collector()


@query("""WITH r AS (SELECT doc_id, text, k, (doc_id * 37 + k * 101) % (length(text) + 1) AS c, k * 13 + 5 AS n FROM documents, range(4) t(k) WHERE text IS NOT NULL),
x AS (SELECT *, left(text, c::INT) AS before FROM r)
SELECT doc_id, k, substring(text, (c + 1)::INT, n::INT) AS slice, CAST(1 + length(before) - length(replace(before, chr(10), '')) AS INT) AS line, CAST(strlen(string_split(before, chr(10))[-1]) + 1 AS BIGINT) AS "column" FROM x""")
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    chars = docs.select("doc_id", "text", F.explode(F.expr("sequence(0L, 3L)")).alias("k")).withColumn("c", F.expr("(doc_id * 37 + k * 101) % (length(text) + 1)"))
    refs = chars.select("doc_id", "k", F.expr("cast(octet_length(left(text, cast(c AS int))) AS bigint)").alias("begin"), F.expr("cast(octet_length(left(text, cast(c + k * 13 + 5 AS int))) AS bigint)").alias("end"))
    return L.source_slices(docs, refs, "doc_id").select("doc_id", "k", "slice", "line", "column")


CODE = ("ret = readl(base + é);", "  u32 val = ioread8(x);", "p->dev . x =", "  readw(q);", "if (readl(a) == 3)", "unsigned long *v = readq(b);", "x == readl(y);", "writel(1, b); s.f = my_call (c);", "y = = readl(z);", "\tsome -> where =  ")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each document with nine lines of code after its text."""
    lines = F.concat_ws("\n", *[pick(CODE, f"doc_id * 7 + {j} * (doc_id % 5 + 1)") for j in range(9)])
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), lines).alias("text"))


_LINES = f"""s AS (SELECT doc_id, concat_ws(chr(10), coalesce(text, ''), {', '.join(sql_pick([c.replace(chr(9), '	') for c in CODE], f'doc_id * 7 + {j} * (doc_id % 5 + 1)') for j in range(9))}) AS text FROM documents),
l AS (SELECT doc_id, i AS line, ls[i] AS t, CASE WHEN i > 1 THEN ls[i - 1] ELSE '' END AS b FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM s)))"""
_PLACE = "[A-Za-z_]\\w*(?:\\s*(?:->|\\.)\\s*\\w+)*"
_ASSIGNED = f"""coalesce(CASE WHEN contains(t, callee) THEN coalesce(nullif(replace(regexp_extract(t, '^\\s*({_PLACE})\\s*=([^=]|$)', 1), ' ', ''), ''), nullif(regexp_extract(t, '^\\s*(?:[A-Za-z_]\\w*\\s+)+(?:\\*+\\s*)?([A-Za-z_]\\w*)\\s*=([^=]|$)', 1), '')) END, nullif(replace(regexp_extract(b, '^\\s*({_PLACE})\\s*=\\s*$', 1), ' ', ''), ''))"""


@query(f"""WITH {_LINES}, n AS (SELECT doc_id, max(line) AS n FROM l GROUP BY 1), c AS (SELECT doc_id, n - j AS line, ['readl', 'readw', 'my_call', 'ioread8', 'readq'][(doc_id + j) % 5 + 1] AS callee, j FROM n, range(12) t(j))
SELECT c.doc_id, c.j, c.callee, {_ASSIGNED} AS assigned FROM c LEFT JOIN l USING (doc_id, line)""")
def call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sources(spark, sf_dir)
    last = files.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"), F.explode(F.expr("sequence(0L, 11L)")).alias("j"))
    calls = last.select("doc_id", "j", (F.col("n") - F.col("j")).cast("int").alias("line"), pick(("readl", "readw", "my_call", "ioread8", "readq"), "doc_id + j").alias("callee"))
    return L.call_targets(files, calls, "doc_id").select("doc_id", "j", "callee", "assigned")


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, line, t, b, unnest(regexp_extract_all(t, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS callee FROM l)
SELECT doc_id, line, callee, {_ASSIGNED} AS assigned, CASE callee WHEN 'readl' THEN 'read' WHEN 'readw' THEN 'read' WHEN 'readq' THEN 'read' WHEN 'ioread8' THEN 'read' WHEN 'writel' THEN 'write' END AS access_kind
FROM c WHERE callee NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof')""")
def source_access_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = L.source_calls(_sources(spark, sf_dir), "doc_id")
    return calls.select("doc_id", F.col("line").cast("long").alias("line"), "callee", "assigned", accesses.kind(F.col("callee")).alias("access_kind"))


#: An order is a module: a line is an access, one that may be left out, or one of two.
_ITEM = "CASE (l_partkey + l_linenumber) % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'maybe' ELSE 'either' END"


@query(f"""WITH RECURSIVE i AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, {_ITEM} AS item, CASE WHEN l_suppkey % 2 = 0 THEN 'R' ELSE 'W' END || (l_partkey % 3) AS a, CASE WHEN l_suppkey % 3 = 0 THEN 'R' ELSE 'W' END || (l_suppkey % 3) AS b FROM lineitem),
v AS (SELECT DISTINCT o, 0::BIGINT AS n, ''::VARCHAR AS s FROM i UNION ALL SELECT v.o, i.n, v.s || u.x FROM v JOIN i ON i.o = v.o AND i.n = v.n + 1, LATERAL (SELECT unnest(CASE item WHEN 'plain' THEN [a] WHEN 'maybe' THEN [a, ''] ELSE [a, b] END) AS x) u),
f AS (SELECT DISTINCT o, s FROM v WHERE n = (SELECT max(i.n) FROM i WHERE i.o = v.o) AND s <> ''),
t AS (SELECT o, string_agg(CASE WHEN (n + o) % 2 = 0 THEN a ELSE b END, '' ORDER BY n DESC) || string_agg(CASE WHEN (n + o) % 3 = 0 THEN b ELSE a END, '' ORDER BY n) AS t FROM i GROUP BY o),
m AS (SELECT f.o, f.s, t.t, 0 AS k, 0 AS p FROM f JOIN t USING (o) UNION ALL SELECT o, s, t, CASE WHEN s[k * 2 + 1:k * 2 + 2] = t[p * 2 + 1:p * 2 + 2] AND k * 2 < length(s) THEN k + 1 ELSE k END, p + 1 FROM m WHERE p * 2 < length(t)),
r AS (SELECT o, s, max(k) AS k, length(s) // 2 AS n FROM m GROUP BY ALL), b AS (SELECT o, max({{'c': k = n, 'k': k, 'l': k - n}}) AS b FROM r GROUP BY o)
SELECT o AS l_orderkey, b.c AS complete, CAST(b.k AS INT) AS matched, CAST(-b.l AS INT) AS missing FROM b""")
def automaton_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), F.expr(_ITEM).alias("item"), *[F.struct(F.when(F.col("l_suppkey") % d == 0, "R").otherwise("W").alias("kind"), F.expr(f"{k} % 3").alias("offset")).alias(name) for name, d, k in (("a", 2, "l_partkey"), ("b", 3, "l_suppkey"))])
    name = lambda c: F.when(c["kind"] == "R", "Read").otherwise("Write")
    node = lambda j, parent, depth, branch, kind, offset: F.struct((F.col("n") * 3 + j).alias("node_id"), parent.cast("int").alias("parent_id"), F.lit(depth).alias("depth"), F.lit(branch).alias("branch"), F.col("n").alias("ord"), kind.alias("kind"), offset.cast("long").alias("offset"))
    none, above = F.lit(None), F.col("n") * 3
    a, b = F.col("a"), F.col("b")
    plain = F.array(node(0, none, 0, "body", name(a), a["offset"]))
    maybe = F.array(node(0, none, 0, "body", F.lit("Cond"), none), node(1, above, 1, "then", name(a), a["offset"]))
    either = F.concat(maybe, F.array(node(2, above, 1, "else", name(b), b["offset"])))
    nodes = i.select("l_orderkey", F.inline(F.when(F.col("item") == "plain", plain).when(F.col("item") == "maybe", maybe).otherwise(either)))
    down = F.reverse(F.array_sort(F.collect_list(F.struct("n", F.when((F.col("n") + F.col("l_orderkey")) % 2 == 0, a).otherwise(b).alias("x")))))["x"]
    up = F.array_sort(F.collect_list(F.struct("n", F.when((F.col("n") + F.col("l_orderkey")) % 3 == 0, b).otherwise(a).alias("x"))))["x"]
    actual = i.groupBy("l_orderkey").agg(F.concat(down, up).alias("actual"))
    got = actual.join(M.automata(nodes, ["l_orderkey"]).where("positions IS NOT NULL"), "l_orderkey").select("l_orderkey", M.matched(F.col("actual"), F.col("positions"), F.col("shortest")).alias("m"))
    return got.select("l_orderkey", "m.complete", "m.matched", "m.missing")


_WANTED = ("view", "click", "view", "purchase", "signup", "click", "view")


@query(f"""WITH RECURSIVE s AS (SELECT user_id, event_type AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events),
c AS (SELECT user_id, k + 1 AS k, {sql_pick(_WANTED, 'user_id + k * (1 + user_id % 3)')} AS name FROM (SELECT DISTINCT user_id FROM events), range(9) t(k)),
r AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS seg FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT r.user_id, c.k, (SELECT min(s.seg) FROM s WHERE s.user_id = r.user_id AND s.name = c.name AND s.seg > r.seg) FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)
SELECT user_id, k AS call_no, seg FROM r WHERE k > 0""")
def long_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    seg = ev.select("user_id", F.col("event_type").alias("name"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seg"))
    calls = ev.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(0L, 8L)")).alias("k")).select("user_id", (F.col("k") + 1).alias("call_no"), pick(_WANTED, "user_id + k * (1 + user_id % 3)").alias("name"))
    return M.aligned(calls, seg, "user_id").select("user_id", "call_no", "seg")


#: Lines of checked code by number; what a comment or a longer string holds does not count.
_PROGRAM = (
    "x = '# no comment'  # dev == 'gone'", "if os.path.basename(source) == \"a{0}.c\":", "'''", "dev == 'quoted'", "'''", "    return dev == 'd{1}' or device_spec.name == \"n{0}\"", "PRIVATE_MMIO_READ_LAYOUTS = {{", "    'r{1}': {{'base': 0, 'deep': [1, {{'deeper': 2}}]}},  # 'no': 1",
    "    \"s{0}\": (1, 2), 't': dict(u=1),", "}}", "OTHER = {{'other': 1}}", "y = \"\"\"open", "dev == 'inside'", "\"\"\"; z = dev == 'after{1}'",
)


@query("""SELECT DISTINCT * FROM (SELECT 'source_basename_equals' AS category, 'a' || (p_partkey % 50) || '.c' AS value FROM part WHERE p_size % 3 > 0 UNION ALL SELECT 'device_name_equals', 'd' || (p_partkey % 7) FROM part WHERE p_size % 3 > 0
UNION ALL SELECT 'device_name_equals', 'n' || (p_partkey % 50) FROM part WHERE p_size % 3 > 0 UNION ALL SELECT 'device_name_equals', 'after' || (p_partkey % 7) FROM part UNION ALL SELECT 'private_mmio_layouts', unnest(['r' || (p_partkey % 7), 's' || (p_partkey % 50), 't']) FROM part WHERE p_size % 3 > 0)
UNION SELECT 'device_name_equals', 'quoted' FROM part WHERE p_size % 3 = 0""")
def specialization_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file begins within a string of several lines, so that all of it up to the next mark is none."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    text = lambda t: F.concat(*[F.lit(p) if k % 2 == 0 else (F.col("p_partkey") % (50 if p == "0" else 7)).cast("string") for k, p in enumerate(_split(t))])
    lines = part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.array(F.lit("'''"), *map(text, _PROGRAM))).otherwise(F.array(*map(text, _PROGRAM))).alias("l"))
    return K.specialization_inventory(lines.select("p_partkey", F.posexplode("l").alias("line", "text")), "p_partkey")


def _split(template: str) -> list[str]:
    """A template's texts and, between them, the numbers in braces."""
    import re

    return [x.replace("{{", "{").replace("}}", "}") for x in re.split(r"(?<!\{)\{(\d)\}(?!\})", template)]


@query("""SELECT DISTINCT doc_id, name AS identifier, CAST(1 + length(left(text, p - 1)) - length(replace(left(text, p - 1), chr(10), '')) AS INT) AS line
FROM (SELECT doc_id, text, name, CAST(instr(' ' || regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g') || ' ', ' ' || name || ' ') AS INT) AS p FROM documents, (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part WHERE p_partkey < 40 UNION SELECT unnest(['license', 'token', 'the', 'und'])) WHERE regexp_full_match(name, '[a-z0-9]+')) WHERE p > 0""")
def identifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").where("p_partkey < 40").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("identifier")).where("identifier RLIKE '^[a-z0-9]+$'")
    names = names.unionByName(spark.createDataFrame([("license",), ("token",), ("the",), ("und",)], "identifier string")).distinct()
    return P.identifier_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), names, "doc_id")
