"""Fact queries: accounting, rules, roll-ups, diffs, sampling, graphs and expressions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import expressions as E
from tracewell.operators import graphs as G
from tracewell.operators import relational as R
from tracewell.operators import traces as T
from tracewell.plans.traces import _MATCH, _matched, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register the decorated function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- traces


@query(f"""WITH {_MATCH} SELECT user_id, count(*) AS calls, count(*) FILTER (matched = 3) AS complete_calls, CAST(sum(matched) AS BIGINT) AS matched_items,
  CAST(count(*) * 3 AS BIGINT) AS expected_items, count(DISTINCT CASE WHEN matched = 3 THEN n END) AS credited FROM m GROUP BY 1""")
def trace_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir).withColumn("n", F.size("items"))
    return T.coverage(m, "matched", F.lit(3), "n", ["user_id"])


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS names FROM events GROUP BY 1),
a AS (SELECT user_id, names, list_position(names, 'view') AS p1 FROM e),
b AS (SELECT *, CASE WHEN p1 > 0 THEN p1 + list_position(names[p1 + 1 :], 'purchase') END AS p2, CASE WHEN p1 > 0 THEN list_position(names[p1 + 1 :], 'purchase') END AS q2 FROM a),
c AS (SELECT *, CASE WHEN q2 > 0 THEN p2 + list_position(names[p2 + 1 :], 'view') END AS p3, CASE WHEN q2 > 0 THEN list_position(names[p2 + 1 :], 'view') END AS q3 FROM b)
SELECT user_id, CAST(CASE WHEN p1 > 0 THEN p1 END AS INT) AS c1, CAST(CASE WHEN q2 > 0 THEN p2 END AS INT) AS c2, CAST(CASE WHEN q3 > 0 THEN p3 END AS INT) AS c3 FROM c""")
def call_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = T.ordered_items(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "names")
    got = per.select("user_id", T.align_calls(F.array(F.lit("view"), F.lit("purchase"), F.lit("view")), F.col("names")).alias("a"))
    return got.select("user_id", *[F.get("a", i).alias(f"c{i + 1}") for i in range(3)])


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY (l_linestatus = 'F') DESC, l_quantity DESC, l_discount, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_linenumber", (F.col("l_linestatus") == "F").alias("ok"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("v"))
    return T.best_variant(df, ["l_orderkey"], "ok", "l_quantity", "l_discount", "v").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY 1, 2""")
def frame_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = T.islands(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return df.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events""")
def last_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = T.last_value_before(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id")), "last_view")
    return df.select("event_id", "last_view")


@query("""WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN CAST(floor(value / 10) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
SELECT event_id, user_id FROM e WHERE event_type = 'purchase' AND b = CAST(floor(value / 10) AS BIGINT)""")
def rmw_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.floor(F.col("value") / 10)
    df = T.last_value_before(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", bucket), "b")
    return df.where((F.col("event_type") == "purchase") & (F.col("b") == bucket)).select("event_id", "user_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS op_no FROM lineitem""")
def op_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = T.numbered(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("op_no").cast("long").alias("op_no"))


# ---------------------------------------------------------------- accounting and joins


def _accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.when(F.col("o_orderstatus") == "P", "filtered").otherwise("pending").alias("initial"))
    ops = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("site"), "l_linenumber")
    return R.access_accounting(sites, ops, "site", "l_linenumber", "initial")


_ACC = """s AS (SELECT o_orderkey AS site, CASE WHEN o_orderstatus = 'P' THEN 'filtered' ELSE 'pending' END AS initial FROM orders),
o AS (SELECT l_orderkey AS site, count(*) AS n_ops FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
a AS (SELECT s.site, coalesce(n_ops, 0) AS n_ops, CASE WHEN n_ops > 0 THEN 'emitted' WHEN initial = 'filtered' THEN 'filtered' ELSE 'unaccounted' END AS status FROM s LEFT JOIN o USING (site))"""


@query(f"WITH {_ACC} SELECT site, status, n_ops FROM a")
def access_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounted(spark, sf_dir).select("site", "status", "n_ops")


@query(f"""WITH {_ACC} SELECT count(*) AS source_accesses, count(*) FILTER (status = 'emitted') AS emitted, count(*) FILTER (status = 'filtered') AS filtered, CAST(0 AS BIGINT) AS unsupported,
 count(*) FILTER (status = 'unaccounted') AS unaccounted, count(*) FILTER (status = 'unaccounted') = 0 AS complete, count(*) FILTER (status <> 'emitted') = 0 AS strict_complete FROM a""")
def accounting_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.accounting_totals(_accounted(spark, sf_dir), F.lit(0))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def evidence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return read(spark, sf_dir, "lineitem").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1)
SELECT max(n) AS max_fanout, CAST(sum(n) AS BIGINT) AS ops, count(*) AS sites, CAST(sum(n - d) AS BIGINT) AS duplicates FROM c""")
def site_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("d"))
    return c.agg(F.max("n").alias("max_fanout"), F.sum("n").alias("ops"), F.count(F.lit(1)).alias("sites"), F.sum(F.col("n") - F.col("d")).alias("duplicates"))


@query("SELECT p_brand AS name, arg_min(p_size, p_partkey) AS width, count(DISTINCT p_size) AS n_values, count(DISTINCT p_size) > 1 AS conflict FROM part GROUP BY 1")
def register_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_wins(read(spark, sf_dir, "part"), "p_brand", "p_size", ["p_partkey"]).select(F.col("p_brand").alias("name"), F.col("value").alias("width"), "n_values", "conflict")


@query("SELECT p_name, arg_min(p_retailprice, p_partkey) AS value, count(DISTINCT p_retailprice) AS n_values, count(DISTINCT p_retailprice) > 1 AS conflict FROM part GROUP BY 1")
def macro_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_wins(read(spark, sf_dir, "part"), "p_name", "p_retailprice", ["p_partkey"])


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def unique_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_candidate(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("""SELECT c_nationkey, c_custkey, alternates FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING'), c_mktsegment, c_custkey) AS n,
 count(*) OVER (PARTITION BY c_nationkey) - 1 AS alternates FROM customer) WHERE n = 1""")
def callback_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.primary_and_alternates(read(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment"), F.col("c_custkey")])
    return df.select("c_nationkey", "c_custkey", "alternates")


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)) <> (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))""")
def xor_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("x"))
    b = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("y"))
    pairs = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.join(a, "l_partkey", "left").join(b, "l_suppkey", "left").where(F.col("x").isNotNull() != F.col("y").isNotNull()).select("l_partkey", "l_suppkey")


@query("""SELECT a.n_regionkey AS region, a.n_nationkey AS a, b.n_nationkey AS b, a.n_name <> b.n_name AS exclusive FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def pair_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("a"), F.col("n_name").alias("an")), n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("b"), F.col("n_name").alias("bn"))
    return a.join(b, "region").where("a < b").select("region", "a", "b", (F.col("an") != F.col("bn")).alias("exclusive"))


@query("""SELECT e.event_id, s.event_id AS guard_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.event_type = 'signup'
 AND epoch(s.ts)::BIGINT <= epoch(e.ts)::BIGINT AND epoch(e.ts)::BIGINT < epoch(s.ts)::BIGINT + 86400""")
def interval_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole seconds as the SQL's cast gives them: the nearest one, of two the even one
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds.alias("at"))
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("guard_id"), "user_id", F.col("at").alias("after"), (F.col("at") + 86400).alias("before"))
    return R.interval_containment(e, "at", s, "after", "before", ["user_id"], 86400).select("event_id", "guard_id")


@query("""WITH f AS (SELECT o_custkey AS k, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
p AS (SELECT o_custkey AS k, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT k, CASE WHEN f.n IS NULL THEN 'added' WHEN p.n IS NULL THEN 'removed' WHEN f.n = p.n AND f.t = p.t THEN 'same' ELSE 'changed' END AS side,
 CASE WHEN f.n IS NOT NULL AND p.n IS NOT NULL THEN concat_ws(',', CASE WHEN f.n <> p.n THEN 'n' END, CASE WHEN f.t <> p.t THEN 't' END) END AS changed FROM f FULL JOIN p USING (k)""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice")).cast("bigint").alias("t"))
    return R.report_diff(side("F"), side("P"), "k", ["n", "t"]).withColumn("changed", F.array_join("changed", ","))


@query("""SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier) UNION ALL (SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer))""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, s = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select("o_custkey"), read(spark, sf_dir, "supplier").select("s_suppkey")
    parts = {"intersect": c.intersect(o), "except": c.subtract(o), "union": c.union(s).distinct(), "symmetric": c.subtract(s).union(s.subtract(c))}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


# ---------------------------------------------------------------- rules, metrics, scores

_INTENT = [("Reset", "(?i)cornflower|red"), ("Enable", "(?i)blue|green"), ("Config", "(?i)^s|steel")]


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)cornflower|red') THEN 'Reset' WHEN regexp_matches(p_name, '(?i)blue|green') THEN 'Enable' WHEN regexp_matches(p_name, '(?i)^s|steel') THEN 'Config' ELSE 'Status' END AS intent FROM part""")
def intent_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", R.ordered_rules(F.col("p_name"), _INTENT, "Status").alias("intent"))


@query("""SELECT c_custkey, CASE WHEN r_name IN ('ASIA', 'EUROPE') AND c_mktsegment LIKE '%BUILD%' THEN 'probe' WHEN c_mktsegment LIKE '%AUTO%' THEN 'remove' ELSE lower(r_name) END AS role
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    role = F.when(F.col("r_name").isin("ASIA", "EUROPE") & F.col("c_mktsegment").contains("BUILD"), "probe").when(F.col("c_mktsegment").contains("AUTO"), "remove").otherwise(F.lower("r_name"))
    return df.select("c_custkey", role.alias("role"))


_BLOCK = [("contact", "@[A-Za-z0-9-]+\\.[A-Za-z]"), ("license", "License"), ("table", "\\|"), ("shout", "!!")]


@query(r"""WITH c AS (SELECT source, CASE WHEN regexp_matches(text, '@[A-Za-z0-9-]+\.[A-Za-z]') THEN 'contact' WHEN regexp_matches(text, 'License') THEN 'license' WHEN regexp_matches(text, '\|') THEN 'table' WHEN regexp_matches(text, '!!') THEN 'shout' ELSE 'unclassified' END AS category FROM documents),
n AS (SELECT category, count(DISTINCT source) AS n_entities FROM c GROUP BY 1)
SELECT category, n_entities, category = (SELECT category FROM n WHERE n_entities >= 3 AND category <> 'unclassified' ORDER BY n_entities DESC, category LIMIT 1) AS chosen FROM n""")
def blocker_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("source", R.ordered_rules(F.col("text"), _BLOCK, "unclassified").alias("category"))
    return R.cluster(df, "source", "category", 3, ["unclassified"])


@query("""WITH m AS (SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN l_tax <= 0.04 THEN 1 ELSE 0 END) AS t, sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(round(1000 * (0.5 * d / n + 0.3 * t / n + 0.2 * q / n)) AS BIGINT) AS score_milli, d * 2 > n AS gate_discount, t * 2 > n AS gate_tax,
 concat_ws(',', CASE WHEN NOT d * 2 > n THEN 'discount' END, CASE WHEN NOT t * 2 > n THEN 'tax' END) AS blockers FROM m""")
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("d"), F.count_if(F.col("l_tax") <= 0.04).alias("t"), F.count_if(F.col("l_quantity") >= 25).alias("q"))
    score = R.weighted_score([(F.col("d") / F.col("n"), 0.5), (F.col("t") / F.col("n"), 0.3), (F.col("q") / F.col("n"), 0.2)])
    gates = [("discount", F.col("d") * 2 > F.col("n")), ("tax", F.col("t") * 2 > F.col("n"))]
    return m.select("l_returnflag", F.round(score * 1000).cast("bigint").alias("score_milli"), *[g.alias(f"gate_{n}") for n, g in gates], F.array_join(R.blockers(gates), ",").alias("blockers"))


@query("SELECT o_orderpriority, bool_and(o_totalprice > 0) AS positive, bool_and(o_orderstatus <> 'P') AS closed, bool_and(o_totalprice > 0 AND o_orderstatus <> 'P') AS ready FROM orders GROUP BY 1")
def gate_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_totalprice") > 0, F.col("o_orderstatus") != "P"
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.bool_and(a).alias("positive"), F.bool_and(b).alias("closed"), F.bool_and(a & b).alias("ready"))


@query("""SELECT coalesce(l_returnflag, 'TOTAL') AS driver, coalesce(l_linestatus, 'TOTAL') AS module, count(*) AS ops, count(*) FILTER (l_quantity > 25) AS symbolic, count(DISTINCT l_suppkey) AS registers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("ops"), F.count_if(F.col("l_quantity") > 25).alias("symbolic"), F.count_distinct("l_suppkey").alias("registers"))
    return g.select(F.coalesce("l_returnflag", F.lit("TOTAL")).alias("driver"), F.coalesce("l_linestatus", F.lit("TOTAL")).alias("module"), "ops", "symbolic", "registers")


@query("""WITH m AS (SELECT p_brand, count(*) AS src, count(*) FILTER (p_size < 5) AS direct FROM part GROUP BY 1)
SELECT p_brand, CAST(CASE WHEN src = 0 THEN NULL ELSE floor(10000 * least(direct, src) / src) END AS BIGINT) AS coverage, CAST(CASE WHEN direct = 0 THEN NULL ELSE floor(10000 * src / direct) END AS BIGINT) AS amplification FROM m""")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("src"), F.count_if(F.col("p_size") < 5).alias("direct"))
    return m.select("p_brand", F.floor(F.try_divide(F.least("direct", "src") * 10000, "src")).alias("coverage"), F.floor(F.try_divide(F.col("src") * 10000, "direct")).alias("amplification"))


@query("""SELECT p_type, p_partkey, CAST(rank AS INT) AS rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY sha256('7:' || p_partkey)) AS rank FROM part WHERE p_size BETWEEN 5 AND 40) WHERE rank <= 5""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hash_sample(read(spark, sf_dir, "part").where("p_size BETWEEN 5 AND 40"), "p_type", "p_partkey", "7", 5).select("p_type", "p_partkey", "rank")


@query("""SELECT doc_id, ident FROM documents, (VALUES ('the'), ('der'), ('token'), ('idiot')) v(ident) WHERE regexp_matches(text, '(^|[^A-Za-z0-9])' || ident || '($|[^A-Za-z0-9])')""")
def identifier_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = [F.when(F.col("text").rlike(f"(?<![A-Za-z0-9]){i}(?![A-Za-z0-9])"), F.lit(i)) for i in ("the", "der", "token", "idiot")]
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("ident"))


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href="/[^"]*"')) AS INT) AS links FROM pages""")
def text_scan_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit('<a href="/[^"]*"')).alias("links"))


@query("""SELECT event_type, count(*) AS n, count(json_extract(props, '$')) AS parsed FROM events GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$")).alias("parsed"))


# ---------------------------------------------------------------- graphs

_HALVES = "SELECT DISTINCT p_partkey AS s, p_partkey // 2 AS d FROM part WHERE p_partkey > 0"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("s"), F.expr("p_partkey div 2").alias("d"))


_REACH = f"e AS ({_HALVES}), r AS (SELECT s AS root, d AS node, 1 AS depth FROM e UNION ALL SELECT root, e.d, depth + 1 FROM r JOIN e ON r.node = e.s WHERE depth < 3)"


@query(f"WITH RECURSIVE {_REACH} SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2")
def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(_halves(spark, sf_dir), "s", "d", 3)


@query(f"""WITH RECURSIVE {_REACH}, m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2)
SELECT depth, count(*) AS new_pairs, CAST(sum(count(*)) OVER (ORDER BY depth) AS BIGINT) AS total_pairs FROM m GROUP BY 1""")
def propagation_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.propagation(_halves(spark, sf_dir), "s", "d", 3)


_EDGES = "e AS (SELECT DISTINCT cohort, a, b FROM (SELECT user_id % 10 AS cohort, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ev = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("cohort"), F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    return ev.where("b IS NOT NULL").distinct()


@query(f"WITH {_EDGES} SELECT cohort, b, count(DISTINCT a) AS n_pred FROM e GROUP BY 1, 2 HAVING count(DISTINCT a) > 1")
def joins_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.join_blocks(_transitions(spark, sf_dir), ["cohort"], "a", "b")


def _dominator_sql(src: str, dst: str, entry: str) -> str:
    """d dominates n exactly if n is reached from the entry, but not without d."""
    return f"""WITH RECURSIVE {_EDGES}, g AS (SELECT DISTINCT cohort FROM e), n AS (SELECT cohort, a AS x FROM e UNION SELECT cohort, b FROM e UNION SELECT cohort, '{entry}' FROM g),
w AS (SELECT cohort, '' AS x FROM g UNION SELECT * FROM n), r AS (SELECT cohort, x AS d, '{entry}' AS node FROM w WHERE x <> '{entry}' UNION SELECT r.cohort, r.d, e.{dst} FROM r JOIN e ON r.cohort = e.cohort AND r.node = e.{src} AND e.{dst} <> r.d),
live AS (SELECT cohort, node FROM r WHERE d = ''), dom AS (SELECT l.cohort, l.node, m.node AS d FROM live l JOIN live m ON l.cohort = m.cohort LEFT JOIN r ON r.cohort = l.cohort AND r.d = m.node AND r.node = l.node WHERE r.node IS NULL),
s AS (SELECT cohort, node, count(*) AS size FROM dom GROUP BY 1, 2)
SELECT s.cohort, s.node, (SELECT arg_max(d, z.size) FROM dom JOIN s z ON z.cohort = dom.cohort AND z.node = dom.d WHERE dom.cohort = s.cohort AND dom.node = s.node AND dom.d <> s.node) AS idom, CAST(s.size AS INT) AS dom_size,
 EXISTS (SELECT 1 FROM e JOIN dom ON dom.cohort = e.cohort AND dom.node = e.{src} AND dom.d = s.node WHERE e.cohort = s.cohort AND e.{dst} = s.node) AS header FROM s"""


@query(_dominator_sql("a", "b", "signup"))
def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dominators(_transitions(spark, sf_dir).withColumn("entry", F.lit("signup")), "cohort", "a", "b", "entry").drop("place", "last")


_CHAIN = "e AS (SELECT DISTINCT user_id % 10 AS cohort, CAST(event_id % 40 AS VARCHAR) AS a, CAST((event_id % 40 * (3 + user_id % 10) + 1) % (30 + user_id % 10) AS VARCHAR) AS b FROM events WHERE event_id % 40 < 30)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_id % 40 < 30").selectExpr("user_id % 10 AS cohort", "cast(event_id % 40 AS string) AS a", "cast((event_id % 40 * (3 + user_id % 10) + 1) % (30 + user_id % 10) AS string) AS b")
    return e.distinct()


@query(_dominator_sql("a", "b", "0").replace(_EDGES, _CHAIN))
def chain_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dominators(_sparse(spark, sf_dir).withColumn("entry", F.lit("0")), "cohort", "a", "b", "entry").drop("place", "last")


@query(_dominator_sql("b", "a", "7").replace(_EDGES, _CHAIN))
def postdominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dominators(_sparse(spark, sf_dir).withColumn("exit", F.lit("7")), "cohort", "b", "a", "exit").drop("place", "last")


# ---------------------------------------------------------------- expressions


@query("SELECT l_orderkey, l_linenumber, (l_orderkey & 255) | (CAST(l_linenumber AS BIGINT) << 8) AS v, xor(l_orderkey, l_partkey) AS x FROM lineitem")
def expr_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = {"key": F.col("l_orderkey"), "line": F.col("l_linenumber"), "part": F.col("l_partkey")}
    made = {n: E.compiled(E.parse(t), env).alias(n) for n, t in {"v": "(key & 255) | (line << 8)", "x": "key ^ part"}.items()}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *made.values())


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey < o_custkey ELSE true END AS less FROM orders")
def u64_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", E.u64_less(F.col("o_orderkey"), b).alias("less"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_id * 1000000 WHEN event_type = 'error' THEN event_id * 1000 END AS ns FROM events")
def delay_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    callee = F.when(F.col("event_type") == "view", "mdelay").when(F.col("event_type") == "click", "ssleep").when(F.col("event_type") == "error", "udelay")
    return read(spark, sf_dir, "events").select("event_id", E.delay_ns(callee, F.col("event_id")).alias("ns"))


_PRINT = "sha256(string_agg(l_linenumber || '|' || l_partkey || '|' || {}, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey))"


def _prints(spark: SparkSession, sf_dir: str, supplier) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", supplier.alias("s"))
    return R.fingerprint(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey", "s"])


@query(f"SELECT l_orderkey, {_PRINT.format('l_suppkey')} AS fingerprint FROM lineitem GROUP BY 1")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir, F.col("l_suppkey"))


@query("SELECT l_orderkey, bool_or(l_linenumber = 1) AS caught FROM lineitem GROUP BY 1")
def mutation_caught(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _prints(spark, sf_dir, F.col("l_suppkey"))
    b = _prints(spark, sf_dir, F.when(F.col("l_linenumber") == 1, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))).withColumnRenamed("fingerprint", "other")
    return a.join(b, "l_orderkey").select("l_orderkey", (F.col("fingerprint") != F.col("other")).alias("caught"))


@query("""SELECT n_nationkey, CAST(((90 + 37 * n_nationkey) & 255) + 256 * ((90 + 37 * (n_nationkey + 1)) & 255) AS BIGINT) AS le2, CAST(256 * ((90 + 37 * n_nationkey) & 255) + ((90 + 37 * (n_nationkey + 1)) & 255) AS BIGINT) AS be2 FROM nation""")
def endian_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.seeded_memory()
    return read(spark, sf_dir, "nation").select("n_nationkey", E.read_bytes(m, F.col("n_nationkey"), 2).alias("le2"), E.read_bytes(m, F.col("n_nationkey"), 2, True).alias("be2"))


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n, CAST(coalesce(sum(c_custkey), 0) AS BIGINT) AS key_sum FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def spec_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("functions"))
    spec = read(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("functions", F.expr("cast(array() as array<struct<c_custkey:bigint,c_name:string>>)")).alias("functions"))
    return spec.select("n_nationkey", "n_name", F.size("functions").cast("long").alias("n"), F.aggregate("functions", F.lit(0).cast("bigint"), lambda a, x: a + x["c_custkey"]).alias("key_sum"))


@query("""SELECT s_suppkey, t.cb AS callback FROM supplier, (VALUES ('get', -1000000), ('set', 0), ('direction', 5000)) t(cb, least) WHERE s_acctbal > t.least""")
def summary_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cb = F.array(*[F.when(F.col("s_acctbal") > least, F.lit(n)) for n, least in (("get", -1000000), ("set", 0), ("direction", 5000))])
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.filter(cb, lambda x: x.isNotNull())).alias("callback"))
