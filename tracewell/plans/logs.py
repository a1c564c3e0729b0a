"""Log and variant queries: text logs made of events, op trees made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import variants as V
from tracewell.plans.traces import read
from tracewell.sources import logs as L

_LINE = """CASE event_type WHEN 'signup' THEN concat('t [rhfn] fn_', CAST({user} % 5 AS STRING), '()') WHEN 'view' THEN concat('[rh] R 0x', hex({event} % 4096))
  WHEN 'click' THEN concat('[rh]  W 0x', hex({event} % 4096), ' x') ELSE concat('other ', event_type) END"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.expr(_LINE.format(user="user_id", event="event_id")).alias("text"))
    return L.trace_events(ev, "user_id", "at")


def trace_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", F.col("at.event_id").alias("event_id"), F.col("seg_id").cast("long").alias("seg_id"), "fn", "kind", "offset")


def branch_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: a read, a condition with a write in one branch, and a read-modify-write."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    branch = F.when(F.col("o_orderstatus") == "F", "then").otherwise("else")

    def node(i: int, parent: int | None, branch, kind: str, offset) -> F.Column:
        return F.struct(
            F.lit(i).alias("node_id"), F.lit(parent).cast("int").alias("parent_id"), F.lit(0 if parent is None else 1).alias("depth"), branch.alias("branch"),
            F.lit(i).alias("ord"), F.lit(kind).alias("kind"), offset.cast("bigint").alias("offset"),
        )

    body = F.lit("body")
    nodes = o.select("o_orderkey", F.inline(F.array(
        node(0, None, body, "Read", F.col("o_custkey") % 16), node(1, None, body, "Cond", F.lit(None)),
        node(2, 1, branch, "Write", F.col("o_orderkey") % 16), node(3, None, body, "ReadModifyWrite", F.lit(4)),
    )))
    shown = F.transform("variants", lambda v: F.array_join(F.transform(v, lambda a: F.concat(a["kind"], a["offset"].cast("string"))), " "))
    return V.branch_variants(nodes, ["o_orderkey"]).select("o_orderkey", F.array_join(shown, ";").alias("variants"), "traceable")


def trace_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: whether calls of fn_x in the user's log read 1, or write 2 and read 3."""
    ev = _events(spark, sf_dir).withColumnRenamed("at", "line_no").withColumn("offset", F.col("offset") % 8)
    fn = F.concat(F.lit("fn_"), (F.col("user_id") % 5).cast("string"))
    calls = read(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.lit(1).alias("call_no"), F.lit("m").alias("formal"), fn.alias("runtime"))
    want = spark.range(1).select(F.lit("m").alias("module"), F.expr(f"CAST(array(array(named_struct('kind', 'R', 'offset', 1L)), array(named_struct('kind', 'W', 'offset', 2L), named_struct('kind', 'R', 'offset', 3L))) AS {V.VARIANTS})").alias("variants"), F.lit(True).alias("traceable"))
    got = V.verdicts(V.match_calls(ev, calls, want, "user_id"), want, ev, "user_id")
    return got.select("user_id", "verdict", *[F.col(c).cast("long").alias(c) for c in ("calls", "passed", "ops", "ops_matched", "registers", "registers_matched")])


_SEG = """SELECT user_id, ts, event_id, event_type, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_id
  FROM events WHERE event_type IN ('signup', 'view', 'click')"""

QUERIES = {"trace_log_scan": trace_log_scan, "branch_variants": branch_variants, "trace_verdicts": trace_verdicts}
ORACLE_SQL = {
    "trace_log_scan": f"""SELECT user_id, event_id, seg_id, CASE WHEN event_type = 'signup' THEN 'fn_' || (user_id % 5) END AS fn,
 CASE event_type WHEN 'view' THEN 'R' WHEN 'click' THEN 'W' END AS kind, CASE WHEN event_type <> 'signup' THEN CAST(event_id % 4096 AS BIGINT) END AS offset FROM ({_SEG})""",
    "branch_variants": """WITH p AS (SELECT o_orderkey, 'R' || (o_custkey % 16) || ' W' || (o_orderkey % 16) || ' R4 W4' AS long, 'R' || (o_custkey % 16) || ' R4 W4' AS short, coalesce(o_orderstatus = 'F', false) AS f FROM orders)
SELECT o_orderkey, CASE WHEN f THEN long || ';' || short ELSE short || ';' || long END AS variants, true AS traceable FROM p""",
    "trace_verdicts": f"""WITH s AS ({_SEG}), first AS (SELECT user_id, min(seg_id) AS seg_id FROM s WHERE seg_id > 0 GROUP BY 1),
a AS (SELECT user_id, list(CASE WHEN event_type = 'view' THEN 'R' ELSE 'W' END || (event_id % 4096 % 8) ORDER BY ts, event_id) FILTER (event_type <> 'signup') AS got FROM s JOIN first USING (user_id, seg_id) GROUP BY 1),
m AS (SELECT u.user_id, f.seg_id, coalesce(list_contains(got, 'R1'), false) AS one, coalesce(list_position(got, 'W2'), 0) AS w,
  coalesce(list_position(got, 'W2') > 0 AND list_contains(got[list_position(got, 'W2') + 1 :], 'R3'), false) AS two
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN first f USING (user_id) LEFT JOIN a USING (user_id)),
r AS (SELECT *, CASE WHEN seg_id IS NULL THEN 1 WHEN two OR (w > 0 AND NOT one) THEN 2 ELSE 1 END AS n, CASE WHEN two THEN 2 WHEN one OR w > 0 THEN 1 ELSE 0 END AS k FROM m)
SELECT user_id, CASE WHEN seg_id IS NULL THEN 'no segments' WHEN n = k THEN 'ok' ELSE 'missing' END AS verdict, CAST(1 AS BIGINT) AS calls, CAST(CASE WHEN n = k THEN 1 ELSE 0 END AS BIGINT) AS passed,
 CAST(n AS BIGINT) AS ops, CAST(k AS BIGINT) AS ops_matched, CAST(n AS BIGINT) AS registers, CAST(CASE WHEN n = k THEN n ELSE 0 END AS BIGINT) AS registers_matched FROM r""",
}
