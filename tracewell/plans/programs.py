"""Program queries: build files, loop proofs, clock registers, runs of op trees, streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import rules as C
from tracewell.functions.batches import spread
from tracewell.operators import interpreter as I
from tracewell.operators import oracles as O
from tracewell.plans.traces import read
from tracewell.session import staged
from tracewell.sources import builds as B
from tracewell.sources import listings as K
from tracewell.sources import logs as L
from tracewell.streaming import windows as W

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


@query("""SELECT p_partkey, 'REG_' || p_partkey AS name, CAST(CASE p_size % 4 WHEN 0 THEN p_partkey * 4 WHEN 1 THEN CAST(1 AS BIGINT) << (p_size % 32) WHEN 2 THEN (p_partkey + 3) | 256 END AS BIGINT) AS value
 FROM part WHERE p_size % 4 <> 3 UNION ALL SELECT p_partkey, 'FIELD', NULL FROM part WHERE p_size % 4 = 3""")
def macro_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """CASE p_size % 4 WHEN 0 THEN concat('#define REG_', p_partkey, ' 0x', hex(p_partkey * 4), 'UL /* offset */') WHEN 1 THEN concat('# define REG_', p_partkey, ' BIT(', p_size % 32, ')')
      WHEN 2 THEN concat('#define REG_', p_partkey, ' ((', p_partkey, ' + 3) | 0x100)') ELSE '#define FIELD(x, y) ((x) << (y))' END"""
    files = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("// head\n"), F.expr(body), F.lit("\n#define NAME other_name\n")).alias("text"))
    return B.defines(L.lines(files, "p_partkey"), "p_partkey").select("p_partkey", "name", "value")


@query("""SELECT s_suppkey, '-x c -I/k/include/a' || CASE WHEN s_suppkey % 2 = 0 THEN ' -include /k/conf.h' ELSE '' END || ' -DKEY=' || s_suppkey || ' -nostdinc -I /k/drivers/d' || (s_nationkey) AS flags FROM supplier""")
def compile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    tokens = F.split(F.concat(F.lit("gcc -O2 -Iinclude/./b/../a"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(" -include conf.h")).otherwise(F.lit("")), F.lit(" -Wall -DKEY="), F.col("s_suppkey"), F.lit(" -nostdinc -c -o x.o x.c -I")), " ")
    flags = B.parser_flags(tokens, F.lit("/k"), F.concat(F.lit("/k/drivers/d"), F.col("s_nationkey"), F.lit("/x.c")))
    return s.select("s_suppkey", F.array_join(flags, " ").alias("flags"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) * 8 AS b, CASE WHEN l_linestatus = 'F' THEN 1 ELSE l_linenumber END AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e FROM lineitem),
c AS (SELECT *, CASE WHEN b - a + e <= 0 THEN 0 ELSE (b - a + e + s - 1) // s END AS n FROM l)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN n <= 256 THEN n END AS BIGINT) AS turns FROM c""")
def loop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    init = F.concat(F.lit("int i = "), F.col("l_linenumber"))
    guard = F.concat(F.lit("i "), F.when(F.col("l_returnflag") == "R", "<= ").otherwise("< "), F.col("l_quantity").cast("bigint") * 8)
    step = F.when(F.col("l_linestatus") == "F", F.lit("i++")).otherwise(F.concat(F.lit("i += "), F.col("l_linenumber")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.loop_bound(init, guard, step)["count"].alias("turns"))


_VCO = C.VCO_MIN


@query(f"""WITH c AS (SELECT o_orderkey, o_custkey % 8 + 1 AS mode, CAST((o_orderkey * 2654435761) % 4294967296 AS BIGINT) AS reg, 34000000 + o_custkey * 1009 AS a, CAST(480000000 AS BIGINT) AS b FROM orders),
p AS (SELECT *, least(greatest(a, {_VCO // 64}), {_VCO}) AS r FROM c),
q AS (SELECT *, CAST(1 + len(list_filter([1, 2, 3, 4, 5, 6], lambda k: (r << k) < {_VCO})) AS BIGINT) AS dq FROM p),
d AS (SELECT *, ((r << dq) + b // 2) // b - 1 AS df, (reg & {C.DIVF}) >> 20 AS cf, (reg & {C.DIVQ}) >> 16 AS cq, b // a AS k FROM q)
SELECT o_orderkey, CAST(CASE WHEN mode = 7 AND k % 2 = 1 THEN -22 ELSE 0 END AS INT) AS status,
 CAST(CASE mode WHEN 1 THEN CASE WHEN reg & 2 <> 0 THEN a ELSE a * (cf + 1) // (1 << cq) END WHEN 2 THEN a // CASE WHEN reg & 1 <> 0 THEN 8 ELSE 4 END WHEN 3 THEN a // (((reg & 6) >> 1) + 2)
  WHEN 4 THEN a // (((reg & 31) + 1) * 2) WHEN 5 THEN b * (df + 1) // (1 << dq) WHEN 6 THEN b // ((k + 1) // 2 * 2) ELSE 0 END AS BIGINT) AS value,
 CAST(CASE WHEN mode = 7 AND k % 2 = 0 THEN k // 2 WHEN mode = 8 AND df <> cf THEN ((reg - (reg & {C.DIVF | C.DIVQ | 3})) | (df << 20) | (dq << 16) | 1) & 4294967295
  WHEN mode = 8 THEN (reg - (reg & {C.DIVQ})) | (dq << 16) ELSE reg END AS BIGINT) AS reg FROM d""")
def clock_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    got = C.clock(F.col("o_custkey") % 8 + 1, F.expr("(o_orderkey * 2654435761) % 4294967296"), F.lit(34_000_000) + F.col("o_custkey") * 1009, F.lit(480_000_000))
    return o.select("o_orderkey", got.alias("c")).select("o_orderkey", "c.status", "c.value", "c.reg")


def _op(kind: str, **body) -> dict:
    return {kind: body}


def _bin(op: str, left: dict, right: dict) -> dict:
    return {"BinOp": {"op": op, "left": left, "right": right}}


_KEY, _ONE = {"Var": "key"}, {"Const": 1}
#: The module that the run and listing queries use.
MODULE = [
    _op("Read", var="a", width="B2", addr={"Fixed": {"base": "", "offset": 16}}, intent="Status"),
    _op("Cond", guard=_bin("BitAnd", _KEY, _ONE), then_ops=[_op("Write", width="B2", addr={"Symbolic": {"device": "dev", "register": "CTRL"}}, value=_bin("Add", _KEY, {"Var": "a"}), intent="Config")],
        else_ops=[_op("ReadModifyWrite", width="B1", addr={"Fixed": {"base": "b", "offset": 17}}, transform=_bin("BitXor", {"Var": "__old"}, _KEY), intent="Config")]),
    _op("Loop", loop_kind="for", count={"Const": 3}, reliability="Exact", bounded=True, induction_var="i", start=1, stride=2, body=[_op("StateWrite", field="sum", width="B8", value=_bin("Add", {"Var": "sum"}, _bin("Mul", {"Var": "i"}, _KEY)))]),
    _op("Return", value={"Var": "sum"}),
]
#: Bytes 16 and 17 of the seeded memory, and both as a little-endian number.
_B16, _B17 = I.seeded(18)[16:18]
_WORD = _B16 + 256 * _B17


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.lit(json.dumps(MODULE)).alias("program"), F.create_map(F.lit("key"), "o_orderkey").alias("env"), F.create_map(F.lit("CTRL"), F.lit(32).cast("bigint")).alias("registers"))
    return I.interpreted(o, "program", "env", "registers").select("o_orderkey", "run.*")


@query(f"""SELECT o_orderkey, 'R16={_WORD} ' || CASE WHEN o_orderkey % 2 = 1 THEN 'W32=' || ((o_orderkey + {_WORD}) % 65536) ELSE 'R17={_B17} W17=' || xor({_B17}, o_orderkey % 256) END AS trace, 9 * o_orderkey AS result, CAST(NULL AS VARCHAR) AS error FROM orders""")
def interpreted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("trace", lambda t: F.concat(t["kind"], t["offset"], F.lit("="), t["value"])), " ")
    return _runs(spark, sf_dir).select("o_orderkey", text.alias("trace"), "result", "error")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 2 ELSE 3 END AS steps, CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END ELSE 1 END AS differing,
 CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 1 END ELSE 2 END AS first_difference, CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'value' END ELSE 'missing' END AS reason FROM orders""")
def trace_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs against themselves with the second value changed in every third order and third steps lost."""
    steps = staged(_runs(spark, sf_dir).select("o_orderkey", F.posexplode("trace").alias("step", "t")).select("o_orderkey", "step", "t.*"), "steps")
    wrong = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 2 == 1) & (F.col("step") == 1)
    other = steps.where("step < 2").withColumn("value", F.when(wrong, F.col("value") + 1).otherwise(F.col("value")))
    got = O.trace_diff(steps, other, ["o_orderkey"], "step", ["kind", "offset", "value"])
    return got.select("o_orderkey", F.col("steps").cast("int").alias("steps"), F.col("differing").cast("int").alias("differing"), "first_difference", "reason")


@query(f"""SELECT o_orderkey, 'driver d' || o_orderkey || ' v1 {{' || chr(10) || '  module m {{' || chr(10) || '    a := R(B2, 0x10) -- Status' || chr(10) || '    IF (key & 0x1) {{' || chr(10)
 || '      W(B2, dev.CTRL) = (key + a) -- Config' || chr(10) || '    }} ELSE {{' || chr(10) || '      RMW(B1, b[0x11]) = (__old ^ key) -- Config' || chr(10) || '    }}' || chr(10) || '    LOOP for 0x3 [Exact] {{' || chr(10)
 || '      STATE(sum) := (sum + (i * key))' || chr(10) || '    }}' || chr(10) || '    RETURN sum' || chr(10) || '  }}' || chr(10) || '}}' AS listing FROM orders""".replace("{{", "{").replace("}}", "}"))
def program_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"version": 1, "driver": "d'), F.col("o_orderkey"), F.lit('", "modules": ' + json.dumps([{"name": "m", "ops": MODULE}]) + "}"))
    return K.listings(read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))).select("o_orderkey", "listing")


@query("""SELECT c_custkey, c_custkey % 3 > 0 AS portable, CAST(CASE c_custkey % 3 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS leaves FROM customer""")
def portable_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("c_custkey") % 3 == 0, F.array(*map(F.lit, ("Read", "Loop", "Write")))).when(F.col("c_custkey") % 3 == 1, F.array(*map(F.lit, ("Read", "Cond", "Write")))).otherwise(F.array(F.lit("Seq"), F.lit("Read")))
    nodes = read(spark, sf_dir, "customer").select("c_custkey", F.explode(kinds).alias("kind"))
    return O.portable_modules(nodes, ["c_custkey"], F.col("kind").isin("Read", "Write"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'interrupt_mask' WHEN p_size % 3 = 1 THEN 'reset' END AS role, CASE WHEN p_size % 2 = 0 THEN 'gpio_controller' ELSE 'clock' END AS class FROM part""")
def name_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "GPIO_pll_").otherwise("hb_PLL_"), F.when(F.col("p_size") % 3 == 0, "Unmask_IRQ").when(F.col("p_size") % 3 == 1, "Reset_Init").otherwise("run"))
    return read(spark, sf_dir, "part").select("p_partkey", C.hinted(name, C.ROLE_HINTS).alias("role"), C.hinted(name, C.CLASS_HINTS).alias("class"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.windowed_counts(read(spark, sf_dir, "events").select("ts", "event_type"), "ts", ["event_type"])


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS segments, count(*) AS rows FROM events GROUP BY 1""")
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, drained; the last version of each user's counters."""
    table = read(spark, sf_dir, "events")
    events = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("marker", F.col("event_type") == "signup")
    out = W.drained(W.running_segments(events, "user_id", "event_id", "marker"), "segments", "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("segments", "rows"), "_batch").alias("s")).select("user_id", "s.segments", "s.rows")
