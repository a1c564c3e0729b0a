"""Contract tables of parsed programs, made from the driver's tables, in Spark and as SQL for the oracle.

Every column is plain arithmetic on keys, so both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.traces import read

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CALLS = (
    "readl", "writel", "ioread8", "iowrite16", "readq", "dwc2_readl", "dwc2_writel", "sdhci_readw", "sdhci_writeb", "gpio_generic_read_reg", "gpio_generic_write_reg",
    "virtio_cread_le", "virtio_cread_bytes", "virtio_cwrite_le", "virtqueue_get_buf", "virtqueue_kick", "virtqueue_add_outbuf", "regmap_read", "regmap_write",
    "regmap_update_bits", "regmap_bulk_read", "gpio_generic_chip_init", "kfree", "pr_info", "my_helper",
)
KINDS = ("Read", "Write", "ReadModifyWrite", "Delay", "StateRead", "StateWrite", "OutputWrite", "Return", "Cond", "Loop", "Seq")
LEVELS = ("Exact", "Conservative", "Unknown", "Unsupported")


def pick(values, index: str):
    """The element of a fixed list at an index given as a SQL expression, modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast(({index}) % {len(values)} AS int)") + 1)


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def sql_pick(values, index: str) -> str:
    return f"list_extract({sql_list(values)}, CAST(({index}) % {len(values)} AS INT) + 1)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: key, callee, args, assigned, type_size."""
    args = F.array(F.expr("concat('d', l_orderkey % 7)"), F.expr("concat('REG_', l_linenumber)"), F.expr("concat('v', l_suppkey % 9)"), F.lit("&*out"), F.lit("m"))
    return read(spark, sf_dir, "lineitem").select(
        *KEY, pick(CALLS, "l_partkey + l_linenumber").alias("callee"), F.slice(args, F.lit(1), F.expr("cast(l_suppkey % 6 AS int)")).alias("args"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'lhs' END").alias("assigned"), F.expr("cast(l_quantity % 10 AS int)").alias("type_size"),
    )


CALLS_SQL = f"""calls AS (SELECT {', '.join(KEY)}, {sql_pick(CALLS, 'l_partkey + l_linenumber')} AS callee,
 list_slice(['d' || (l_orderkey % 7), 'REG_' || l_linenumber, 'v' || (l_suppkey % 9), '&*out', 'm'], 1, CAST(l_suppkey % 6 AS INT)) AS args,
 CASE WHEN l_returnflag = 'R' THEN 'lhs' END AS assigned, CAST(l_quantity % 10 AS INT) AS type_size FROM lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of op trees: driver, module, kind, address, precision and proof columns."""
    return read(spark, sf_dir, "lineitem").select(
        *KEY, F.expr("concat('d', l_suppkey % 20)").alias("driver"), F.expr("concat('m', l_orderkey % 50)").alias("module"), pick(KINDS, "l_partkey").alias("kind"),
        pick(("symbolic", "fixed", "computed", None), "cast(l_quantity AS bigint)").alias("addr_kind"), F.expr("l_discount > 0.03").alias("lowerable"), F.expr("l_tax > 0.06").alias("value_top"),
        pick((*LEVELS, None), "l_orderkey + l_linenumber").alias("reliability"), F.expr("l_linestatus = 'F'").alias("bounded"), F.expr("l_partkey % 16").alias("offset"), F.expr("concat('r', l_partkey % 5)").alias("addr"),
    )


NODES_SQL = f"""nodes AS (SELECT {', '.join(KEY)}, 'd' || (l_suppkey % 20) AS driver, 'm' || (l_orderkey % 50) AS module, {sql_pick(KINDS, 'l_partkey')} AS kind,
 {sql_pick(('symbolic', 'fixed', 'computed', None), 'CAST(l_quantity AS BIGINT)')} AS addr_kind, l_discount > 0.03 AS lowerable, l_tax > 0.06 AS value_top,
 {sql_pick((*LEVELS, None), 'l_orderkey + l_linenumber')} AS reliability, l_linestatus = 'F' AS bounded, l_partkey % 16 AS "offset", 'r' || (l_partkey % 5) AS addr FROM lineitem)"""

#: Counters of one row a driver, as arithmetic on a key (k); the same text is valid in both engines.
COUNTERS = {
    "total_ops": "k % 7 + k % 3", "symbolic": "k % 4", "fixed": "k % 3", "computed": "CASE WHEN k % 5 = 0 THEN k % 3 ELSE 0 END", "unsafe_computed": "CASE WHEN k % 10 = 0 AND k % 3 > 0 THEN 1 ELSE 0 END",
    "unknown_value": "CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END", "clang_diag": "CASE WHEN k % 13 = 0 THEN k % 40 ELSE 0 END", "conservative_loop": "CASE WHEN k % 17 = 0 THEN 2 ELSE 0 END",
    "register_map": "k % 12", "resources": "k % 4", "resources_resolved": "CASE WHEN k % 4 > 1 THEN k % 4 - 1 ELSE k % 4 END", "state_fields": "k % 2", "spec_registers": "k % 6",
    "structs": "k % 3", "callbacks": "k % 2", "fact_resources": "k % 5", "error_paths": "k % 4", "helper_calls": "k % 7", "functions": "k % 6", "functions_with_role": "CASE WHEN k % 6 > 0 THEN k % 6 - k % 2 ELSE 0 END",
    "unaccounted": "CASE WHEN k % 19 = 0 THEN 3 ELSE 0 END", "ris_ops_without_evidence": "CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END", "filtered": "CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END", "unsupported": "CASE WHEN k % 14 = 0 THEN 1 ELSE 0 END",
    "path_unknown": "CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END", "path_infeasible": "CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END", "nonexclusive_switch_pairs": "CASE WHEN k % 26 = 0 THEN 4 ELSE 0 END",
    "unsupported_ops": "CASE WHEN k % 27 = 0 THEN 1 ELSE 0 END", "unsupported_control": "CASE WHEN k % 28 = 0 THEN 1 ELSE 0 END", "unmodeled_callbacks": "CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END", "unvalidated_callbacks": "CASE WHEN k % 9 = 0 THEN 7 ELSE 0 END",
    "units": "k % 3 + 1", "linked_units": "CASE WHEN k % 6 = 0 THEN 0 ELSE k % 3 + 1 END", "unresolved_calls": "CASE WHEN k % 33 = 0 THEN 1 ELSE 0 END", "op_ids": "k % 7", "distinct_op_ids": "CASE WHEN k % 21 = 0 THEN 0 ELSE k % 7 END",
}
FLAGS = {"has_facts": "k % 8 <> 0", "strict_complete": "k % 19 <> 0 AND k % 23 <> 0 AND k % 29 <> 0 AND k % 14 <> 0", "path_complete": "k % 15 <> 0", "subsystem_access": "k % 24 = 0", "alias_complete": "k % 5 <> 1", "control_complete": "k % 28 <> 0", "cfg_complete": "k % 34 <> 0"}


def driver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counters, flags and name lists a driver."""
    k = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    names = lambda when: F.expr(f"CASE WHEN {when} THEN array(concat('f', k), 'g') ELSE cast(array() AS array<string>) END")
    return k.select(F.col("k").alias("driver"), *[F.expr(x).cast("bigint").alias(n) for n, x in COUNTERS.items()], *[F.expr(x).alias(n) for n, x in FLAGS.items()], names("k % 16 = 0").alias("unroled"), names("k % 18 = 0").alias("unbound"), F.expr("CASE WHEN k % 12 > 0 THEN concat('h', k) END").alias("bitcode_sha256"))


ROWS_SQL = f"""rows_ AS (SELECT p_partkey AS k, p_partkey AS driver, {', '.join(f'CAST({x} AS BIGINT) AS {n}' for n, x in ((n, x.replace('k ', 'p_partkey ')) for n, x in COUNTERS.items()))},
 {', '.join(f"({x.replace('k ', 'p_partkey ')}) AS {n}" for n, x in FLAGS.items())}, CASE WHEN p_partkey % 16 = 0 THEN 'f' || p_partkey || ', g' END AS unroled, CASE WHEN p_partkey % 18 = 0 THEN 'f' || p_partkey || ', g' END AS unbound,
 CASE WHEN p_partkey % 12 > 0 THEN 'h' || p_partkey END AS bitcode_sha256 FROM part)"""
