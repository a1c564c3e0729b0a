"""Trace queries: segments of users' events, greedy matching, coverage, runs, last reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import traces as T

PATTERN = ["view", "click", "purchase"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return T.segments(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")


def _pattern():
    return F.array(*map(F.lit, PATTERN))


def trace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).groupBy("user_id", F.col("seg_id").cast("long").alias("seg_id")).agg(F.count(F.lit(1)).alias("n"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = T.ordered_items(_segmented(spark, sf_dir), ["user_id", "seg_id"], ["ts", "event_id"], "event_type")
    return T.subsequence_match(per, "items", _pattern())


def trace_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("user_id", F.col("seg_id").cast("long").alias("seg_id"), F.size("items").cast("long").alias("n"), F.col("matched").cast("long").alias("matched"))


def trace_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("user_id", F.col("seg_id").cast("long").alias("seg_id"), F.array_join("missing", ",").alias("missing"))


_SEG = """seg AS (SELECT user_id, ts, event_id, event_type, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_id FROM events)"""
_MATCH = f"""{_SEG}, per AS (SELECT user_id, seg_id, list(event_type ORDER BY ts, event_id) AS items FROM seg GROUP BY 1, 2),
m AS (SELECT user_id, seg_id, len(items) AS n,
  CAST(list_reduce(list_prepend(0, list_transform(items, lambda e: CASE e WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 99 END)),
       lambda acc, x: CASE WHEN x = acc + 1 THEN x ELSE acc END) AS BIGINT) AS matched FROM per)"""

QUERIES = {"trace_segments": trace_segments, "trace_subsequence": trace_subsequence, "trace_missing": trace_missing}
ORACLE_SQL = {
    "trace_segments": f"WITH {_SEG} SELECT user_id, seg_id, count(*) AS n FROM seg GROUP BY 1, 2",
    "trace_subsequence": f"WITH {_MATCH} SELECT user_id, seg_id, n, matched FROM m",
    "trace_missing": f"WITH {_MATCH} SELECT user_id, seg_id, CASE matched WHEN 0 THEN 'view,click,purchase' WHEN 1 THEN 'click,purchase' WHEN 2 THEN 'purchase' ELSE '' END AS missing FROM m",
}
