"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import ship, shared_dir, staged

__all__ = ["held_out", "labelled_sample", "map_arrow", "shared_dir", "ship", "staged", "table", "text_or_empty"]

#: Upper-case ASCII letters and their lower-case forms, for ``translate``.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    """The text, with null read as the empty string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32(id as text) mod 5 is 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents for training, as (doc_id, text, label).

    Rows of the held-out fold, rows without a label and labels other than 0 and 1 are
    left out first. The sample is by hash of doc_id, so it is the same in every run.
    Several labels of one document count as their maximum; of several rows with one
    doc_id the least text by its hash is taken, before anything is shuffled. The bound
    makes broadcasting the chosen ids and collecting what is learned from them safe.
    """
    chosen = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("d")).select("doc_id", "d.text", "d.label")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package's code on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
