"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance 2 or less have a common point at distance 1 or
less from both. So every distinct fingerprint emits its ball of radius 1 (itself and
its 64 one-bit variants); fingerprints that emit the same variant are collisions.

A bucket needs no list of its members: a member is the variant with one bit flipped
(or none), so one 64-bit mask and one flag describe the whole bucket. The bucket is
therefore a plain ``bit_or`` aggregate of fixed size, whatever the data are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_arrow, staged, table

SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included.

    Words are runs of bytes that are neither space nor 0x09-0x0D, A-Z lower-cased.
    Fewer words than a shingle holds make one shingle; no words give 0.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        m = min(_BLOCK, n - start)
        h = np.fromiter((digest(g, SEED) for g in islice(grams, m)), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, run, "doc_id long, fp long")


def links(distinct: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links (a, b), a > b, between the distinct fingerprints in column ``fp``.

    Two fingerprints are connected through these links exactly if a chain of
    fingerprints at ``max_distance`` or less joins them. Members of one bucket are at
    distance 2 at most, so each is linked to the bucket's least member only; every
    link is verified, and links that several buckets give are merged.
    """
    if max_distance not in (0, 1, 2):
        raise ValueError("balls of radius 1 cover distances 0, 1 and 2")
    if max_distance == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    ball = (
        distinct.select("fp", F.explode(F.expr("sequence(0, 64)")).alias("bit"))
        .select(F.expr("CASE WHEN bit = 64 THEN fp ELSE fp ^ shiftleft(1L, bit) END").alias("variant"), F.col("bit").cast("byte").alias("bit"))
        # dealt out first: a map-side aggregate would find next to nothing to merge
        .repartition("variant")
    )
    buckets = (
        ball.groupBy("variant")
        .agg(F.expr("bit_or(CASE WHEN bit = 64 THEN 0L ELSE shiftleft(1L, bit) END)").alias("mask"), F.expr("max(bit = 64)").alias("own"))
        .where(F.expr("bit_count(mask) + int(own) > 1"))
    )
    members = buckets.select(
        "variant", "own",
        F.expr("concat(transform(filter(sequence(0, 63), i -> (mask & shiftleft(1L, i)) <> 0), i -> variant ^ shiftleft(1L, i)), CASE WHEN own THEN array(variant) ELSE array() END)").alias("fps"),
    )
    if max_distance == 1:
        members = members.where("own").select("fps", F.col("variant").alias("hub"))
    else:
        members = members.select("fps", F.array_min("fps").alias("hub"))
    return (
        members.select("hub", F.explode("fps").alias("fp"))
        .where(F.col("hub") != F.col("fp"))
        .where(F.expr(f"bit_count(hub ^ fp) <= {int(max_distance)}"))
        .select(F.greatest("hub", "fp").alias("a"), F.least("hub", "fp").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node reachable.

    Least labels move along links, then every label jumps to its own label, until
    nothing changes. Each round is staged in the shared folder. No step gathers a
    component: a node's links are bounded by its ball, and minima are pre-aggregated.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")), "links")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        told = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = label.join(told, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        new = staged(moved.join(up, "mid", "left").select("node", F.least("mid", "top").alias("root"), (F.col("old") != F.least("mid", "top")).alias("changed")), "labels")
        done = new.where("changed").limit(1).count() == 0
        label = new.select("node", "root")
        if done:
            return label


def near_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the least doc_id in the row's connected class. A null text counts
    as empty; texts without words have fingerprint 0 and are linked like any other. A
    row with a null doc_id gets its class's id (null if no row of the class has one).
    Repeated rows are all returned. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    fp = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(rooted.join(least, "root").select("fp", "component_id"), "classes")
    # A hot fingerprint is one row of ``of``; AQE splits its rows on the side of the documents.
    return fp.join(of, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
