"""Centroid clustering by sort-means, in exact integer arithmetic.

For each centroid the others are sorted by their distance from it. A vector starts at
the centroid to which it belonged before and looks at the others in that order; by the
triangle inequality one that is more than twice as far from the old centroid as the
vector is cannot be nearer to the vector, nor can any after it. At exactly twice the
distance there can be a tie, so the search goes on. Distances are squared, so twice is
four times.

A batch of vectors takes the search together: all that belong to one centroid look at
the same next centroid, and those that have stopped drop out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_arrow, staged, table

#: Components beyond this cannot be squared and summed in 64 bits.
_LIMIT = 1 << 27
_VECTOR = "vec_id long, v binary, cluster int, distance long"


def packed(x: np.ndarray) -> pa.Array:
    """Vectors of integers as bytes that sort as the vectors do."""
    return pa.array([r.tobytes() for r in (x + (1 << 31)).astype(">u4")], pa.binary())


def unpacked(v: pa.Array) -> np.ndarray:
    """The vectors of integers, one a row."""
    return np.frombuffer(b"".join(v.to_pylist()), ">u4").reshape(len(v), -1).astype(np.int64) - (1 << 31)


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector's nearest centroid, the lesser number of equal ones; and how many distances were computed.

    ``before`` is the centroid at which each vector's search starts. Any gives the same
    result; the nearest one stops soonest.
    """
    cluster, distance, computed = before.copy(), np.zeros(len(x), np.int64), 0
    for p in np.unique(before):
        own = np.flatnonzero(before == p)
        between = ((centroids - centroids[p]) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(centroids)), between))
        from_old = ((x[own] - centroids[p]) ** 2).sum(axis=1)
        best, at = from_old.copy(), np.full(len(own), p, before.dtype)
        computed += len(own)
        # sorted by reach, so those that go on are always the first ones
        by_reach = np.argsort(-from_old, kind="stable")
        reach = -4 * from_old[by_reach]
        for c in order:
            if c == p:
                continue
            rows = by_reach[: np.searchsorted(reach, -between[c], "right")]
            if not len(rows):
                break
            d = ((x[own[rows]] - centroids[c]) ** 2).sum(axis=1)
            computed += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], c
        cluster[own], distance[own] = at, best
    return cluster, distance, computed


def integer_vectors(vectors: DataFrame, components: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v, cluster, distance): vectors of finite components, as the 64-bit integers floor(scale * x), cluster 0.

    Vectors that are null, of another length, or with a component that is null, NaN or
    infinite are left out. Every row stays a row, repeated or null ids included. A
    component whose integer passes 27 bits raises, as distances would pass 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components) * scale)
            if len(x) and np.abs(x).max() > _LIMIT:
                raise OverflowError(f"a component is beyond {_LIMIT} / {scale}")
            zero = np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), packed(x.astype(np.int64)), pa.array(zero.astype(np.int32)), pa.array(zero)], ["vec_id", "v", "cluster", "distance"])

    x = F.col("embedding").cast("array<double>")
    finite = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == components).where("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    return map_arrow(finite, run, _VECTOR)


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``seed:vec_id``, in that order; fewer if there are no more.

    Of equal ids the lesser vector comes first; rows without an id come last.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return unpacked(pa.array([r["v"] for r in rows], pa.binary())) if rows else np.empty((0, 0), np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors with their nearest centroid and the squared distance to it, searched from the one they have."""
    told = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column(1))
            cluster, distance, _ = nearest(x, told.value, b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return map_arrow(vectors, run, _VECTOR)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the components' means of each cluster; a cluster without vectors keeps its centroid.

    Tasks send one sum a cluster and batch, so a cluster of any size is a few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column(0))
            of = b.column(1).to_numpy()
            some = np.unique(of)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([(of == c).sum() for c in some], pa.int64()), pa.array([x[of == c].sum(axis=0) for c in some], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    sums = map_arrow(vectors.select("v", "cluster"), run, "cluster int, n long, sums array<long>")
    means = sums.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in means.collect():  # clusters times components
        out[r["cluster"], r["at"]] = r["s"] // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, components: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every kept vector, and the final centroids.

    Each round assigns all vectors and then moves the centroids; at the end the vectors
    are assigned once more. A round's table is deleted when the next one is written. No
    kept vectors give no rows and no centroids.
    """
    at = staged(integer_vectors(vectors, components, scale), "vectors")
    centroids = first_centroids(at, k, seed)
    if not len(centroids):
        return at, centroids
    for _ in range(rounds):
        new = staged(assigned(at, centroids), "assigned")
        centroids = moved(new, centroids)
        at = new
    return staged(assigned(at, centroids), "clusters"), centroids


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    inertias = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))]) if len(centroids) else F.lit(None).cast("array<long>")
    hashes = F.array(*map(F.lit, digests)) if digests else F.lit(None).cast("array<string>")
    at = F.col("cluster") + 1
    return rows.select("vec_id", "cluster", "distance", F.element_at(inertias, at).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(hashes, at).alias("centroid_sha256"))


QUERIES = {"op12_clusters": op12_clusters}


def _round(n: int) -> str:
    """SQL of one round: c{n}, the centroids after it, from those before."""
    return f"""a{n} AS (
  SELECT v, i, arg_min(c, {{'d': list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j]))), 'c': c}}) AS c FROM kept, c{n - 1} GROUP BY v, i
), m{n} AS (
  SELECT c, j, count(*) AS n, sum(x) AS s FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{n}) GROUP BY c, j
), c{n} AS (
  SELECT c, coalesce(any_value(f.w), any_value(o.w)) AS w
  FROM c{n - 1} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS w FROM m{n} GROUP BY c) f USING (c) GROUP BY c
)"""


ORACLE_SQL = {
    "op12_clusters": f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c, v AS w FROM kept ORDER BY c LIMIT 16
), {_round(1)}, {_round(2)}, {_round(3)}, z AS (
  SELECT vec_id, i, min({{'d': list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j]))), 'c': c, 'w': w}}) AS b FROM kept, c3 GROUP BY vec_id, i
)
SELECT vec_id, b.c::INT AS cluster, b.d::BIGINT AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(b.w, ',')) AS centroid_sha256
FROM z
"""
}
