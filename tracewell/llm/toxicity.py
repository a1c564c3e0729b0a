"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

A document is the set of its hashed character n-grams. The log ratio of an n-gram's
counts in toxic and other documents (naive Bayes) scales the n-gram's feature, and a
ridge-penalised logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import held_out, labelled_sample, map_arrow, staged, table, text_or_empty

ORDERS = (3, 5, 7)
BITS = 21
#: At most so many labelled rows are learned from, and so many n-grams are kept, out of 2 ** BITS buckets.
SAMPLE_ROWS = 12000
FEATURES = 1024
_PIECE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a lower-cased text with a space at both ends.

    N-grams are of code points. Long texts come in pieces, so memory is bounded; pieces
    overlap by the longest n-gram less one, so no n-gram is lost.
    """
    most = max(ORDERS)
    text = f" {text.lower()} "
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at : at + _PIECE + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gram = c.copy()
        for n in range(2, most + 1):
            if len(c) < n:
                break
            gram = gram[:-1] * _MIX + c[n - 1 :]
            if n in ORDERS:
                yield ((gram ^ gram >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93 + 2 * n)) >> np.uint64(64 - BITS)


def presence(text: str, slot: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, or the distinct slots of those that have one."""
    parts = []
    for h in hashed(text):
        if slot is not None:
            h = slot[h]
            h = h[h >= 0]
        parts.append(np.unique(h))
    return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.empty(0, np.int64)


@dataclass
class Model:
    """A fitted classifier: buckets of the kept n-grams, their weights, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        s = np.full(1 << BITS, -1, np.int16)
        s[self.buckets] = np.arange(len(self.buckets), dtype=np.int16)
        return s

    def score(self, text: str, slot: np.ndarray) -> float:
        z = self.bias + self.weights[presence(text, slot)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated full-batch gradient descent."""
    # in the matrix's own precision throughout: a mixed product would copy the matrix at each step
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    n, k = x.shape
    w, b = np.zeros(k, np.float32), np.float32(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    # the largest eigenvalue of x'x/n by power iteration bounds the curvature
    v = np.ones(k, np.float32) / np.float32(np.sqrt(max(k, 1)))
    for _ in range(15):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + np.float32(1e-12)
    step = np.float32(1 / (0.25 * (np.linalg.norm(x @ v) ** 2 / n + 1) + ridge))
    wy, by = w.copy(), b
    for t in range(steps):
        g = 1 / (1 + np.exp(-(x @ wy + by))) - y
        w2, b2 = wy - step * ((g @ x) / n + np.float32(ridge) * wy), by - step * g.mean()
        m = np.float32(t / (t + 3))
        wy, by = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, float(b)


def _telling(seen: np.ndarray, n: np.ndarray, features: int, block: int = 1 << 17) -> np.ndarray:
    """The ``features`` buckets of greatest chi-squared, the first of equal ones, ascending; a block of buckets at a time."""
    best, kept = np.empty(0), np.empty(0, np.int64)
    for at in range(0, seen.shape[1], block):
        neg, pos = seen[:, at : at + block].astype(np.float64)
        total = pos + neg
        expected = total * n[1] / n.sum()
        chi = np.where(total >= 5, (pos - expected) ** 2 / np.maximum(expected * (1 - total / n.sum()), 1e-9), 0)
        some = np.flatnonzero(chi > 0)
        best, kept = np.concatenate([best, chi[some]]), np.concatenate([kept, some + at])
        order = np.argsort(-best, kind="stable")[:features]
        best, kept = best[order], kept[order]
    return np.sort(kept)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = SAMPLE_ROWS, features: int = FEATURES, ridge: float = 1e-4) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out.

    Tasks count, for each bucket, the toxic and the other documents that have it; the
    count vectors of 8 tasks are summed on the driver. N-grams are ranked by chi-squared
    and the first ``features`` kept. Labels other than 0 and 1 count as missing. Without any labelled row, or with one class only,
    the model is the constant of the label's share.
    """
    sample = staged(labelled_sample(docs, labels, target, rows).select("text", "label"), "toxic-sample").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for b in batches:
            for t, y in zip(*b.columns):
                seen[y.as_py(), presence(t.as_py())] += 1
                rows[y.as_py()] += 1
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(pa.int64())), pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], ["rows", "seen"])

    # counts of a bounded sample fit 32 bits
    seen, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for r in map_arrow(sample, count, "rows array<long>, seen binary").collect():
        seen += np.frombuffer(zlib.decompress(r["seen"]), np.int32).reshape(2, -1)
        n += np.array(r["rows"])
    if not n.all():
        share = n[1] / max(n.sum(), 1)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    buckets = _telling(seen, n, features)
    neg, pos = seen[:, buckets].astype(np.float64)
    del seen
    ratio = np.log((pos + 1) / (n[1] + 2)) - np.log((neg + 1) / (n[0] + 2))
    slot = Model(buckets, ratio, 0.0).slots()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in b.column(0):
                bits = np.zeros(kept, np.bool_)
                bits[presence(t.as_py(), slot)] = True
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1)], ["bits", "label"])

    kept = len(buckets)
    got = map_arrow(sample, rows_of, "bits binary, label int").collect()
    x = np.empty((len(got), kept), np.float32)
    for i, r in enumerate(got):
        x[i] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=kept)
    x *= ratio.astype(np.float32)
    w, b = logistic(x, np.array([r["label"] for r in got], np.float32), ridge)
    return Model(buckets, w * ratio, b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row: one pass without a shuffle. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slot = m.slots()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py(), slot) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns.

    One pass without a shuffle; a row is judged by its own text alone, so null ids and
    repeated rows are no special cases.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slot = m.slots()
        for b in batches:
            keep = pa.array([m.score(t.as_py() or "", slot) < threshold for t in b.column(at)], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.filter(keep).columns, names)

    return map_arrow(docs, run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
