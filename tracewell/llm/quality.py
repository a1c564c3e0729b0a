"""Quality by a generalised additive model with pairwise interactions.

Shallow trees on one binned feature at a time are boosted in cycles, so that what each
feature contributes is one lookup table. The pairs of features that explain most of
what is left get two-dimensional tables in the same way. A score is the logistic
function of the sum of a document's table cells, added for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import held_out, labelled_sample, map_arrow, staged, table, text_or_empty

#: At most so many labelled rows are learned from.
SAMPLE_ROWS = 8000
BINS = 32
NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "bars", "bangs", "symbols", "letters", "non_ascii", "lines", "line_bytes", "distinct_words", "top_word", "repeated_lines", "short_words", "entropy")

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_MARK = np.frombuffer(b".,;:?'\"()-", np.uint8)
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)


def features(text: str) -> list[float]:
    """The features in NAMES: of bytes, words and lines of the whole text; zeros if it is empty."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(raw)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    seen = Counter(words)
    p = h[h > 0] / n
    letters = h[_UPPER].sum() + h[_LOWER].sum() + h[128:].sum()
    return [
        np.log1p(n), np.log1p(len(words)), (n - len(words)) / len(words), h[_UPPER].sum() / max(letters, 1), h[_DIGIT].sum() / n, h[_MARK].sum() / n,
        h[124] / n, h[33] / n, h[_SYMBOL].sum() / n, letters / n, h[128:].sum() / n, len(lines) / len(words), np.log1p(n / len(lines)),
        len(seen) / len(words), seen.most_common(1)[0][1] / len(words), 1 - len(set(lines)) / len(lines), sum(map((3).__ge__, map(len, words))) / len(words), float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Model:
    """Bin edges by feature, a table by feature, tables by pair, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        q = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            z += t[q[:, j]]
        for i, j, t in self.pairs:
            z += t[q[:, i], q[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> np.ndarray:
    """Values per bin of a tree of up to three leaves on one binned feature."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[lo : hi - 1]), np.cumsum(h[lo : hi - 1])
        gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
        gain = np.where((hl >= least) & (hs - hl >= least), gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge), -1.0)
        k = int(np.argmax(gain)) if len(gain) else -1
        return (float(gain[k]), lo + k + 1) if k >= 0 else (-1.0, -1)

    leaves = [(0, len(g))]
    for _ in range(2):
        (gain, at), leaf = max((cut(*x), x) for x in leaves)
        if gain <= 1e-9:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], at), (at, leaf[1])]
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain and its values per cell."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def four(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return np.stack([a, b, d, c[-1, -1] - a - b - d])

    fg, fh = four(cg), four(ch)
    gain = (fg**2 / (fh + ridge)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = -fg[:, i, j] / (fh[:, i, j] + ridge)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.1, ridge: float = 2.0) -> Model:
    """Fit the tables. Without rows or with one class only, the model is a constant."""
    share = float(y.mean()) if len(y) else 0.5
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.empty(0) for j in range(k)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], bias)
    if not 0 < share < 1:
        return model
    q, z = model.bins(x), np.full(len(y), bias)
    for _ in range(rounds):
        for j in range(k):
            p = 1 / (1 + np.exp(-z))
            size = len(edges[j]) + 1
            step = rate * _tree(np.bincount(q[:, j], p - y, size), np.bincount(q[:, j], p * (1 - p), size), 2.0, ridge)
            model.tables[j] += step
            z += step[q[:, j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        shape = len(edges[i]) + 1, len(edges[j]) + 1
        at = q[:, i] * shape[1] + q[:, j]
        return np.bincount(at, p - y, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(*cells(i, j), ridge)[0], i, j) for i in range(k) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for gain, i, j in ranked if gain > 0]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            step = rate * _quadrants(*cells(i, j), ridge)[1]
            t += step
            z += step[q[:, i], q[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out; only their features are collected.

    Labels other than 0 and 1 count as missing.
    """
    sample = staged(labelled_sample(docs, labels, target, rows).select("text", "label"), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()) for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    got = map_arrow(sample, run, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in got], np.float64).reshape(-1, len(NAMES))
    return train(x, np.array([r["label"] for r in got], np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row: one pass without a shuffle. Null texts count as empty.

    Features beyond those of all labelled rows fall into the outermost bins. So texts of a
    word or two, and very long ones, get what the nearest labelled texts contribute, and
    empty ones, whose features are all zero, what the lowest bins do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
