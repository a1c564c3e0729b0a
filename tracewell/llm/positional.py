"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document: each task inverts its own documents into segments,
and a segment holds, for every term of its texts, the ascending list of positions
(postings). Segments are stored as rows of a Parquet table, so no posting is ever
shuffled and any later test set can be matched against the stored index.

A phrase is matched in a segment by starting from its rarest term: the postings of
that term, moved by the term's offset, are the candidate starts, and they are
intersected with the postings of the other terms, moved by theirs, in order of rising
frequency. Postings of all terms lie in one ascending array of (term, position), so
one binary search intersects the lists of all phrases of a test set at once. A
proximity match lets every term lie up to ``slop`` words from its place.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_arrow, staged, table, text_or_empty

#: Bytes that end a word: all ASCII but digits and letters; A-Z fall to a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

SEGMENT_SCHEMA = "segment long, doc_ids array<long>, texts array<binary>, n_words array<int>, terms binary, counts binary, positions binary"


def words_of(text: str | bytes | pa.Buffer | None) -> list[bytes]:
    """A text's words as UTF-8: runs of ASCII digits, letters (lower-cased) and all of non-ASCII."""
    raw = (text or "").encode("utf-8", "surrogatepass") if text is None or isinstance(text, str) else bytes(text)
    return raw.translate(_FOLD).split()


# ---------------------------------------------------------------- the index


def _segment(lengths: list[int], words: list[bytes]) -> tuple:
    """One segment: sorted terms, postings per term; documents lie one free position apart."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    term = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    terms = sorted(number)
    rank = np.empty(len(terms), np.int32)
    rank[np.fromiter((number[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms), dtype=np.int32)
    term = rank[term]
    gaps = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    order = np.argsort(term, kind="stable").astype(np.int32)
    positions = order + gaps[order]
    counts = np.bincount(term, minlength=len(terms)).astype(np.int32)
    return lengths, b" ".join(terms), counts.tobytes(), positions.tobytes()


def build_index(docs: DataFrame, segment_words: int = 400_000) -> DataFrame:
    """The stored positional index of ``docs`` (doc_id, text): one row per segment.

    A segment takes documents until it holds ``segment_words`` words; a longer document
    has one of its own. Null and empty texts are indexed with no words, so every row of
    ``docs`` is in the index once. Columns: segment (its number), doc_ids, texts (MD5 of
    the text) and n_words (per document), terms (sorted, space-joined), counts (postings
    per term, int32), positions (int32, by term).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())

        def row(*parts):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(parts, types)], ["segment", "doc_ids", "texts", "n_words", "terms", "counts", "positions"])

        ids, texts, lengths, words = [], [], [], []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_buffer() if t.is_valid else b""
                w = words_of(raw)
                if words and len(words) + len(w) > segment_words:
                    yield row(number, ids, texts, *_segment(lengths, words))
                    number += 1
                    ids, texts, lengths, words = [], [], [], []
                ids.append(i)
                texts.append(hashlib.md5(raw).digest())
                lengths.append(len(w))
                words += w
        if ids:
            yield row(number, ids, texts, *_segment(lengths, words))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(map_arrow(narrow, run, SEGMENT_SCHEMA), "postings")


class Segment:
    """A segment in memory: the postings of all terms as one ascending array of (term, position)."""

    def __init__(self, n_words: list[int], terms: bytes, counts: bytes, positions: bytes):
        self.terms = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.counts = np.frombuffer(counts, np.int32)
        self.begin = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.positions = np.frombuffer(positions, np.int32)
        self.postings = np.repeat(np.arange(len(self.counts), dtype=np.int64) << 32, self.counts) | self.positions
        self.starts = np.concatenate([[0], np.cumsum(np.asarray(n_words, np.int64) + 1)])

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term has a posting from ``low`` to ``high``, for many terms at once."""
        at = np.minimum(np.searchsorted(self.postings, term.astype(np.int64) << 32 | low), len(self.postings) - 1)
        return (low <= high) & (self.postings[at] >= (term.astype(np.int64) << 32 | low)) & (self.postings[at] <= (term.astype(np.int64) << 32 | high))


# ---------------------------------------------------------------- the test set


@dataclass
class Phrases:
    """Phrases of a test set as term numbers; ``-1`` fills short ones. ``owner`` lists each phrase's items."""

    vocabulary: list[bytes]
    terms: np.ndarray
    lengths: np.ndarray
    owner_begin: np.ndarray
    owner: np.ndarray
    items: list[str]


def phrases_of(items: list[tuple], window: int = 10) -> Phrases:
    """The distinct windows of ``window`` words of the items (item_id, text); shorter items whole."""
    owners: dict[tuple[bytes, ...], dict[int, None]] = {}
    names: list[str] = []
    for item_id, text in items:
        w = words_of(text)
        if not w or item_id is None:
            continue
        names.append(str(item_id))
        for i in range(max(1, len(w) - window + 1)):
            owners.setdefault(tuple(w[i : i + window]), {})[len(names) - 1] = None
    vocabulary = sorted({t for p in owners for t in p})
    number = {t: i for i, t in enumerate(vocabulary)}
    terms = np.full((len(owners), window), -1, np.int32)
    for r, p in enumerate(owners):
        terms[r, : len(p)] = [number[t] for t in p]
    lengths = (terms >= 0).sum(axis=1)
    counts = [len(o) for o in owners.values()]
    return Phrases(vocabulary, terms, lengths, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.fromiter((i for o in owners.values() for i in o), np.int64, sum(counts)), names)


def match(seg: Segment, ph: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, document) of every occurrence in the segment.

    A phrase occurs at a start if each of its terms, in the same document, has a posting
    at most ``slop`` from start plus its offset. Slop 0 is the exact phrase. With slop, a
    start may lie before the document's first word, and neighbouring starts may all match.
    """
    none = (np.empty(0, np.int64),) * 3
    if not len(ph.terms) or not seg.terms:
        return none
    local = np.fromiter((seg.terms.get(t, -1) for t in ph.vocabulary), np.int32, len(ph.vocabulary))
    used = ph.terms >= 0
    here = np.where(used, local[ph.terms], -1)
    alive = np.flatnonzero((~used | (here >= 0)).all(axis=1))
    if not len(alive):
        return none
    here, used = here[alive], used[alive]
    freq = np.where(used, seg.counts[here], np.iinfo(np.int32).max)
    order = np.argsort(freq, axis=1, kind="stable")  # rarest first, fillers last
    found = []
    # so many phrases at a time that their candidates fit in a bounded array
    n = freq[np.arange(len(alive)), order[:, 0]].astype(np.int64)
    block = np.cumsum(n) * (2 * slop + 1) // _CANDIDATES
    for rows in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(block)) + 1):
        lead = order[rows, 0]
        phrase = np.repeat(rows, n[rows])
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        post = seg.positions[np.repeat(seg.begin[here[rows, lead]], n[rows]) + within].astype(np.int64)
        doc = np.searchsorted(seg.starts, post, "right") - 1
        start = (post - order[phrase, 0])[:, None] + np.arange(-slop, slop + 1)
        phrase, doc, start = np.repeat(phrase, 2 * slop + 1), np.repeat(doc, 2 * slop + 1), start.ravel()
        for k in range(1, order.shape[1]):
            if not len(phrase):
                break
            col = order[phrase, k]
            place = start + col
            low, high = np.maximum(place - slop, seg.starts[doc]), np.minimum(place + slop, seg.starts[doc + 1] - 2)
            ok = ~used[phrase, col] | seg.near(here[phrase, col], low, high)
            phrase, start, doc = phrase[ok], start[ok], doc[ok]
        found.append((alive[phrase], start, doc))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pieces(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """(item_id, piece, text): items cut into pieces that overlap by a window less one word, so no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                w = words_of(t.as_py())
                for k, at in enumerate(range(0, max(1, len(w) - window + 1), piece_words)):
                    text = b" ".join(w[at : at + piece_words + window - 1]).decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.string()), pa.array([k], pa.int32()), pa.array([text], pa.string())], ["item_id", "piece", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text")).where("item_id IS NOT NULL")
    return map_arrow(items, run, "item_id string, piece int, text string")


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[int, Phrases]]:
    """(number of blocks, block): the test set in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    pieces = _pieces(benchmark, window, max(1, block_bytes // 64))
    total = staged(pieces.withColumn("size", F.octet_length("text")), "benchmark")
    n = -(-int(total.agg(F.sum("size")).first()[0] or 0) // block_bytes) or 1
    if n > 1:
        total = staged(total.withColumn("block", F.pmod(F.xxhash64("item_id", "piece"), F.lit(n))), "benchmark", partition_by="block")
    for k in range(n):
        rows = (total if n == 1 else total.where(F.col("block") == k)).select("item_id", "text").collect()
        yield n, phrases_of([tuple(r) for r in rows], window)


HITS_SCHEMA = "segment long, place int, doc_id long, key binary, n_words long, spans array<struct<a:int,b:int>>, items array<string>, near array<string>"
#: Candidate starts that are looked at together.
_CANDIDATES = 2_000_000


def _merged(start: np.ndarray, stop: np.ndarray) -> list[dict]:
    """Intervals as disjoint ones, ascending."""
    out: list[dict] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist())):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(b, out[-1]["b"])
        else:
            out.append({"a": a, "b": b})
    return out


def matched(index: DataFrame, ph: Phrases, slop: int = 1, every: bool = True) -> DataFrame:
    """What one block of phrases hits in each document of a stored index.

    Columns: segment and place (which document of the index), doc_id, key (MD5 of the
    text), n_words, spans (disjoint stretches of hit words), items (with exact
    occurrences) and near (with exact or proximity occurrences), both sorted. Without
    ``every`` only documents with an occurrence are returned.
    """
    shared = index.sparkSession.sparkContext.broadcast(ph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = shared.value
        struct = pa.struct([("a", pa.int32()), ("b", pa.int32())])
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(struct), pa.list_(pa.string()), pa.list_(pa.string()))

        def owners(phrase: np.ndarray, doc: np.ndarray) -> dict[int, set[str]]:
            out: dict[int, set[str]] = {}
            for p, d in set(zip(phrase.tolist(), doc.tolist())):
                out.setdefault(d, set()).update(ph.items[i] for i in ph.owner[ph.owner_begin[p] : ph.owner_begin[p + 1]])
            return out

        for b in batches:
            for number, ids, keys, lengths, *postings in zip(*b.columns):
                ids, keys, lengths = ids.as_py(), keys.as_py(), lengths.as_py()
                seg = Segment(lengths, *(x.as_py() for x in postings))
                phrase, start, doc = match(seg, ph)
                items = owners(phrase, doc)
                near = owners(*match(seg, ph, slop)[::2]) if slop else {}
                spans: dict[int, list[dict]] = {}
                start, stop = start - seg.starts[doc], start - seg.starts[doc] + ph.lengths[phrase]
                for d in items:
                    spans[d] = _merged(start[doc == d], stop[doc == d])
                rows = range(len(ids)) if every else sorted(items.keys() | near.keys())
                cols = zip(*((number.as_py(), d, ids[d], keys[d], lengths[d], spans.get(d, []), sorted(items.get(d, ())), sorted(near.get(d, set()) | items.get(d, set()))) for d in rows))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["segment", "place", "doc_id", "key", "n_words", "spans", "items", "near"])

    return map_arrow(index, run, HITS_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 1, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items, near) for every row of ``docs``.

    A document word is hit if it lies in an occurrence of any window of a benchmark
    item. ``items`` are those with exact occurrences; ``near`` adds those with a window
    all of whose words lie within ``slop`` of their places; both are sorted as strings.
    ``key`` is the MD5 of the text.

    The test set is cut into blocks of about ``block_bytes`` bytes of text, long items
    into overlapping pieces. The driver and the tasks hold one block at a time: each is
    broadcast and matched against the whole stored index, and what the blocks hit in a
    document is merged. A test set of one block needs no shuffle.

    Null or empty texts have no words. Items that are null, empty, without words or
    without an id match nothing. Items that share an item_id count once. Repeated rows
    of ``docs`` are returned as often as they occur; an empty table gives no rows.
    """
    index = build_index(docs)
    parts = []
    for n, ph in _blocks(benchmark, window, block_bytes):
        hits = matched(index, ph, slop, every=n == 1)
        parts.append(hits if n == 1 else staged(hits, "hits"))
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        together = lambda c: F.flatten(F.collect_list(c))
        found = found.groupBy("segment", "place").agg(F.array_sort(together("spans")).alias("spans"), F.array_sort(F.array_distinct(together("items"))).alias("items"), F.array_sort(F.array_distinct(together("near"))).alias("near"))
        all_docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "texts", "n_words")).alias("place", "d")).select("segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.texts").alias("key"), F.col("d.n_words").cast("long").alias("n_words"))
        found = all_docs.join(found, ["segment", "place"], "left")
    covered = "aggregate(coalesce(spans, array()), named_struct('at', 0, 'n', 0L), (s, x) -> named_struct('at', greatest(s.at, x.b), 'n', s.n + greatest(0, x.b - greatest(s.at, x.a))), s -> s.n)"
    none = F.array().cast("array<string>")
    return found.select("doc_id", "key", "n_words", F.expr(covered).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark window, with all their columns.

    A row is judged by its text alone, so null and repeated ids are no special cases.
    """
    hit = contamination(docs, benchmark, window, slop=0).where(F.col("n_hit") > 0).select(F.lower(F.hex("key")).alias("_key")).distinct()
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.md5(F.col("text").cast("binary")).alias("_key"))
    return keyed.join(hit, "_key", "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.size("near").cast("long").alias("n_near"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win ON win.n = p.n AND win.t = p.t),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY 1),
place AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
freq AS (SELECT t, count(*) AS c FROM place GROUP BY 1),
ph AS (SELECT t AS phrase, n, unnest(string_split(t, ' ')) AS t, generate_subscripts(string_split(t, ' '), 1) AS k FROM (SELECT DISTINCT t, n FROM win)),
rare AS (SELECT phrase, arg_min(t, c) AS t, arg_min(k, c) AS k FROM (SELECT phrase, n, t, min(k) AS k, c, count(*) AS m FROM ph JOIN freq USING (t) GROUP BY 1, 2, 3, 5) GROUP BY phrase, n HAVING sum(m) = n),
cand AS (SELECT DISTINCT doc_id, phrase, i - rare.k + x AS s FROM rare JOIN place USING (t), (VALUES (-1), (0), (1)) v(x)),
fit AS (SELECT c.doc_id, c.phrase FROM cand c JOIN ph ON ph.phrase = c.phrase JOIN place ON place.doc_id = c.doc_id AND place.t = ph.t AND abs(place.i - (c.s + ph.k)) <= 1
        GROUP BY c.doc_id, c.phrase, c.s, ph.n HAVING count(DISTINCT ph.k) = ph.n),
nr AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM fit JOIN win ON win.t = fit.phrase GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)
""",
}
