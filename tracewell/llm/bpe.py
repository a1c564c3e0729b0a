"""Byte-level BPE encoding with a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree are the merge ranks of the adjacent pairs of a word; its root
is the leftmost pair of the lowest rank. A merge changes three leaves, each in
logarithmic time, until the root says that no pair can be merged. A word of n bytes
thus costs O(n log n), however long it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_arrow, table, text_or_empty

#: Fixed by the byte-level format: how a text is cut into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 62
#: Marks of trees over many words: no such pair, and no pair left (a rank takes the bits above six).
_FAR, _LAST = 1 << 24, (1 << 31) - 1


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file: a plain, picklable dict of about 2 MB.

    Files that ask for anything but plain byte-level BPE are refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without a normalizer and a prefix space are served")
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain BPE models are served")
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"]):
        raise ValueError("added tokens must match as they stand")
    byte_of = byte_symbols()
    vocab = spec["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
    pieces |= {i: s.encode() for s, i in added.items()}
    return {"pieces": pieces, "bytes": {b: vocab[c] for c, b in byte_of.items()}, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], "added": added}


def _lengths(offsets: np.ndarray) -> np.ndarray:
    return np.diff(offsets)


def _gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``rows`` of a ragged array, one after another, with their offsets."""
    n = _lengths(offsets)[rows]
    out = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(offsets[rows] - out[:-1], n) + np.arange(out[-1])], out


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array."""
    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8), at - at[0]


class ByteBPE:
    """Encoder and decoder. Nothing is kept from one call to the next.

    The texts of a call are cut into words, and each distinct word is merged once. Short
    words of about the same length are merged together: their segment trees are the rows
    of one array, and each step makes one merge in every word that still has one.
    """

    #: Words up to so many bytes are merged together, if there are enough of them.
    TOGETHER, ENOUGH = 64, 16

    def __init__(self, spec: dict):
        self.pieces = [spec["pieces"].get(i, b"") for i in range(max(spec["pieces"]) + 1)]
        self.first = [spec["bytes"][b] for b in range(256)]
        self.ranks = {a << 20 | b: rank for rank, (a, b, _) in enumerate(spec["merges"])}
        self.merged = [c for _, _, c in spec["merges"]]
        self.added = spec["added"]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        # the same tables for many words at a time
        keys = np.array([a << 20 | b for a, b, _ in spec["merges"]], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged_array = np.array(self.merged, np.int32)
        self.first_array = np.array(self.first, np.int32)
        self.piece_array = pa.array(self.pieces, pa.binary())

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word, merged by rank; ties go to the leftmost pair."""
        first, get, merged = self.first, self.ranks.get, self.merged
        ids = [first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        a = ids[0]
        for i in range(1, n):
            b = ids[i]
            r = get(a << 20 | b)
            if r is not None:
                tree[size + i - 1] = r << 32 | i - 1
            a = b
        for p in range(size - 1, 0, -1):
            a, b = tree[2 * p], tree[2 * p + 1]
            tree[p] = a if a < b else b
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        while (best := tree[1]) < _NONE:
            lo = i = best & 0xFFFFFFFF
            hi = right[i]
            k = right[hi]
            new = ids[i] = merged[best >> 32]
            ids[hi] = -1
            right[i] = k
            tree[size + hi] = tree[size + i] = _NONE
            if k < n:
                left[k] = i
                r = get(new << 20 | ids[k])
                if r is not None:
                    tree[size + i] = r << 32 | i
            if left[i] >= 0:
                lo = left[i]
                r = get(ids[lo] << 20 | new)
                tree[size + lo] = _NONE if r is None else r << 32 | lo
            # the changed leaves lie within three symbols; their paths soon become one
            lo, hi = size + lo >> 1, size + hi >> 1
            while hi:
                for p in range(lo, hi + 1):
                    a, b = tree[2 * p], tree[2 * p + 1]
                    tree[p] = a if a < b else b
                lo >>= 1
                hi >>= 1
        return [i for i in ids if i >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs, _FAR for those that cannot be merged (an id of -1 never can)."""
        if not len(self.keys):
            return np.full(a.shape, _FAR, np.int32)
        want = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], _FAR).astype(np.int32)

    def _together(self, data: np.ndarray, begin: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words of up to ``size`` bytes, in their order. All trees take a step at once."""
        w, wide, step = len(n), size + 2, 2 * size
        ids = np.full((w, wide), -1, np.int32)
        inside = np.arange(wide) < n[:, None]
        ids[inside] = self.first_array[data[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        tree = np.full((w, step), _LAST, np.int32)
        r = self._rank(ids[:, : size - 1], ids[:, 1:size])
        tree[:, size : step - 1] = np.where(r == _FAR, _LAST, r << 6 | np.arange(size - 1, dtype=np.int32))
        at = size
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        right = np.tile(np.arange(1, wide + 1, dtype=np.int32), (w, 1))
        left = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (w, 1))
        ids, tree, right, left = ids.ravel(), tree.ravel(), right.ravel(), left.ravel()
        live = np.arange(w)
        while True:
            best = tree[live * step + 1]
            some = best < _LAST
            live, best = live[some], best[some]
            if not len(live):
                break
            row, node = live * wide, live * step + size
            i = best & 63
            hi = right[row + i]
            k = right[row + hi]
            new = self.merged_array[best >> 6]
            ids[row + i] = new
            ids[row + hi] = -1
            right[row + i] = k
            left[row + k] = i
            lo = left[row + i]
            has_lo = lo >= 0
            lo = np.where(has_lo, lo, i)
            ranks = self._rank(np.concatenate([new, np.where(has_lo, ids[row + lo], -1)]), np.concatenate([ids[row + k], new]))
            leaf = np.where(ranks == _FAR, _LAST, ranks << 6 | np.concatenate([i, lo]))
            tree[node + hi] = _LAST
            tree[node + i] = leaf[: len(live)]
            tree[(node + lo)[has_lo]] = leaf[len(live) :][has_lo]
            changed, top = np.stack([size + lo, size + i, size + hi]) >> 1, live * step
            while changed[0, 0]:  # all leaves have one depth
                a = top + 2 * changed
                tree[top + changed] = np.minimum(tree[a], tree[a + 1])
                changed >>= 1
        ids = ids.reshape(w, wide)
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _merge_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words as a ragged array."""
        data, at = _parts(words)
        n = _lengths(at)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, least = 8, 0
        while size <= self.TOGETHER:
            rows = np.flatnonzero((n > least) & (n <= size))
            if len(rows) >= self.ENOUGH:
                parts.append((rows, *self._together(data, at[rows], n[rows], size)))
                n = np.where((n > least) & (n <= size), 0, n)
            size, least = 2 * size, size
        rest = np.flatnonzero(n > 0)
        ids = [self.merge(data[at[r] : at[r + 1]].tobytes()) for r in rest]
        parts.append((rest, np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))))
        counts = np.zeros(len(words), np.int64)
        for rows, _, k in parts:
            counts[rows] = k
        out = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(out[-1], np.int32)
        for rows, values, k in parts:
            flat[np.repeat(out[rows] - (np.cumsum(k) - k), k) + np.arange(len(values))] = values
        return flat, out

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks as a ragged array. The ends of a chunk are ends of words."""
        data, at = _parts(chunks)
        n = _lengths(at)
        # chunks that begin with a space and a non-space, and end in a non-space, can be searched as one text
        head, second, last = at[:-1], np.minimum(at[:-1] + 1, len(data) - 1), at[1:] - 1
        plain = (n > 1) & (data[head] == 32) & _no_space_after(data, second) & _no_space_before(data, last + 1) if len(data) else np.zeros(len(n), bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        one = pa.compute.binary_join(pa.scalar(chunks.take(pa.array(order[: plain.sum()])).to_pylist(), pa.list_(pa.string())), "").as_py() or ""
        found = self.find(one)
        for k in order[plain.sum() :]:
            found += self.find(chunks[int(k)].as_py())
        coded = pa.array(found, pa.string()).dictionary_encode()
        ids, ids_at = self._merge_all(coded.dictionary)
        word = coded.indices.to_numpy()
        ids, ids_at = _gather(ids, ids_at, word)
        # words and chunks cover the same bytes, so a chunk ends where one of its words does
        ends = np.cumsum(_lengths(_parts(coded.dictionary)[1])[word])
        chunk_ends = np.cumsum(n[order])
        upto = np.where(chunk_ends > 0, ids_at[np.searchsorted(ends, chunk_ends, "left") + 1] if len(ends) else 0, 0)
        begin = np.concatenate([[0], upto[:-1]]) if len(upto) else upto
        counts = np.empty(len(n), np.int64)
        counts[order] = upto - begin
        out = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(out[-1], np.int32)
        k = upto - begin
        flat[np.repeat(out[order] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return flat, out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, as a ragged array.

        A single space between two non-spaces always starts a word, so texts can be cut
        there, and each distinct chunk between two cuts is encoded once.
        """
        data, at = _parts(texts)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        spaces = np.flatnonzero(data == 32)
        spaces = spaces[(spaces > 0) & (spaces < len(data) - 1)]
        spaces = spaces[_no_space_after(data, spaces + 1) & _no_space_before(data, spaces)]
        cut = np.union1d(spaces, at)
        chunks = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        ids, out = _gather(*self._chunk_ids(coded.dictionary), coded.indices.to_numpy())
        return ids, out[np.searchsorted(cut, at)]

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Ids of every text (string array without nulls), as lists of int32; strings of added tokens become their ids."""
        special = np.zeros(len(texts), bool)
        for t in self.added:
            special |= pa.compute.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if not special.any():
            ids, at = self._plain(texts)
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        cut = [self.split_added.split(t.as_py()) if s else [t.as_py()] for t, s in zip(texts, special)]
        ids, at = self._plain(pa.array(list(chain.from_iterable(c[::2] for c in cut)), pa.string()))
        k, out = 0, []
        for c in cut:
            row = [ids[at[k] : at[k + 1]]]
            for j in range(1, len(c), 2):
                k += 1
                row += [np.array([self.added[c[j]]], np.int32), ids[at[k] : at[k + 1]]]
            k += 1
            out.append(np.concatenate(row))
        return pa.array(out, pa.list_(pa.int32()))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids; bytes that are not UTF-8 become U+FFFD."""
        flat, at = ids.flatten(), ids.offsets.to_numpy().astype(np.int64)
        data, ends = _parts(self.piece_array.take(flat))
        own = ends[at - at[0]].astype(np.int32)
        joined = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(own), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.as_py().decode("utf-8", "replace") for b in joined], pa.string())

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def decode(self, ids: list[int]) -> str:
        """The text of one list of ids."""
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def _no_space_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that starts at a byte is surely not white space; False where that is not plain."""
    b = data[at]
    return (b > 32) & (b != 0xC2) & ((b < 0xE1) | (b > 0xE3))


def _no_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends right before a byte is surely not white space."""
    b, b2, b3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return (b > 32) & ((b < 128) | (b2 != 0xC2) & ((b3 < 0xE1) | (b3 > 0xE3)))


_loaded: dict[str, ByteBPE] = {}


def _tokenizer(key: str, shared) -> ByteBPE:
    """One tokenizer for each Python worker, for all tasks that it runs."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(shared.value)
    return _loaded[key]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of a string column of about ``most`` bytes; a longer text is one of its own."""
    ends = np.cumsum(_lengths(_parts(column)[1]))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, upto - at
        at = upto


def encoded(docs: DataFrame, path: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, ids, decoded) for every row: token ids of the whole text, and the text they decode to.

    A null text counts as empty and has no ids; an empty table gives no rows. Rows are
    neither merged nor moved: the work is one pass without a shuffle. Other columns of
    ``docs`` are not read. A Python worker holds the tables of the tokenizer and what one
    slice of about ``slice_bytes`` of text needs; a longer text is a slice of its own.
    """
    with open(path, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(key, shared)
        for whole in batches:
            for at, n in slices(whole.column(1), slice_bytes):
                b = whole.slice(at, n)
                ids = bpe.encode_all(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), ids, bpe.decode_all(ids)], ["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(narrow, run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Token count, and digests of ids and decoded text, of what ``encoded`` returned."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def default_path() -> str:
    """The tokenizer file of the installed vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(encoded(table(spark, sf_dir, "documents"), path or default_path()))


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}
