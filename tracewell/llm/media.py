"""Media columns stored as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has twelve zero bits,
so equal stretches give equal chunks wherever they stand. Every chunk is kept once:
Spark finds the digests that occur more than once, chunks with those digests go to a
pool with one row per digest, and all other chunks stay in the row of their media,
where they were made. A media row lists its chunks in order. Reading back joins the
pool's chunks, puts the list together and verifies every digest.

Which chunks are shared is told to the writing tasks by a bit array of fixed size. A
false hit only sends an unshared chunk through the pool, so the array's size decides
how much is shuffled and never what is stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_arrow, staged, table

FRAME = 192
LEAST, MOST, CUT_BITS = 1024, 16384, 12
FILTER_BITS = 1 << 23


def gear(seed: int = 0x5EED) -> np.ndarray:
    """The 256 random words of the gear hash, from a splitmix generator."""
    out, x, m = [], seed, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & m
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        z = (z ^ z >> 27) * 0x94D049BB133111EB & m
        out.append((z ^ z >> 31) & 0xFFFFFFFF)
    return np.array(out, np.uint32)


_GEAR = gear()


def cuts(payload: bytes) -> list[int]:
    """Ends of the payload's chunks: of 1,024 to 16,384 bytes, the last one as it comes."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # doubling the window: 2, 4, ... 32 bytes
        h[s:] += h[:-s] << np.uint32(s)
    places = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, at = [], 0
    for p in places:
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if p - at >= LEAST and p < n:
            at = p
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw.ljust(size, b" "), len(raw)


def wav_header(n: int) -> bytes:
    """Header of a mono WAV file with ``n`` unsigned 8-bit samples at 8 kHz."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n)


def wav_samples(media: bytes) -> bytes:
    """The samples of such a file."""
    riff, size, wave, _, _, coding, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, wave, coding, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or size != 36 + n or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def chunks_of(text: str | None) -> tuple[str, int, list[bytes], list[bytes]]:
    """Of a text's media: its SHA-256, unpadded bytes, and its payload's chunks with their digests."""
    payload, n = payload_of(text)
    media = hashlib.sha256(wav_header(len(payload)))
    media.update(payload)
    ends = cuts(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends], ends)]
    return media.hexdigest(), n, [hashlib.blake2b(p, digest_size=16).digest() for p in parts], parts


def rebuilt(media: str, digests: list[bytes], parts: list[bytes]) -> bytes:
    """The media file from its ordered chunks; every chunk and the whole are verified."""
    for d, p in zip(digests, parts, strict=True):
        if p is None or hashlib.blake2b(p, digest_size=16).digest() != d:
            raise ValueError(f"a chunk of media {media} is missing or damaged")
    payload = b"".join(parts)
    out = wav_header(len(payload)) + payload
    if hashlib.sha256(out).hexdigest() != media:
        raise ValueError(f"media {media} does not match its digest")
    return out


def describe(media: bytes, n_chunks: int) -> tuple[int, str, int, int, str, str]:
    """What the query reports of a stored file: payload and media size and digests, tail CRC, features."""
    payload = wav_samples(media)
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((s[1:] >= 0) != (s[:-1] >= 0)))
    feature = f"ms={len(s) // 8};mean={int(s.sum()) * 1000 // len(s)};power={int((s * s).sum()) // len(s)};peak={int(np.abs(s).max())};turns={turns};chunks={n_chunks}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


STORE_SCHEMA = "doc_id long, media string, n_bytes long, digests array<binary>, inline array<binary>, pool_digest binary, pool_bytes binary"
_STORE_TYPES = [("doc_id", pa.int64()), ("media", pa.string()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary())), ("inline", pa.list_(pa.binary())), ("pool_digest", pa.binary()), ("pool_bytes", pa.binary())]
DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DESCRIBED_TYPES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _bit(column: str, bits: int):
    return F.pmod(F.xxhash64(column), F.lit(bits))


def shared_filter(docs: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bit array that has the bit of every chunk digest that occurs more than once in ``docs``.

    Digests are counted by a pre-aggregated shuffle of digests alone. The driver gets at
    most ``bits`` / 64 words, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([d for t in b.column(0) for d in chunks_of(t.as_py())[2]], pa.binary())], ["digest"])

    words = (
        map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "digest binary")
        .groupBy("digest").count().where("count > 1")
        .select(_bit("digest", bits).alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("mask"))
    )
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["mask"]
    return out.tobytes()


def store(docs: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Write the media of ``docs`` (doc_id, text): the media table and the chunk pool.

    The media table has one row per document: ordered ``digests``, and ``inline`` with
    the bytes of chunks that no other place has, null where the pool has them. The pool
    has (digest, bytes), each digest once. Null texts count as empty; every text has at
    least one chunk.
    """
    import xxhash

    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(shared_filter(docs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(common.value, np.int64)

        def shared(d: bytes) -> bool:
            # the same hash as Spark's xxhash64 of a binary column
            b = xxhash.xxh64_intdigest(d, 42)
            b = (b - (1 << 64) if b >> 63 else b) % bits
            return bool(int(mask[b // 64]) >> (b % 64) & 1)

        sent: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows, pool = [], []
                for doc_id, text in zip(*b.columns):
                    media, n, digests, parts = chunks_of(text.as_py())
                    inline = [None if shared(d) else p for d, p in zip(digests, parts)]
                    rows.append((doc_id.as_py(), media, n, digests, inline, None, None))
                    for d, p, i in zip(digests, parts, inline):
                        if i is None and d not in sent:
                            if len(sent) >= 200_000:  # forgetting only sends a chunk again
                                sent.clear()
                            sent.add(d)
                            pool.append((None, None, None, None, None, d, p))
                for part in (rows, pool):
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*part), _STORE_TYPES)], [n for n, _ in _STORE_TYPES])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = staged(map_arrow(narrow, run, STORE_SCHEMA), "media")
    pool = written.where("pool_digest IS NOT NULL").groupBy(F.col("pool_digest").alias("digest")).agg(F.first("pool_bytes").alias("bytes"))
    return written.where("media IS NOT NULL").select("doc_id", "media", "n_bytes", "digests", "inline"), staged(pool, "media-pool")


def read_back(media: DataFrame, pool: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, and what ``describe`` says) of every stored media, from its stored bytes.

    Media whose chunks are all inline are read where they lie. Of the others every
    distinct media is put together once, from a join of its chunk list with the pool.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.schema.names[:-2]
            out = [describe(rebuilt(m.as_py(), d.as_py(), p.as_py()), len(d)) for m, d, p in zip(b.column("media"), b.column("digests"), b.column("parts"))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(x, t) for x, (_, t) in zip(zip(*out), _DESCRIBED_TYPES))], [*keys, *(n for n, _ in _DESCRIBED_TYPES)])

    whole = F.expr("forall(inline, x -> x IS NOT NULL)")
    here = map_arrow(media.where(whole).select("doc_id", "n_bytes", "media", "digests", F.col("inline").alias("parts")), run, f"doc_id long, n_bytes long, media string, {DESCRIBED}")
    rest = media.where(~whole)
    refs = rest.select("media", F.struct("digests", "inline").alias("list")).groupBy("media").agg(F.first("list").alias("list"))
    refs = refs.select("media", F.posexplode(F.expr("arrays_zip(list.digests, list.inline)")).alias("no", "c")).select("media", "no", F.col("c.digests").alias("digest"), F.col("c.inline").alias("inline"))
    joined = refs.join(pool, "digest", "left").select("media", F.struct("no", "digest", F.coalesce("inline", "bytes").alias("part")).alias("c"))
    lists = joined.groupBy("media").agg(F.array_sort(F.collect_list("c")).alias("c")).select("media", F.col("c.digest").alias("digests"), F.col("c.part").alias("parts"))
    there = map_arrow(lists, run, f"media string, {DESCRIBED}")
    names = [n for n, _ in _DESCRIBED_TYPES]
    return here.select("doc_id", "n_bytes", *names).unionByName(rest.select("doc_id", "n_bytes", "media").join(there, "media").select("doc_id", "n_bytes", *names))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(*store(table(spark, sf_dir, "documents")))


QUERIES = {"op4_media": op4_media}
ORACLE_SQL: dict[str, str] = {}
