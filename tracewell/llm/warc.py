"""WARC archives kept as a chunked record table.

An archive is a table of chunks: (record_id, chunk_no, n_chunks, data, digest). The
chunks of a record in order are its bytes in the WARC format; ``digest`` is the SHA-1
of the payload up to the chunk's end. Writers and readers hold one chunk of payload at
a time and carry the digest's state on, so no step needs a record's size in memory
beyond the value that Spark itself hands over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_arrow, staged, table, text_or_empty

#: Names fixed by the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
#: Over so many tasks the rows of one payload are dealt in joins.
SALTS = 16
CHUNK_SCHEMA = "record_id string, chunk_no int, n_chunks int, data binary, digest string"
RECORD_SCHEMA = "page_id long, uri string, record_type string, refers_to long, length long, digest string"


def record_id(page_id: int | None, digest: str, number: int) -> str:
    """A record's urn. ``number`` is that of the row, so that equal rows have records of their own."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{number}')}"


def header(page_id: int | None, uri: str | None, kind: str, refers_to: int | None, digest: str, length: int, full: int, rid: str) -> bytes:
    """The header block of a record. Control characters of a uri are percent-encoded."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else None
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{rid}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("X-Payload-Length", full),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", length),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def record_chunks(page_id: int | None, uri: str | None, payload: memoryview, kind: str, refers_to: int | None, digest: str, chunk: int, number: int = 0) -> Iterator[tuple]:
    """A record's chunks; a revisit has a header and no payload."""
    body = payload if kind == "response" else memoryview(b"")
    rid = record_id(page_id, digest, number)
    n = max(1, -(-len(body) // chunk))
    state = hashlib.sha1()
    for k in range(n):
        piece = body[k * chunk : (k + 1) * chunk]
        state.update(piece)
        front = header(page_id, uri, kind, refers_to, digest, len(body), len(payload), rid) if k == 0 else b""
        yield rid, k, n, b"".join([front, piece, _END if k == n - 1 else b""]), state.copy().hexdigest()


class RecordError(ValueError):
    """An archive whose chunks do not form whole records, or whose bytes do not have the digests stored with them."""


def read_records(chunks: Iterable[tuple[str, int, int, bytes, str]]) -> Iterator[dict]:
    """Records from chunk rows in order: header fields, with length and SHA-1 of the bytes read.

    The running digest is compared with the one stored in every chunk, and that of a
    whole response with the digest and the length in its header.
    """
    head: dict | None = None
    for rid, number, n, data, stored in chunks:
        view = memoryview(data)
        if number == 0:
            if head is not None:
                raise RecordError(f"{head['rid']} ends early")
            cut = data.index(_END) + 4
            lines = data[:cut].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise RecordError(f"{rid} has no WARC header")
            head = dict(x.split(": ", 1) for x in lines[1:] if x) | {"rid": rid, "next": 0, "left": None, "sha1": hashlib.sha1(), "length": 0}
            head["left"] = int(head["Content-Length"])
            view = view[cut:]
        if head is None or head["rid"] != rid or head["next"] != number:
            raise RecordError(f"chunk {number} of {rid} is out of order")
        body = view[: head["left"]]
        head["sha1"].update(body)
        head["length"] += len(body)
        head["left"] -= len(body)
        head["next"] += 1
        if head["sha1"].hexdigest() != stored:
            raise RecordError(f"chunk {number} of {rid} does not have its stored digest")
        if number == n - 1:
            if head["left"] or bytes(view[len(body) :]) != _END:
                raise RecordError(f"{rid} is cut short")
            named = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if head["WARC-Type"] == "response" and (head["sha1"].hexdigest() != named or head["length"] != int(head["X-Payload-Length"])):
                raise RecordError(f"{rid} does not have the payload its header names")
            yield head | {"digest": named}
            head = None
    if head is not None:
        raise RecordError(f"{head['rid']} ends early")


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload a larger page_id has as well.

    Payloads count as equal by SHA-1 and length, from ``least`` bytes on. Only ids,
    digests and lengths are shuffled. A hot digest is pre-aggregated, and its rows are
    dealt over ``SALTS`` tasks in the join with the few digests that several ids have.
    """
    p = pages.select("page_id", F.encode(text_or_empty("html"), "UTF-8").alias("b")).select("page_id", F.sha1("b").alias("digest"), F.octet_length("b").alias("n"))
    p = p.where((F.col("n") >= least) & F.col("page_id").isNotNull())
    last = p.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).where(F.col("first") < F.col("refers_to"))
    last = last.select("digest", "n", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return p.join(last, ["digest", "n", "salt"]).where(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def write_archive(pages: DataFrame, chunk: int = 64 << 10, least: int = 1000) -> DataFrame:
    """The archive of ``pages`` (page_id, url, html): its chunk table, written and read anew.

    Every row gives one record, repeated rows too: its id holds the row's number in the
    scan. Null html counts as empty; a null url has no WARC-Target-URI; a null page_id is
    a response of its own. Rows that repeat a page_id with the largest id of their
    payload are all responses. Columns other than the three are not read.
    """
    r = revisits(pages, least).withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(text_or_empty("html"), "UTF-8").alias("payload"), F.monotonically_increasing_id().alias("number")).withColumn("digest", F.sha1("payload"))
    rows = p.join(r, (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "payload", "digest", "refers_to", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "chunk_no", "n_chunks", "data", "digest"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            out, size = [], 0
            for page_id, url, payload, digest, ref, number in zip(*b.columns):
                ref = ref.as_py()
                for c in record_chunks(page_id.as_py(), url.as_py(), memoryview(payload.as_buffer()), "response" if ref is None else "revisit", ref, digest.as_py(), chunk, number.as_py()):
                    out.append(c)
                    size += len(c[3])
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return staged(map_arrow(rows, run, CHUNK_SCHEMA), "warc")


def read_archive(archive: DataFrame) -> DataFrame:
    """(page_id, uri, record_type, refers_to, length, digest) of every record, from its bytes.

    Records of one chunk are read where they lie. Chunks of larger ones are dealt by
    record and read in order, one chunk at a time. Length and digest are of the bytes
    read and are checked against those that were stored; a revisit has the digest of the
    payload it stands for, and no length of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for b in batches:
                for row in zip(*b.columns):
                    yield tuple(x.as_py() for x in row)

        def emit(rows):
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["page_id", "uri", "record_type", "refers_to", "length", "digest"])

        rows = []
        for h in read_records(chunks()):
            own = h["WARC-Type"] == "response"
            number = lambda k: int(h[k]) if k in h else None
            rows.append((number("X-Page-ID"), h.get("WARC-Target-URI"), h["WARC-Type"], number("X-Refers-To-Page-ID"), h["length"] if own else None, h["digest"]))
            if len(rows) >= 5000:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    cols = ["record_id", "chunk_no", "n_chunks", "data", "digest"]
    one = archive.where("n_chunks = 1").select(*cols)
    more = archive.where("n_chunks > 1").select(*cols).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return map_arrow(one, run, RECORD_SCHEMA).unionByName(map_arrow(more, run, RECORD_SCHEMA))


def resolved(records: DataFrame) -> DataFrame:
    """Give revisits the length of the response that they refer to.

    That response has the page_id in question and the digest that the revisit carries; a
    revisit without such a response is an error of the archive and keeps a null length.
    Responses that many refer to are dealt over ``SALTS`` tasks.
    """
    r = staged(records, "records")
    own, back = r.where("record_type = 'response'"), r.where("record_type = 'revisit'")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    asked = back.select(F.col("refers_to").alias("page_id"), "digest").distinct()
    target = own.join(asked, ["page_id", "digest"]).groupBy("page_id", "digest").agg(F.max("length").alias("_n")).select(F.col("page_id").alias("refers_to"), "digest", "_n", salts)
    back = back.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(target, ["refers_to", "digest", "salt"], "left")
    return own.unionByName(back.select("page_id", "uri", "record_type", "refers_to", F.col("_n").alias("length"), "digest"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = resolved(read_archive(write_archive(table(spark, sf_dir, "pages"))))
    return records.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT d, n, max(page_id) AS m FROM p GROUP BY 1, 2)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
FROM p JOIN m USING (d, n)
""",
}
