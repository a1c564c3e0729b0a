"""URL filters by a sorted array of 64-bit digests.

A rule is a host and a path prefix. The rule's text, host followed by path, is hashed
with XXH64; the sorted digests, the rule texts and their verdicts form one flat image
that workers map into memory. A url asks for the digests of its host's suffixes
combined with those prefixes of its path whose lengths occur among the rules; all
questions of a batch are answered by one vectorised binary search. Workers map the
image's file read-only, so all Python processes of a machine share its pages. A hit counts only
if the stored text equals the asked one, so colliding digests cannot decide a verdict.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import LOWER, UPPER, map_arrow, table

SEED = 42
#: Over so many tasks the urls that ask for one key are dealt in the join.
SALTS = 8
VERDICTS = ("block", "allow")
#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def image(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The flat file of a rule list: header, sorted keys, offsets, host lengths, verdicts, texts.

    Hosts are lower-cased. Of rules with equal host and path the last one holds. A path
    has to start with ``/`` or be empty.
    """
    last: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if path and path[0] != "/":
            raise ValueError(f"the path of a rule must start with /: {path!r}")
        last[host.translate(str.maketrans(UPPER, LOWER)), path] = verdict
    rows = sorted((xxhash.xxh64_intdigest((h + p).encode(), SEED), (h + p).encode(), len(h.encode()), VERDICTS.index(v)) for (h, p), v in last.items())
    n = len(rows)
    offsets = np.zeros(n + 1, np.uint64)
    offsets[1:] = np.cumsum([len(r[1]) for r in rows], dtype=np.uint64)
    parts = [np.array([r[0] for r in rows], np.uint64), offsets, np.array([r[2] for r in rows], np.uint32), np.array([r[3] for r in rows], np.uint8)]
    return b"".join([np.uint64(n).tobytes(), *(p.tobytes() for p in parts), *(r[1] for r in rows)])


class Rules:
    """A rule image, read through the buffer it lies in, as a rule a mapped file."""

    def __init__(self, buffer):
        n = int(np.frombuffer(buffer, np.uint64, 1)[0])
        at = 8
        self.keys = np.frombuffer(buffer, np.uint64, n, at)
        self.offsets = np.frombuffer(buffer, np.uint64, n + 1, at := at + 8 * n)
        self.host_bytes = np.frombuffer(buffer, np.uint32, n, at := at + 8 * (n + 1))
        self.verdicts = np.frombuffer(buffer, np.uint8, n, at := at + 4 * n)
        self.texts = memoryview(buffer)[at + n :]
        self.path_lengths = sorted({int(b) - int(a) - int(h) for a, b, h in zip(self.offsets[:-1], self.offsets[1:], self.host_bytes)}, reverse=True)

    @classmethod
    def open(cls, path: str) -> Rules:
        """Map an image file."""
        return cls(np.memmap(path, np.uint8, "r"))

    def text(self, i: int) -> bytes:
        return bytes(self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])])

    def questions(self, host: bytes, path: bytes) -> Iterator[tuple[bytes, int]]:
        """(host suffix + path prefix, bytes of the suffix) for all rules that could fit."""
        prefixes = [path[:n] for n in self.path_lengths if n <= len(path)]
        while host:
            for p in prefixes:
                yield host + p, len(host)
            cut = host.find(b".")
            host = host[cut + 1 :] if cut >= 0 else b""

    def longest(self, hosts: list[str], paths: list[str]) -> list[int]:
        """For each url the number of its longest fitting rule, or -1.

        Longest by host and path together; of equally long ones that with the longer host.
        """
        asked, of = [], []
        for k, (h, p) in enumerate(zip(hosts, paths)):
            q = list(self.questions(h.encode(), p.encode()))
            asked += q
            of += [k] * len(q)
        best = [(-1, -1, -1)] * len(hosts)
        if asked and len(self.keys):
            want = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t, _ in asked), np.uint64, len(asked))
            at = np.searchsorted(self.keys, want)
            for q in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)):
                i, (text, host_bytes) = int(at[q]), asked[q]
                while i < len(self.keys) and self.keys[i] == want[q]:  # digests that collide stand together
                    if int(self.host_bytes[i]) == host_bytes and self.text(i) == text:
                        best[of[q]] = max(best[of[q]], (len(text), host_bytes, i))
                    i += 1
        return [b[2] for b in best]


def parts(urls: DataFrame) -> DataFrame:
    """Add host and path of column ``url``, by built-in functions only.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: then up to ``?``, ``#`` or the end. Null or no ``://``: both empty.
    """
    u = F.col("url").cast("string")
    rest = F.when(F.instr(u, "://") > 0, F.expr("substring(cast(url as string), instr(cast(url as string), '://') + 3)")).otherwise(F.lit(""))
    return urls.select("*", rest.alias("_rest")).select(
        *urls.columns,
        F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


_mapped: dict[str, Rules] = {}


def ship_image(spark: SparkSession, data: bytes) -> str:
    """Hand an image to all executors as a file, once for each content; returns its name.

    Spark copies the driver's file to every executor, so the folders are not shared.
    """
    name = f"rules-{hashlib.sha256(data).hexdigest()[:32]}.img"
    sent = spark.sparkContext.__dict__.setdefault("_tracewell_images", set())
    if name not in sent:
        path = os.path.join(os.path.realpath(tempfile.mkdtemp()), name)
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
        sent.add(name)
    return name


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", max_image: int = 64 << 20) -> DataFrame:
    """(id column, host, path, rule, verdict) for every row of ``urls`` (first column, url).

    ``rule`` is host and path of the longest fitting rule, else null; ``verdict`` is the
    rule's, else ``default``. Null urls, and urls without ``://``, have an empty host
    and fit no rule. The rules are a driver-side list, in which a later rule replaces an
    earlier one of the same host and path. Their image is copied to every executor and
    must not exceed ``max_image`` bytes; for more rules ``judge_by_join`` gives the same
    result. Rows are neither merged nor moved, repeated rows are returned as often as
    they occur, other columns are not read, and an empty table gives no rows.
    """
    data = image(rules)
    if len(data) > max_image:
        raise ValueError("the rule image is over max_image; use judge_by_join")
    name = ship_image(urls.sparkSession, data)
    key = urls.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _mapped:
            _mapped.clear()
            _mapped[name] = Rules.open(SparkFiles.get(name))
        r = _mapped[name]
        for b in batches:
            found = r.longest(b.column(1).to_pylist(), b.column(2).to_pylist())
            rule = pa.array([r.text(i).decode() if i >= 0 else None for i in found], pa.string())
            verdict = pa.array([VERDICTS[r.verdicts[i]] if i >= 0 else default for i in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [key, "host", "path", "rule", "verdict"])

    split = parts(urls.select(key, "url")).select(F.col(key).cast("long").alias(key), "host", "path")
    return map_arrow(split, run, f"`{key}` long, host string, path string, rule string, verdict string")


def judge_by_join(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same result for any number of rules: ``rules`` (host, path, verdict, ordinal) is a table.

    Of rules with the same host and path that with the greatest ordinal holds, as the
    last one does in a list. Questions are made as in the image, with the path lengths of
    the rules (a set of small integers), joined on XXH64 keys and confirmed by the stored
    text. A key that many urls ask for is dealt over tasks by a salt.
    """
    key = urls.columns[0]
    r = rules.select(F.translate("host", UPPER, LOWER).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv"), "ordinal").groupBy("rh", "rp").agg(F.max_by("rv", F.struct("ordinal", "rv")).alias("rv"))
    lengths = r.select(F.array_sort(F.collect_set(F.length("rp"))).alias("lengths"))
    u = parts(urls.select(key, "url")).select(key, "host", "path").withColumn("_row", F.monotonically_increasing_id())
    asked = u.crossJoin(F.broadcast(lengths)).select(  # one row: the set of lengths
        "_row",
        F.explode(F.expr("transform(sequence(1, size(split(host, '\\\\.'))), i -> array_join(slice(split(host, '\\\\.'), i, size(split(host, '\\\\.'))), '.'))")).alias("qh"),
        "path", "lengths",
    ).select("_row", "qh", F.explode(F.expr("transform(filter(lengths, n -> n <= length(path)), n -> substring(path, 1, n))")).alias("qp"))
    salted = r.withColumn("rk", F.xxhash64(F.concat("rh", "rp"))).withColumn("rs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = (
        asked.where("qh <> ''").withColumn("k", F.xxhash64(F.concat("qh", "qp"))).withColumn("ks", F.pmod("_row", F.lit(SALTS)).cast("int"))
        .join(salted, (F.col("k") == F.col("rk")) & (F.col("ks") == F.col("rs")))
        .where((F.col("qh") == F.col("rh")) & (F.col("qp") == F.col("rp")))
        .groupBy("_row")
        .agg(F.max_by(F.struct("rh", "rp", "rv"), F.struct(F.octet_length(F.concat("rh", "rp")), F.octet_length("rh"))).alias("hit"))
    )
    return u.join(hits, "_row", "left").select(key, "host", "path", F.concat("hit.rh", "hit.rp").alias("rule"), F.coalesce("hit.rv", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def _sql_rules() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"(VALUES {rows}) r(rh, rp, rv)"


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE_SQL = {
    "op5_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT p.page_id, p.host, p.path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(rv, length(rh || rp)), 'allow') AS verdict
FROM p LEFT JOIN {_sql_rules()} ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
GROUP BY p.page_id, p.host, p.path
""",
}
