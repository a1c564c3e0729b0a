"""Phrase collocations by position bitmaps, in the manner of SPAM.

A shard is a run of text of bounded size in one language. For every word it has a bitmap
of the positions where the word stands, compressed to the bytes that are not zero. A
bitmap shifted by one position and ANDed with a word's gives the positions where the
longer phrase ends, and its popcount is how often the phrase occurs. Phrases are
extended depth-first, many at a time; a position without a word lies between pieces, so
no phrase crosses one. A phrase's count is the sum over all shards.

Whether a phrase is frequent is only known over all shards. So there is one pass for
each length: it walks down through the phrases known as frequent and gives the counts of
those one word longer. What is known as frequent goes to the tasks as a bit array of
fixed size; a wrong bit in it costs work, never a result, as counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import map_arrow, staged, table, text_or_empty

#: Bits of the array that tells tasks which phrases are frequent. 2 MB; at far larger inputs raise it, or more infrequent phrases are counted.
FILTER_BITS = 24
#: Bytes of all the shards that a task has open. More means fewer, larger counts to add up, and more memory.
SHARD_BYTES = 6 << 20
#: Bytes of bitmaps that are extended at a time.
_ENTRIES = 1 << 16
#: What stands for the end of a piece, which no word has.
_END = b"\n"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shards(rows: Iterator[tuple[str, bytes]], context: int, size: int = SHARD_BYTES) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(language, words, ids): the words of a shard, and the number of the word at each position.

    Positions 0 to 7 hold what came before the shard, for phrases that begin there: the
    last ``context`` words if a text goes on from one shard to the next. Number 0 is no
    word. What a task has open, in all languages together, is ``size`` bytes and one
    word, however long a text is.
    """
    open_: dict[str, list[bytes]] = {}
    before: dict[str, list[bytes]] = {}
    total = 0

    def flush() -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        for lang, parts in open_.items():
            yield lang, *_numbered(before.get(lang, []), b"".join(parts))
        open_.clear()
        before.clear()

    for lang, raw in rows:
        at = 0
        while at < len(raw):
            stop = min(len(raw), at + max(1, size - total))
            if stop < len(raw):
                # where a word ends; a word that is longer than what is left is taken whole
                stop = max(raw.rfind(b" ", at, stop), raw.rfind(b"\n", at, stop)) + 1
                if stop <= at:
                    ends = [x for x in (raw.find(b" ", at), raw.find(b"\n", at)) if x >= 0]
                    stop = min(ends) + 1 if ends else len(raw)
            part = raw[at:stop].translate(_TABLE)
            open_.setdefault(lang, []).append(part if stop < len(raw) else part + _END)
            total += stop - at
            at = stop
            if total >= size:
                last = []
                if at < len(raw) and context:
                    # long enough for the last words, if words are of usual length; otherwise all
                    tail = b"".join(open_[lang])
                    last = _tokens(tail[-4096:])[-context:] if tail.rfind(b" ", 0, -4096) >= 0 and len(_tokens(tail[-4096:])) > context else _tokens(tail)[-context:]
                    last = before.get(lang, [])[len(last) :] + last if len(last) < context else last
                yield from flush()
                total = 0
                if last:
                    before[lang] = last[-context:]
    yield from flush()


def _tokens(data: bytes) -> list[bytes]:
    """Words, and _END between pieces."""
    return data.replace(_END, b" \n ").replace(b"  ", b" ").strip(b" ").split(b" ")


def _numbered(before: list[bytes], data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, number 0 none, and the word's number at each position."""
    data = b" ".join([b"\n"] * (8 - len(before)) + before + [data.replace(_END, b" \n ")])
    whole = pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
    found = pc.split_pattern(whole, b" ").flatten().dictionary_encode()
    words, ids = found.dictionary, found.indices.to_numpy()
    # the first position holds the end of a piece, so that is number 0; spaces in a row leave empty words
    empty = pc.index(words, pa.scalar(b"", words.type)).as_py()
    return words, ids[ids != empty] if empty >= 0 else ids


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word in its language."""
    digest, seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = memoryview(words.buffers()[2])
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(ends, ends[1:])), np.uint64, len(words))


def phrase_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of each phrase from the hashes of its words, given word by word."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for w in hashes:
        h = (h ^ w) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def known(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in the array."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class Bitmaps:
    """The position bitmaps of a shard's words, by word and by byte of the positions.

    Both are lists of (byte number, word, bits). Sorted by word they are the bitmaps;
    sorted by byte they tell which words' bitmaps have bits where a given one has.
    """

    def __init__(self, ids: np.ndarray, allowed: np.ndarray):
        self.n_words = len(allowed)
        pos = np.flatnonzero(allowed[ids])
        key = (pos >> 3) * self.n_words + ids[pos]
        key, bits = _merged(key, np.left_shift(1, pos & 7).astype(np.uint8))
        self.block, self.word, self.bits = key // self.n_words, key % self.n_words, bits
        self.start = np.searchsorted(self.block, np.arange((len(ids) >> 3) + 3))
        self.by_word = np.argsort(self.word, kind="stable")

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, which word, byte, bits) of the words that occur."""
        w = self.word[self.by_word]
        words, which = np.unique(w, return_inverse=True)
        return words[:, None], which, self.block[self.by_word], self.bits[self.by_word]

    def extended(self, which: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase * n_words + word, byte, bits): the bitmaps shifted by one position, ANDed with those of all words, where not zero."""
        low, high = bits << np.uint8(1), bits >> np.uint8(7)
        a, b = np.flatnonzero(low), np.flatnonzero(high)
        which, block, bits = np.concatenate([which[a], which[b]]), np.concatenate([block[a], block[b] + 1]), np.concatenate([low[a], high[b]])
        begin = self.start[block]
        count = self.start[block + 1] - begin
        total = int(count.sum())
        of = np.repeat(np.arange(len(which)), count)
        at = np.arange(total) + np.repeat(begin - (np.cumsum(count) - count), count)
        both = bits[of] & self.bits[at]
        hit = np.flatnonzero(both)
        of = of[hit]
        return which[of] * self.n_words + self.word[at[hit]], block[of], both[hit]


def _merged(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys ascending, each once, with the OR of their bits."""
    if not len(key):
        return key, bits
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.bitwise_or.reduceat(bits[order], first)


def phrase_counts(maps: Bitmaps, hashes: np.ndarray, length: int, filters: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of word numbers, counts) of ``length`` words whose parts are all known as frequent.

    The bits of byte 0 are those of the words before the shard: phrases may begin there
    and are counted where they end.
    """
    yield from _walk(maps, hashes, length, filters, *maps.words())


def _walk(maps: Bitmaps, hashes: np.ndarray, length: int, filters: dict[int, np.ndarray], phrases: np.ndarray, which: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of phrases that extend the given ones.

    Not a function within phrase_counts: one that calls itself refers to itself, and would
    keep the bitmaps of shards that are done until Python looks for cycles.
    """
    begin = np.searchsorted(which, np.arange(len(phrases) + 1))
    lo = 0
    while lo < len(phrases):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + _ENTRIES, "right")) - 1)
        part = slice(begin[lo], begin[hi])
        key, blk, both = maps.extended(which[part] - lo, block[part], bits[part])
        some, k = phrases[lo:hi], phrases.shape[1] + 1
        lo = hi
        if k == length:
            own = blk > 0
            key, both = key[own], both[own]
            if not len(key):
                continue
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.add.reduceat(np.bitwise_count(both[order]).astype(np.int64), first)
            key = key[first]
        else:
            n_blocks = len(maps.start)
            key, both = _merged(key * n_blocks + blk, both)
            key, blk = key // n_blocks, key % n_blocks
            key, of = np.unique(key, return_inverse=True)
        child = np.column_stack([some[key // maps.n_words], key % maps.n_words])
        ok = np.ones(len(child), bool)
        # the last words are a phrase as well; that the first ones are frequent is known
        if k > 2:
            ok &= known(filters[k - 1], phrase_hashes([hashes[child[:, i]] for i in range(1, k)]))
        if k == length:
            yield child[ok], n[ok]
            continue
        ok &= known(filters[k], phrase_hashes([hashes[child[:, i]] for i in range(k)]))
        keep = ok[of]
        yield from _walk(maps, hashes, length, filters, child[ok], (np.cumsum(ok) - 1)[of[keep]], blk[keep], both[keep])


def counted(docs: DataFrame, length: int, filters: dict[int, np.ndarray]) -> DataFrame:
    """(lang, phrase, a): phrases of ``length`` words, not yet summed up, leaving out those with a part that is not frequent.

    Of length 1 there is one more row for each shard, with a null phrase and the number of its words.
    """
    told = docs.sparkSession.sparkContext.broadcast(filters)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            langs = b.column(0)
            for k, raw in enumerate(b.column(1)):
                yield langs[k].as_py(), raw.as_py()

    def rows(lang: str, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(n)), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in shards(texts(batches), length - 1):
            names = words.cast(pa.large_string()).cast(pa.string())
            if length == 1:
                n = np.bincount(ids[8:], minlength=len(words))[1:]
                yield rows(lang, names.slice(1), n)
                yield rows(lang, pa.nulls(1, pa.string()), n.sum(keepdims=True))
                continue
            hashes = word_hashes(lang, words)
            allowed = known(told.value[1], phrase_hashes([hashes]))
            allowed[0] = False
            for phrases, n in phrase_counts(Bitmaps(ids, allowed), hashes, length, told.value):
                if len(n):
                    yield rows(lang, pc.binary_join_element_wise(*[names.take(pa.array(phrases[:, k])) for k in range(length)], " "), n)

    narrow = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))
    return map_arrow(narrow, run, "lang string, phrase string, a long")


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The bit array of the phrases (lang, phrase): 2^FILTER_BITS bits as 64-bit words, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits: dict[int, int] = {}
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = phrase_hashes([h[None] for h in word_hashes(lang, pa.array(phrase.encode("utf-8", "surrogatepass").split(b" "), pa.large_binary()))])
                at = int(h[0]) >> (64 - FILTER_BITS)
                bits[at >> 6] = bits.get(at >> 6, 0) | 1 << (at & 63)
            cells = np.fromiter(bits.values(), np.uint64, len(bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array(cells)], ["cell", "bits"])

    cells = map_arrow(frequent.select("lang", "phrase"), run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = 30, max_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of up to ``max_words`` words that occur ``least`` times or more, and (lang, n), the number of words.

    A null text has no words and a null language is ``und``; repeated rows count each
    time. Columns other than lang and text are not read. No rows give no phrases.
    """
    filters: dict[int, np.ndarray] = {}
    levels: list[DataFrame] = []
    for k in range(1, max_words + 1):
        sums = counted(docs, k, filters).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        levels.append(staged(sums.where((F.col("a") >= least) | F.col("phrase").isNull()), f"phrases-{k}"))
        if k < max_words:
            filters[k] = filter_of(levels[-1].where("phrase IS NOT NULL"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.where("phrase IS NOT NULL"), levels[0].where("phrase IS NULL").select("lang", F.col("a").alias("n"))


def collocations(docs: DataFrame, least: int = 30, max_words: int = 4, top: int = 2000) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate of 2 to ``max_words`` words is cut into two parts where that gives the
    least floor(2000000 * a / (l + r)), its score; the first of equal cuts counts.
    Candidates that lie in a longer candidate with 80 % or more of their count are left
    out. Order: score and count descending, phrase ascending by bytes.
    """
    every, totals = frequent_phrases(docs, least, max_words)
    many = every.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    cuts = many.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(w) - 1), k -> named_struct('k', k, 'first', array_join(slice(w, 1, k), ' '), 'rest', array_join(slice(w, k + 1, size(w)), ' ')))")).alias("c")).select("lang", "phrase", "a", "c.*")
    first = every.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rest = every.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.expr("(cast(a AS decimal(20, 0)) * cast(2000000 AS decimal(7, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    if max_words > 2:
        inner = many.where("size(w) > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
        covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        best = best.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 80 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrases": op13_phrases}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "op13_phrases": f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, len(g) AS m, array_to_string(g, ' ') AS phrase
  FROM (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS g FROM pieces)
), f AS (
  SELECT lang, m, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)
), best AS (
  SELECT u.lang, u.phrase, u.a, min({{'score': u.a::HUGEINT * 2000000 // (x.a + y.a), 'k': k, 'l': x.a, 'r': y.a}}) AS s
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.first JOIN f y ON y.lang = u.lang AND y.phrase = u.rest GROUP BY ALL
), inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(unnest(flatten(list_transform(range(2, len(w)), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))), ' ') AS phrase FROM c WHERE len(w) > 2)
  GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * best.a
)
SELECT lang, rank, phrase, a, s.l, s.r, n, s.score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, phrase) AS rank FROM kept)
JOIN (SELECT lang, count(*)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang) USING (lang)
WHERE rank <= 2000
"""
}
