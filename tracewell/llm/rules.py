"""Quality rules as weak supervision: rules vote or abstain, EM learns how far each is to be trusted.

No rule decides alone. Each looks at one side of a text and says good, bad or nothing. A
document is good or bad, which nobody sees; given that, votes are taken as independent,
and expectation-maximisation finds how often each rule says what of good and of bad
documents. What a document's votes then make of it is the probability that it is good.

Votes have few distinct combinations, so EM runs on the counts of those, never on
documents; a round is one small aggregate that gives back one row. Only DataFrame and
SQL functions are used throughout.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import staged, table, text_or_empty
from tracewell.llm.spans import literal

#: What separates words, as characters and as a regex.
_SPACE = " \\t\\n\\u000b\\u000c\\r"
_WORD = "[^\\x20\\x09-\\x0D]"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: name: (bad if, good if), SQL on the features; neither means that the rule abstains. Bounds are the usual ones of web-text filters.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", None),
    "letters": ("n_letters < 0.7 * word_chars", "n_letters >= 0.9 * word_chars"),
    "capitals": ("n_capitals > 0.4 * n_letters", None),
    "shouts": ("n_shouts > 0.1 * n_words", None),
    "repeats": ("n_repeat_words > 0.2 * n_words", None),
    "lines": ("n_dup_lines > 0.3 * n_lines", None),
    "vocabulary": ("n_distinct < 0.1 * n_words AND n_words < 10000", "n_distinct >= 0.3 * n_words"),
    "line_ends": ("n_ended_lines < 0.1 * n_lines", "n_ended_lines >= 0.6 * n_lines"),
    "sentences": ("n_enders * 200 < n_words", "n_enders * 5 <= n_words AND n_enders * 60 >= n_words"),
    "bullets": ("n_bullets > 0.9 * n_lines", None),
}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, what the rules count in the text), one row for each row of ``docs``.

    A null text counts as empty, a null doc_id stays. Texts of less than three words have
    no windows. Other columns are not read, whatever their names.
    """
    df = docs.select("doc_id", text_or_empty().alias("t"))
    df = df.select("doc_id", "t", F.expr(f"filter(split(t, '\\n', -1), x -> x RLIKE {literal(_WORD)})").alias("rows"), F.expr(f"split(trim(BOTH '{_SPACE}' FROM t), '[\\\\x20\\\\x09-\\\\x0D]+', -1)").alias("w0"))
    df = df.select("*", F.expr("array_remove(w0, '')").alias("w")).drop("w0")
    # a window's hash is cheap, and texts without equal hashes, most of them, have no equal windows
    df = df.select("*", F.expr("CASE WHEN size(w) > 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE cast(array() AS array<bigint>) END").alias("h"))
    df = df.select("*", F.expr("size(array_distinct(h)) < size(h)").alias("again"))
    equal = "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)))"
    df = df.select("*", F.expr(f"CASE WHEN again THEN {equal} ELSE cast(array() AS array<struct<g: string, i: int>>) END").alias("s"))
    found = "sort_array(transform(filter(sequence(0, size(s) - 1), j -> (j > 0 AND s[j].g = s[greatest(j - 1, 0)].g) OR (j < size(s) - 1 AND s[j].g = s[least(j + 1, size(s) - 1)].g)), j -> s[j].i))"
    df = df.select("*", F.expr(f"CASE WHEN again THEN {found} ELSE cast(array() AS array<int>) END").alias("p"))
    chars = {"word_chars": f"length(translate(t, '{_SPACE}', ''))", "n_symbols": f"length(t) - length(translate(t, '{SYMBOLS}', ''))", "n_letters": "length(regexp_replace(t, '\\\\P{L}+', ''))", "n_capitals": "length(regexp_replace(t, '\\\\P{Lu}+', ''))", "n_shouts": "length(t) - length(translate(t, '!', ''))", "n_enders": "length(t) - length(translate(t, '.!?', ''))"}
    counts = {
        "n_words": "size(w)",
        **chars,
        "n_lines": "size(rows)",
        "n_dup_lines": "size(rows) - size(array_distinct(rows))",
        # a repeated window adds those of its three words that the one before did not hold
        "n_repeat_words": "CASE WHEN size(p) = 0 THEN 0 ELSE aggregate(slice(p, 2, size(p)), named_struct('n', 3, 'at', p[0]), (a, x) -> named_struct('n', a.n + least(3, x - a.at), 'at', x), a -> a.n) END",
        "n_distinct": "size(array_distinct(w))",
        "n_ended_lines": "size(filter(rows, x -> x RLIKE '[.!?:;\"\\u2026\\u201d\\u00bb][\\\\x20\\\\x09-\\\\x0D]*$'))",
        "n_bullets": "size(filter(rows, x -> x RLIKE '^[\\\\x20\\\\x09]*[-*\\u2022\\u2013]'))",
    }
    return df.select("doc_id", F.xxhash64("t").alias("text_hash"), *[F.expr(e).cast("long").alias(n) for n, e in counts.items()])


def base_failed() -> Column:
    """Whether a document fails before any vote: under 50 words, or more than half of them in repeated windows."""
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def votes(counted: DataFrame) -> DataFrame:
    """The counts with each rule's vote: 1 good, -1 bad, 0 abstains. Give staged counts, or each bound counts the texts anew."""
    return counted.select("*", *[F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good or 'false'} THEN 1 ELSE 0 END").cast("byte").alias(f"v_{name}") for name, (bad, good) in RULES.items()])


class Trust(NamedTuple):
    """How often rules say what: of each rule the probabilities of a bad and a good vote, given a bad and a good document."""

    good: float
    bad_votes: dict[str, tuple[float, float]]
    good_votes: dict[str, tuple[float, float]]

    def accuracy(self, rule: str) -> float | None:
        """How often the rule's votes are right, or None if it never votes."""
        right = (1 - self.good) * self.bad_votes[rule][0] + self.good * self.good_votes[rule][1]
        wrong = self.good * self.bad_votes[rule][1] + (1 - self.good) * self.good_votes[rule][0]
        return right / (right + wrong) if right + wrong > 0 else None


#: Where EM begins: most documents are good, bad votes are rare on good ones.
def _start() -> Trust:
    return Trust(0.8, {r: (0.3, 0.03) for r in RULES}, {r: (0.3, 0.6) for r in RULES})


def posterior(trust: Trust) -> Column:
    """The probability that a document is good, from its votes. That a rule abstains says nothing: no document is given up for want of praise."""
    weight = F.lit(math.log(trust.good / (1 - trust.good)))
    for r in RULES:
        (bb, bg), (gb, gg) = trust.bad_votes[r], trust.good_votes[r]
        weight = weight + F.when(F.col(f"v_{r}") < 0, math.log(bg / bb)).when(F.col(f"v_{r}") > 0, math.log(gg / gb)).otherwise(0.0)
    return 1 / (1 + F.exp(-weight))


def fit(voted: DataFrame, rounds: int = 40) -> Trust:
    """EM on the votes of all documents that pass the base rules, each distinct text once.

    So a group of copies, however large, weighs as one text. A rule keeps its meaning: if
    its votes would speak against what they say, they count as saying nothing. One
    imagined good and bad document each say everything, which keeps probabilities off 0
    and 1. Sums are rounded, so that their order does not matter. Without documents the
    start values stay.
    """
    names = [f"v_{r}" for r in RULES]
    patterns = staged(voted.where(~base_failed()).groupBy("text_hash", *names).agg(F.lit(1).alias("one")).groupBy(*names).agg(F.count("*").alias("n")), "votes")
    trust = _start()
    for _ in range(rounds):
        with_p = patterns.select("n", *names, posterior(trust).alias("p"))
        sums = [F.round(F.sum(F.col("n") * c), 3).alias(k) for k, c in (("good", F.col("p")), ("bad", 1 - F.col("p")))]
        for r in RULES:
            for sign, kind in ((-1, "bad"), (1, "good")):
                said = F.when(F.col(f"v_{r}") == sign, F.col("n")).otherwise(0)
                sums += [F.round(F.sum(said * (1 - F.col("p"))), 3).alias(f"{r}_{kind}_b"), F.round(F.sum(said * F.col("p")), 3).alias(f"{r}_{kind}_g")]
        s = with_p.agg(*sums).first()
        if s["good"] is None:
            return trust
        good, bad = s["good"], s["bad"]
        bad_votes, good_votes = {}, {}
        for r in RULES:
            pair = [((s[f"{r}_{kind}_b"] + 1) / (bad + 3), (s[f"{r}_{kind}_g"] + 1) / (good + 3)) for kind in ("bad", "good")]
            pooled = [(s[f"{r}_{kind}_b"] + s[f"{r}_{kind}_g"] + 2) / (good + bad + 6) for kind in ("bad", "good")]
            bad_votes[r] = pair[0] if pair[0][0] >= pair[0][1] else (pooled[0], pooled[0])
            good_votes[r] = pair[1] if pair[1][1] >= pair[1][0] else (pooled[1], pooled[1])
        new = Trust((good + 1) / (good + bad + 2), bad_votes, good_votes)
        moved = max(abs(new.good - trust.good), *(abs(a - b) for r in RULES for x, y in ((new.bad_votes, trust.bad_votes), (new.good_votes, trust.good_votes)) for a, b in zip(x[r], y[r])))
        trust = new
        if moved < 1e-5:
            break
    return trust


def judged(docs: DataFrame, trust: Trust | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, counts, votes, base_failed, p_good, kept) of every row of ``docs`` (doc_id, text).

    Documents that fail the base rules are not kept; the others are if they are good with
    probability ``least`` or more. ``trust`` is learned from ``docs`` if not given.
    """
    voted = votes(staged(features(docs), "features"))
    trust = trust or fit(voted)
    return voted.drop("text_hash").select("*", base_failed().alias("base_failed"), posterior(trust).alias("p_good")).select("*", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op11_quality_rules": op11_quality_rules}
ORACLE_SQL: dict[str, str] = {}
