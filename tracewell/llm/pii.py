"""Personal data by patterns, checksums and context, with built-in functions only.

Patterns propose spans, checksums confirm them (Luhn for card numbers, mod 97 for bank
accounts), and words near a span move its score. The fixed kinds (email, ip, card,
phone) are always reported; the method adds bank accounts and shorter card numbers
whose score reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table, text_or_empty
from tracewell.llm.secrets import joined
from tracewell.llm.spans import with_matches

KINDS = ("email", "ip", "card", "phone", "iban", "card_short")
#: Fixed by the standard: the length of an account number (IBAN) in each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Written so that no search retraces a long run: a match may start where no run is cut
#: in two, or right after the match before it, and repeated groups are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    "card_short": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
}
#: Score before context, and context words that support a kind.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.6, "card_short": 0.3}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|master|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account|konto|transfer", "card_short": "card|visa|amex|credit|debit|payment",
}
AGAINST = "order|invoice|ticket|version|serial|part no|item"
THRESHOLD = 0.6
NEAR = 40


def luhn(number: str) -> str:
    """SQL: whether a string of digits, spaces and hyphens passes the Luhn check."""
    d = f"reverse(regexp_replace({number}, '[^0-9]', ''))"
    return f"aggregate(split({d}, ''), named_struct('s', 0, 'i', 0), (a, c) -> named_struct('s', a.s + CASE WHEN a.i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END, 'i', a.i + 1), a -> a.s % 10 = 0)"


def mod97(account: str) -> str:
    """SQL: whether an account number in IBAN form leaves 1 modulo 97."""
    s = f"replace({account}, ' ', '')"
    turned = f"concat(substring({s}, 5), substring({s}, 1, 4))"
    return f"aggregate(split({turned}, ''), 0, (a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END, a -> a = 1)"


def _digits(m: str) -> str:
    return f"length(regexp_replace({m}, '[^0-9]', ''))"


#: Which matches of a pattern count.
CHECKS = {
    "email": "true",
    "ip": r"forall(split(m.text, '\\.'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', right(p, 3))) <= 255)",
    "card": luhn("m.text"),
    "phone": f"{_digits('m.text')} BETWEEN 8 AND 15",
    "iban": mod97("m.text"),
    "card_short": luhn("m.text"),
}


def scan(docs: DataFrame) -> DataFrame:
    """Add to ``docs`` (doc_id, text, ...) the column ``pii``: spans of personal data.

    ``pii`` is an array of (kind, start, stop, score), by kind as listed in KINDS and
    then start; places are code points, stop exclusive. An account number has the length
    of its country, so what follows it is no part of it. A span of an added kind that
    overlaps a span of a fixed kind is left out. Null or empty texts have no spans;
    every row and column of ``docs`` is kept, and a column named ``pii`` is replaced.
    """
    names = [c for c in docs.columns if c != "pii"]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text_or_empty().alias("_text"))
    df = with_matches(df, "_text", PATTERNS)

    def scored(kind: str, rank: int) -> str:
        near = f"lower(concat(substring(_text, greatest(m.start - {NEAR}, 0) + 1, m.start - greatest(m.start - {NEAR}, 0)), ' ', substring(_text, m.stop + 1, {NEAR})))"
        lift = f"CASE WHEN {near} RLIKE '(^|[^a-z])({CONTEXT[kind]})' THEN 0.4D ELSE 0D END - CASE WHEN {near} RLIKE '(^|[^a-z])({AGAINST})' THEN 0.3D ELSE 0D END"
        return f"transform(filter({kind}, m -> {CHECKS[kind]}), m -> named_struct('rank', {rank}, 'start', m.start, 'stop', m.stop, 'score', least(1D, greatest(0D, {PRIOR[kind]}D + {lift}))))"

    fixed = "concat(" + ", ".join(scored(k, i) for i, k in enumerate(KINDS[:4])) + ")"
    added = "filter(concat(" + ", ".join(scored(k, i + 4) for i, k in enumerate(KINDS[4:])) + f"), m -> m.score >= {THRESHOLD})"
    df = df.select("_row", F.expr(fixed).alias("_fixed"), F.expr(added).alias("_added"))
    every = "array_sort(concat(_fixed, filter(_added, x -> NOT exists(_fixed, f -> f.start < x.stop AND x.start < f.stop))))"
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    spans = f"transform({every}, s -> named_struct('kind', {kinds}[s.rank], 'start', s.start, 'stop', s.stop, 'score', s.score))"
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], F.expr(spans).alias("pii"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = "filter(pii, s -> s.kind IN ('email', 'ip', 'card', 'phone'))"
    return df.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined("pii").alias("spans"),
    )


QUERIES = {"op9_pii": op9_pii}
ORACLE_SQL: dict[str, str] = {}
