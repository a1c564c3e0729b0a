"""Secret scans by a battery of randomness tests, with built-in functions only.

Besides the fixed kinds (assignments, access keys, hex strings), tokens that look like
the output of a random generator are reported. A token's encoding is inferred, and
three tests of the hypothesis "every symbol of the encoding is equally likely" are
made on its symbols: chi-squared over the alphabet in equal cells, the number of runs
above and below the middle, and the serial correlation of neighbours. The last two
measure nearly the same thing, so Brown's form of Fisher's method joins the three to
one p-value, which is close to uniform for random tokens and near 0 for words.

Which p-values count as random depends on the length: short words can pass the tests.
For every encoding and band of lengths the corpus tells how many tokens pass at a
level. Random tokens are uniform, so twice the count above one half estimates them;
what a level lets through beyond their share is false. The lowest level is taken at
which the share of false discoveries is not shown to be above ``rate``: the excess may
be up to ``SIGMAS`` times what chance gives among so few tokens. With many tokens that
is the rate itself; with a handful, random tokens are still reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import staged, table, text_or_empty
from tracewell.llm.spans import literal, with_matches

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
#: A maximal run of A-Z0-9 after AKIA is kept at 16 characters; a hex run at 32.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "token": "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"}

#: Encodings: name, pattern of the whole token, alphabet. The first that fits is inferred.
ENCODINGS = [
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
]
#: Covariance of -2 ln p of the runs test and of the serial correlation, for random tokens of 20 to 128 symbols (1.8 to 2.2 by simulation).
COVARIANCE = 2.0
SIGMAS = 2.0
#: Lower ends of the bands of lengths.
BANDS = (20, 24, 32, 48, 64, 128)


def _normal_tail(z: str) -> str:
    """SQL: two-sided tail of the normal distribution, by a logistic fit (error below 2e-4)."""
    return f"2.0 / (1.0 + exp(0.07056 * pow(abs({z}), 3) + 1.5976 * abs({z})))"


def _battery(tokens: str) -> str:
    """SQL: tokens (start, stop, text) to (d, start, stop, enc, n, p), d a digest; tokens of no encoding drop out.

    A token of letters of one case, perhaps with a capital, has a probability under any
    listed encoding below one in a million at 20 characters; it is a word, not a secret.
    """
    enc = "CASE " + " ".join(f"WHEN t.text RLIKE '{p}' THEN '{n}'" for n, p, _ in ENCODINGS) + " END"
    alpha = "CASE x.enc " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, _, a in ENCODINGS) + " END"
    inferred = f"filter(transform(filter({tokens}, t -> NOT t.text RLIKE '^[A-Za-z]?[a-z]+$'), t -> named_struct('d', xxhash64(t.text), 'start', t.start, 'stop', t.stop, 'enc', {enc}, 's', rtrim('=', t.text))), x -> x.enc IS NOT NULL AND length(x.s) >= {BANDS[0]})"
    symbols = f"transform({inferred}, x -> named_struct('d', x.d, 'start', x.start, 'stop', x.stop, 'enc', x.enc, 'k', length({alpha}), 'v', transform(split(CASE WHEN x.enc = 'hex' THEN lower(x.s) ELSE x.s END, ''), c -> instr({alpha}, c) - 1)))"
    symbols = f"transform({symbols}, x -> named_struct('d', x.d, 'start', x.start, 'stop', x.stop, 'enc', x.enc, 'k', x.k, 'n', size(x.v), 'g', least(x.k, greatest(2, size(x.v) div 5)), 'v', x.v))"
    # chi-squared by Wilson and Hilferty's cube root; runs about the middle; lag-1 correlation
    cells = "transform(sequence(0, x.g - 1), c -> size(filter(x.v, s -> s * x.g div x.k = c)))"
    width = "(size(filter(sequence(0, x.k - 1), s -> s * x.g div x.k = c)) * double(x.n) / x.k)"
    chi = f"aggregate(zip_with({cells}, sequence(0, x.g - 1), (o, c) -> pow(o - {width}, 2) / {width}), 0D, (a, y) -> a + y)"
    stats = f"transform({symbols}, x -> named_struct('d', x.d, 'start', x.start, 'stop', x.stop, 'enc', x.enc, 'n', x.n, 'df', x.g - 1, 'chi', {chi}, 'runs', aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1), (a, b) -> int((2 * a >= x.k) <> (2 * b >= x.k))), 1, (a, y) -> a + y), 'mean', aggregate(x.v, 0D, (a, y) -> a + y) / x.n, 'sq', aggregate(x.v, 0D, (a, y) -> a + y * y) / x.n, 'lag', aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1), (a, b) -> double(a) * b), 0D, (a, y) -> a + y) / (x.n - 1)))"
    z_chi = "((pow(x.chi / x.df, 1.0 / 3) - (1 - 2.0 / (9 * x.df))) / sqrt(2.0 / (9 * x.df)))"
    p_chi = f"CASE WHEN {z_chi} > 0 THEN ({_normal_tail(z_chi)}) / 2 ELSE 1 - ({_normal_tail(z_chi)}) / 2 END"
    p_runs = _normal_tail("((x.runs - 1 - (x.n - 1) / 2.0) / sqrt((x.n - 1) / 4.0))")
    p_lag = _normal_tail("((x.lag - x.mean * x.mean) / greatest(x.sq - x.mean * x.mean, 1e-9) * sqrt(x.n - 1))")
    log_sum = f"-ln(greatest({p_chi}, 1e-30)) - ln(greatest({p_runs}, 1e-30)) - ln(greatest({p_lag}, 1e-30))"
    half = f"transform({stats}, x -> named_struct('d', x.d, 'start', x.start, 'stop', x.stop, 'enc', x.enc, 'n', x.n, 'h', {log_sum}))"
    # twice h has mean 6 and variance 12 + 2 COVARIANCE: a scaled chi-squared, again by the cube root
    df = 72 / (12 + 2 * COVARIANCE)
    z = f"((pow(x.h / 3, 1.0 / 3) - {1 - 2 / (9 * df)}D) / {(2 / (9 * df)) ** 0.5}D)"
    p = f"CASE WHEN {z} > 0 THEN ({_normal_tail(z)}) / 2 ELSE 1 - ({_normal_tail(z)}) / 2 END"
    return f"transform({half}, x -> named_struct('d', x.d, 'start', x.start, 'stop', x.stop, 'enc', x.enc, 'n', x.n, 'p', {p}))"


def _band(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {b} THEN {b}" for b in reversed(BANDS)) + f" ELSE {BANDS[0]} END"


def _prepared(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(_row, _fixed, _tokens): columns ``keep`` of each row as a struct, its fixed spans, and its tokens with p-values."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), text_or_empty().alias("_text"))
    df = with_matches(df, "_text", PATTERNS)
    group2 = f"regexp_extract(m.text, {literal(ASSIGN)}, 2)"
    fixed = "concat(" + ", ".join(
        f"transform({src}, m -> named_struct('start', m.start, 'rank', {i}, 'stop', m.stop, 'score', 1D))"
        for i, src in enumerate([f"filter(assign, m -> length({group2}) >= 8)", "access", "hex"])
    ) + ")"
    return df.select("_row", F.expr(fixed).alias("_fixed"), F.expr(_battery("token")).alias("_tokens"))


def _levels(prepared: DataFrame, rate: float) -> dict[tuple[str, int], float]:
    cells = (
        prepared.where("size(_tokens) > 0").select(F.explode("_tokens").alias("x"))
        .select(F.col("x.d").alias("digest"), F.col("x.enc").alias("enc"), F.expr(_band("x.n")).alias("band"), F.expr("least(int(x.p * 50), 49)").alias("cell"))
        .distinct()
        .groupBy("enc", "band", "cell")
        .count()
        .collect()
    )
    hist: dict[tuple[str, int], list[int]] = {}
    for r in cells:
        hist.setdefault((r["enc"], r["band"]), [0] * 50)[r["cell"]] += r["count"]
    out = {}
    for key, h in hist.items():
        random = min(sum(h), 2 * sum(h[25:]))
        for c in range(1, 26):
            passed = sum(h[c:])
            if passed and passed - random * (1 - c / 50) - SIGMAS * passed**0.5 <= rate * passed:
                out[key] = c / 50
                break
    return out


def levels(docs: DataFrame, rate: float = 0.05) -> dict[tuple[str, int], float]:
    """The p-value from which a token counts as random, by encoding and band of lengths.

    A token counts once, however often it is copied: copies are one draw, and would else
    set the level for all. What reaches the driver is a histogram of at most 4 encodings
    x 6 bands x 50 cells, whatever the corpus.
    """
    return _levels(_prepared(docs, []), rate)


def _scanned(docs: DataFrame, keep: list[str], rate: float) -> DataFrame:
    """(_row, _s): columns ``keep`` of each row of ``docs`` as a struct, and its secret spans.

    What is found is staged, so texts are searched once: the levels need the tokens of all
    rows before any row is decided.
    """
    df = staged(_prepared(docs, keep), "secrets")
    found = _levels(df, rate)
    cut = "CASE " + " ".join(f"WHEN x.enc = '{e}' AND {_band('x.n')} = {b} THEN x.p >= {c}" for (e, b), c in sorted(found.items())) + " ELSE false END" if found else "false"
    free = f"filter(_tokens, x -> ({cut}) AND NOT exists(_fixed, f -> f.start < x.stop AND x.start < f.stop))"
    every = f"array_sort(concat(_fixed, transform({free}, x -> named_struct('start', x.start, 'rank', 3, 'stop', x.stop, 'score', x.p))))"
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    spans = f"transform({every}, s -> named_struct('kind', {kinds}[s.rank], 'start', s.start, 'stop', s.stop, 'score', s.score))"
    return df.select("_row", F.expr(spans).alias("_s"))


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Add to ``docs`` (doc_id, text, ...) the column ``secrets``: its secret spans.

    ``secrets`` is an array of (kind, start, stop, score), by start and then kind as
    listed in KINDS; places are code points, stop exclusive. Fixed kinds have score 1.
    A random token that overlaps a fixed span is not reported again. Null or empty
    texts have no spans; every row and column of ``docs`` is kept, and a column named
    ``secrets`` is replaced. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "secrets"]
    return _scanned(docs, names, rate).select(*[F.col(f"_row.`{c}`").alias(c) for c in names], F.col("_s").alias("secrets"))


def joined(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined in their order."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


def redacted(docs: DataFrame, rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; n_chars follows.

    Overlapping spans are replaced once, by one mark. Texts without spans, null ones
    among them, and all other columns stay as they are.
    """
    # spans come by start: a span opens a new stretch if it begins after all before it have ended
    merged = "aggregate(_s, named_struct('at', 0, 'out', cast(array() AS array<struct<a:int,b:int>>)), (acc, s) -> CASE WHEN s.start >= acc.at THEN named_struct('at', s.stop, 'out', concat(acc.out, array(named_struct('a', acc.at, 'b', s.start)))) ELSE named_struct('at', greatest(acc.at, s.stop), 'out', acc.out) END)"
    df = _scanned(docs, docs.columns, rate).select("*", F.expr(merged).alias("_m"))
    text = f"concat(array_join(transform(_m.out, x -> substring(_row.text, x.a + 1, x.b - x.a)), '{mark}'), '{mark}', substring(_row.text, _m.at + 1))"
    df = df.select("_row", F.expr(f"CASE WHEN size(_s) > 0 THEN {text} END").alias("_new"))
    new = {"text": F.coalesce("_new", "_row.text"), "n_chars": F.coalesce(F.length("_new").cast("long"), "_row.n_chars") if "n_chars" in docs.columns else None}
    return df.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scanned(table(spark, sf_dir, "documents"), ["doc_id"], 0.05).select("_row.doc_id", F.col("_s").alias("secrets"))
    count = {k: F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS}
    return df.select(
        "doc_id", count["assign"], count["access"], count["hex"],
        F.sha2(joined("filter(secrets, s -> s.kind <> 'random')").cast("binary"), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL: dict[str, str] = {}
