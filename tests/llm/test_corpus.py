"""Quality rules, clustering and phrase mining against brute force and on odd inputs."""

import gc
import hashlib
import random
import re
import weakref
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewell.llm import common, phrases, registry, rules, sortmeans

SPACE = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    text = text or ""
    w = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    again = {k for i, g in enumerate(grams) if g in often for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


ODD_TEXTS = [None, "", " \n\t ", "a", "a b", "a b c a b c", "a b c d a b c", "x\n x\nx\n\nx\r\nx\r", "<#> *a* $5 %|&", "été \U0001f642 x y\x0bz\x0cw", "a a a a a a", "a b a b a b a c", "one two three four five one two three four", "w " * 20000, " ".join(f"w{i % 700}" for i in range(5000))]


def test_rule_counts_equal_brute_force(spark):
    r = random.Random(1)
    texts = ODD_TEXTS + ["".join(r.choice("aab  \n\t#|.!") for _ in range(r.randint(0, 200))) for _ in range(60)]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, t int, w int, kept int")
    got = rules.features(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == Counter(map(brute_counts, texts))
    rows = rules.judged(docs).collect()
    assert len(rows) == len(texts) and all(not x["kept"] for x in rows if x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])


def test_rules_query(spark):
    got = {x["doc_id"]: x for x in registry.QUERIES["op11_quality_rules"](spark, SF).collect()}
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for d, x in got.items():
        assert brute_counts(docs[d]) == (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert not (x["kept"] and x["base_failed"])
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    said = [(got[d]["kept"], q) for d, q in labels.items() if d in got and not got[d]["base_failed"] and q is not None]
    assert sum(k == (q == 1) for k, q in said) >= 0.97 * len(said)
    assert rules.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # rules that abstain do not count against a document
    silent = spark.range(1).select(*[F.lit(0).alias(f"v_{r}") for r in rules.RULES], F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"))
    assert silent.select(rules.posterior(rules.fit(rules.votes(common.staged(rules.features(spark.read.parquet(f"{SF}/documents.parquet")), "features")))).alias("p")).first()["p"] > 0.5


def brute_em(patterns, rounds):
    """EM on {votes: n} with numpy; the probability of good for each pattern."""
    keys = np.array(list(patterns))
    n = np.array(list(patterns.values()), float)
    k = len(rules.RULES)
    good, bad_p, good_p = 0.8, np.full((k, 2), (0.3, 0.03)), np.full((k, 2), (0.3, 0.6))
    for _ in range(rounds):
        z = np.full(len(keys), np.log(good / (1 - good)))
        for r in range(k):
            z += np.where(keys[:, r] < 0, np.log(bad_p[r, 1] / bad_p[r, 0]), np.where(keys[:, r] > 0, np.log(good_p[r, 1] / good_p[r, 0]), 0.0))
        p = 1 / (1 + np.exp(-z))
        g, b = (n * p).sum(), (n * (1 - p)).sum()
        for r in range(k):
            for sign, out, top in ((-1, bad_p, 0), (1, good_p, 1)):
                m = n * (keys[:, r] == sign)
                pair = ((m * (1 - p)).sum() + 1) / (b + 3), ((m * p).sum() + 1) / (g + 3)
                out[r] = pair if pair[top] >= pair[1 - top] else (m.sum() + 2) / (g + b + 6)
        good = (g + 1) / (g + b + 2)
    return good, bad_p, good_p


def test_em_equals_brute_force_and_finds_accuracies(spark):
    r = random.Random(5)
    names = list(rules.RULES)
    hit = {n: r.uniform(0.2, 0.7) for n in names}
    rows = []
    for i in range(4000):
        bad = i % 5 == 0
        v = [-1 if r.random() < (hit[n] if bad else 0.02) else 1 if r.random() < (0.1 if bad else 0.6) else 0 for n in names]
        rows += [(i, *v, 100, 0)] * (500 if i == 0 else 1)
    df = spark.createDataFrame(rows, "text_hash long, " + ", ".join(f"v_{n} int" for n in names) + ", n_words int, n_repeat_words int")
    trust = rules.fit(df)
    assert abs(trust.good - 0.8) < 0.03 and all(abs(trust.bad_votes[n][0] - hit[n]) < 0.1 for n in names)
    assert all(trust.accuracy(n) > 0.75 for n in names)
    once = {x[0]: x[1:-2] for x in rows}
    good, bad_p, good_p = brute_em(Counter(once.values()), 8)
    few = rules.fit(df, rounds=8)
    assert abs(few.good - good) < 1e-4
    assert np.allclose([few.bad_votes[n] for n in names], bad_p, atol=1e-4) and np.allclose([few.good_votes[n] for n in names], good_p, atol=1e-4)


def test_a_rule_that_speaks_against_its_meaning_says_nothing(spark):
    names = list(rules.RULES)
    rows = [(i, *([-1] + [1] * (len(names) - 1) if i % 2 else [0] + [-1] * (len(names) - 1)), 100, 0) for i in range(400)]
    trust = rules.fit(spark.createDataFrame(rows, "text_hash long, " + ", ".join(f"v_{n} int" for n in names) + ", n_words int, n_repeat_words int"))
    assert trust.bad_votes[names[0]][0] == trust.bad_votes[names[0]][1]


def brute_kmeans(kept, k=16, rounds=3):
    """kept: [(vec_id, ints)] to rows of the contract; plain Python."""
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"1:{kept[i][0]}".encode()).hexdigest(), kept[i][1]))
    cent = [list(kept[i][1]) for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cent))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(cent)):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            if own:
                cent[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, d, c in out)


@pytest.mark.parametrize("n", [0, 5, 16, 150])
def test_clusters_of_odd_vectors_equal_brute_force(spark, tmp_path, n):
    r = random.Random(n)
    nan, inf = float("nan"), float("inf")
    good = [(i // 2, [r.choice([-1.5, -0.26, 0.0, 0.25, 1.0]) if k % 9 == 0 else 0.0 for k in range(64)]) for i in range(n)]
    good += good[:3]
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [nan] + [0.5] * 63), (906, [0.5] * 63 + [-inf])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in good + bad], "vec_id long, embedding array<float>, cluster int, distance int, v string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["op12_clusters"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_kmeans([(i, [int(np.floor(64 * x)) for x in v]) for i, v in good])


def test_vectors_without_ids_stay_and_huge_ones_raise(spark):
    rows = [(None, [0.5] * 64)] * 2 + [(1, [0.25] * 64)]
    found, cent = sortmeans.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, rounds=1)
    assert found.count() == 3 and len(cent) == 2 and cent[0][0] == 16
    with pytest.raises(Exception, match="beyond"):
        sortmeans.integer_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_sort_means_skips_distances_and_keeps_ties():
    r = np.random.default_rng(2)
    cent = r.integers(-64, 64, (16, 64))
    x = np.concatenate([cent[r.integers(0, 16, 400)] + r.integers(-4, 5, (400, 64)), (cent[[3, 5]].sum(axis=0) // 2)[None]])
    full = ((x[:, None] - cent[None]) ** 2).sum(axis=2)
    for before in (np.zeros(len(x), np.int32), full.argmin(axis=1).astype(np.int32)):
        cluster, distance, computed = sortmeans.nearest(x, cent, before)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert computed < 0.2 * full.size
    # two centroids just as far: exactly twice the distance must still be looked at
    assert sortmeans.nearest(np.array([[1]]), np.array([[0], [2]]), np.array([1], np.int32))[0].tolist() == [0]


def brute_collocations(rows, least, top):
    f, total, where = Counter(), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in (1, 2, 3, 4):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= 80 * a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, b in cand.items()):
            continue
        s, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:top])}


@pytest.mark.parametrize("size", [None, 300, 40])
def test_collocations_equal_brute_force_over_shards(spark, size):
    r = random.Random(7)
    word = lambda: r.choice(["a", "B", "c", "d", "É", "\U0001f642", "x y", "long" * 20])
    texts = [(r.choice(["en", "en", None, "und", ""]), "".join(word() + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ! "]) for _ in range(r.randint(0, 90)))) for _ in range(50)]
    texts += [("en", None), (None, ""), ("de", "a b " * 700), ("de", "one two three four five " * 40), ("fr", "w" * 300), *[("es", "tie one. tie two.")] * 6]
    docs = spark.createDataFrame([(i, t, lang, 1, 2) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase int, a int").repartition(3)
    want = brute_collocations(texts, 5, 25)
    if size:  # tasks run elsewhere, so shards are checked here
        got = Counter()
        full = {k: np.full(1 << (phrases.FILTER_BITS - 6), ~np.uint64(0)) for k in (1, 2, 3)}
        want4 = Counter()
        for lang, t in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
                w = re.findall(r"[^\x20\x09]+", piece)
                want4.update((lang or "und", *w[i : i + m]) for m in (2, 3, 4) for i in range(len(w) - m + 1))
        for m in (2, 3, 4):
            for lang, words, ids in phrases.shards(((x or "und", (t or "").encode()) for x, t in texts), m - 1, size):
                allowed = np.ones(len(words), bool)
                allowed[0] = False
                for p, n in phrases.phrase_counts(phrases.Bitmaps(ids, allowed), phrases.word_hashes(lang, words), m, full):
                    for row, c in zip(p.tolist(), n.tolist()):
                        got[(lang, *(words[i].as_py().decode() for i in row))] += c
        assert got == want4
    else:
        assert {tuple(x) for x in phrases.collocations(docs, least=5, top=25).collect()} == want
        assert phrases.collocations(docs.where("false")).count() == 0


def test_bitmaps_of_a_done_shard_are_not_kept():
    ((lang, words, ids),) = phrases.shards([("en", b"a b c a b c a b")], 2)
    allowed = np.arange(len(words)) > 0
    full = {k: np.full(1 << (phrases.FILTER_BITS - 6), ~np.uint64(0)) for k in (1, 2)}
    maps = phrases.Bitmaps(ids, allowed)
    kept = weakref.ref(maps)
    gc.disable()
    try:
        assert sum(int(n.sum()) for _, n in phrases.phrase_counts(maps, phrases.word_hashes(lang, words), 3, full)) == 6
        del maps
        assert kept() is None
    finally:
        gc.enable()


def test_two_word_phrases_and_equal_scores(spark):
    rows = [("en", t) for t in ["b a", "a b", "c d", "B A"] * 3]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, least=3, max_words=2, top=10).orderBy("rank").collect()
    assert [(x["rank"], x["phrase"], x["a"]) for x in got] == [(1, "c d", 3), (2, "b a", 6), (3, "a b", 3)]
