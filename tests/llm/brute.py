"""Plain row-at-a-time versions of what the contracts say, for the tests."""

import hashlib
import math
import re
import struct
import zlib

import xxhash


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    out = 0
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hs) > len(hs):
            out |= 1 << b
    return out


def classes(fps, distance=2):
    """fps: {doc_id: fingerprint} to {doc_id: least doc_id of its class}."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similar_classes(texts, similarity=0.8):
    """texts: {doc_id: text} to {doc_id: least doc_id of its class by Jaccard similarity of shingles}."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 10 * both >= round(10 * similarity) * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def secrets(text):
    text = text or ""
    found = []
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def pii(text):
    text = text or ""
    n = lambda s: len(re.sub("[^0-9]", "", s))
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= n(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= n(s) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def toxicity(model, text):
    """The score as a sum over a set of n-grams, each hashed on its own."""
    from tracewell.llm import toxicity as t

    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    text, buckets, mask = f" {text.lower()} ", set(), (1 << 64) - 1
    for n in t.ORDERS:
        for gram in {text[i : i + n] for i in range(len(text) - n + 1)}:
            h = ord(gram[0])
            for c in gram[1:]:
                h = (h * int(t._MIX) + ord(c)) & mask
            buckets.add((((h ^ h >> 29) * (0xD6E8FEB86659FD93 + 2 * n)) & mask) >> (64 - t.BITS))
    z = model.bias + sum(weight.get(b, 0.0) for b in buckets)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def quality(model, text):
    """The score as a sum over table cells, each found by counting the edges below the feature."""
    from tracewell.llm import quality as q

    x = q.features(text)
    at = [sum(e <= v for e in edges) for edges, v in zip(model.edges, x)]
    z = model.bias + sum(t[i] for t, i in zip(model.tables, at)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def media(raw):
    """(payload sha256, media bytes, media sha256) of a payload stored as 8-bit samples."""
    payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return hashlib.sha256(payload).hexdigest(), len(head + payload), hashlib.sha256(head + payload).hexdigest()


def phrases(docs, items, window, slop):
    """{doc_id: (n_hit, items, near)} by trying every window at every start."""
    out = {}
    wins = {i: [t.split()[k : k + window] for k in range(max(1, len(t.split()) - window + 1))] for i, t in items if t.split()}
    for d, text in docs:
        w, hit, exact, near = text.split(), set(), set(), set()
        for i, ws in wins.items():
            for p in ws:
                for s in range(-slop, len(w) + slop):
                    if s >= 0 and w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        exact.add(str(i))
                    if all(t in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k, t in enumerate(p)):
                        near.add(str(i))
        out[d] = (len(hit), sorted(exact), sorted(near))
    return out
