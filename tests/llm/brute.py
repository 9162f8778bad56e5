"""Brute-force forms of the operators on lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = WORDS.findall(lowered(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(docs, size=4, percent=80):
    """Per row: (doc_id, n_shingles, component_id); ids may repeat."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (docs[i][0], docs[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(docs)]


def repeats(docs, window=13):
    """Per row: (doc_id, n_words, n_removed, kept_sha256)."""
    big = float("inf")
    words = [WORDS.findall(t or "") for _, t in docs]
    least = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(big if d is None else d, least.get(k, big))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (big if d is None else d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(docs, items, window=10):
    """Per row: (doc_id, n_words, n_hit, items)."""
    found = {}
    for item, text in items:
        w = ALNUM.findall(lowered(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if k else ():
            found.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in found}
    out = []
    for d, text in docs:
        w, hit, ids = ALNUM.findall(lowered(text)), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                got = found.get(tuple(w[i : i + k]))
                if got:
                    hit.update(range(i, i + k))
                    ids |= got
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


def unigrams(docs, train):
    """Per row: (doc_id, n_tokens, n_known, N, base_score)."""
    toks = lambda t: [w.encode() for w in WORDS.findall(lowered(t))] + [None]
    c = Counter(w for d, t in docs if train(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    return [(d, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) for d, t in docs]


def crc_mod(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
