"""Spelling variants against a comparison of all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
from samples import frame

from vigil.llm import spelling


def counted(docs):
    out = Counter()
    for doc, text in docs:
        for run in spelling.RUN.findall(text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            out[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def texts(seed, letters, n=200, words=120):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(words)]
    out = []
    for i in range(n):
        picked = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.05)), words - 1)]
            at = r.randrange(len(w))
            w = r.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :], w.upper()])
            picked.append(w)
        out.append((i, ", ".join(picked) + r.choice(["", " 12 - ", "ÿÀabc ß"])))
    return out


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefÀé"), (3, "aÿz")])
def test_equal_to_all_pairs(spark, seed, letters, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE_BYTES", 200)  # nodes shared by many ranges
    docs = texts(seed, letters)
    want = brute(counted(docs))
    assert len(want) > 50 and rows(spelling.report(frame(spark, docs))) == want


def test_strange_rows(spark, strange_docs, strange_rows, no_docs):
    long = "".join(random.Random(5).choice("ab") for _ in range(20_000))
    extra = [(60, f"{long} {long[:-1]}"), (61, f"{long} {long}!{long[:-1]} {long[:-1]}"), (62, "aaaaaa aaaaaaa " * 9), (62, "aaaaaa aaaaaaa " * 9), (None, "bbbbb bbbbbb bbbbb bbbbb")]
    docs = strange_rows + extra
    assert rows(spelling.report(frame(spark, docs))) == brute(counted(docs))
    assert spelling.report(no_docs).count() == 0


def test_hot_word_and_hub(spark):
    docs = [(i, "banana banana " + "banan" + "abcdefghij"[i % 10] + " " + "bananas"[i % 7 :]) for i in range(400)]
    assert rows(spelling.report(frame(spark, docs))) == brute(counted(docs))


def test_nodes_are_the_prefixes(spark):
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(1 + i % 9)) for i in range(300)})
    for size in (1, 3, 50):
        parts = [words[i : i + size] for i in range(0, len(words), size)]
        lasts, number = [p[-1] for p in parts], {}
        for j, part in enumerate(parts):
            for word, nodes in zip(part, spelling.number_range(part, lasts, j)):
                for d, node in enumerate(nodes):
                    assert number.setdefault(word[:d], node) == node
        assert len(set(number.values())) == len(number)
