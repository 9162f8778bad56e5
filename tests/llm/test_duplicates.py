"""Near copies and repeated passages against brute force."""

import random

import brute
import numpy as np
import pytest
from samples import frame, words

from vigil.llm import components, exchange, near_dedup, sketch, substring_dedup, words as W


def plain(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def copies(seed, groups=12):
    """Documents with exact copies, near copies on either side of 0.8, chains and shared passages."""
    r, rows, line = random.Random(seed), [], words(99, 25)
    for g in range(groups):
        base = words(seed * 1000 + g, r.randint(8, 120))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = f"edit{r.randint(0, 9)}"
            rows.append((0, " ".join((line if r.random() < 0.3 else []) + w)))
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = copies(seed, groups=25)
    got = plain(near_dedup.report(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.near(rows), key=str)
    kept = {r["doc_id"] for r in near_dedup.dedup(frame(spark, rows)).collect()}
    assert kept == {d for d, _, c in brute.near(rows) if d == c}


def test_a_large_group_with_many_components(spark):
    base, rows, r = words(5, 60), [], random.Random(3)
    for i in range(250):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            w[r.randrange(60)] = f"e{r.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    assert plain(near_dedup.report(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows), key=str)


def test_strange_rows(spark, strange_docs, strange_rows):
    got = near_dedup.report(strange_docs).collect()
    assert len(got) == len(strange_rows)
    # Rows that share an id share a node only if they lead a class, so ids are compared once.
    want = {}
    for d, n, c in brute.near(strange_rows):
        want.setdefault((d, n), set()).add(c)
    assert all(r["component_id"] in want[r["doc_id"], r["n_shingles"]] for r in got)
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    out = near_dedup.dedup(strange_docs)
    assert out.columns == strange_docs.columns and out.filter("doc_id is null").count() == 2


def test_empty_tables(spark, no_docs):
    assert near_dedup.report(no_docs).count() == 0
    assert near_dedup.dedup(no_docs).columns == no_docs.columns
    assert substring_dedup.report(no_docs).count() == 0
    assert substring_dedup.dedup(no_docs).count() == 0


def test_components_of_chains_and_hubs(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 560)]
    ids = list(range(1000, 1100))
    loose = [(r.choice(ids), r.choice(ids)) for _ in range(60)]
    links = chain + hub + loose + [(7, 7), (160, 500)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if x != 7}


def test_sketch_coordinates_agree_as_often_as_the_sets(spark):
    rng = np.random.default_rng(2)
    for size, common in ((500, 400), (40, 32), (6, 5)):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
            s = sketch.sketches(np.concatenate([x[:size], x[size - common :]]), np.array([0, size, 2 * size]))
            assert (s != np.iinfo(np.uint64).max).all()
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - common / (2 * size - common)) < 0.03
        assert np.std(agree) < 0.09


@pytest.mark.parametrize("seed", [4, 5])
def test_repeats_are_those_of_all_windows(spark, seed):
    r, rows = random.Random(seed), []
    passages = [words(seed * 10 + k, r.randint(10, 60)) for k in range(6)]
    for i in range(60):
        w = words(seed * 777 + i, r.randint(0, 50))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            p = r.choice(passages)
            w[at:at] = p[r.randint(0, 5) :]
        rows.append((r.randint(0, 200), r.choice([" ", "\n"]).join(w)))
    got = plain(substring_dedup.report(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.repeats(rows), key=str)


def test_repeats_in_strange_rows(spark, strange_docs, strange_rows):
    got = plain(substring_dedup.report(strange_docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.repeats(strange_rows), key=str)
    out = substring_dedup.dedup(strange_docs)
    assert out.columns == strange_docs.columns
    left = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (10, None) in left and (11, "") in left
    assert all(t is None or d != 17 or "changed" in t for d, t in left)


def test_cut_keeps_the_space_around(spark):
    p = " ".join(words(8, 20))
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring_dedup.dedup(frame(spark, [(1, p), (2, f"before\n{p}\n\nafter"), (3, p), (4, "short")])).collect()}
    assert out[2] == ("before\n\n\nafter", 14) and out[1][0] == p and out[4][0] == "short" and 3 not in out


def test_packed_columns_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b, c = rng.integers(0, 255, n).astype(np.uint8), rng.integers(-(1 << 62), 1 << 62, n)
        for x, y in zip(exchange.unpack(exchange.pack(a, b, c), np.uint8, np.int64), (a, b, c)):
            assert (x == y).all()


def test_word_hashes_follow_the_words():
    texts = [b"a bb  a\nccc", b"", b"bb a bb", b" ", "é bb".encode()]
    w = W.Words(texts, W.NOT_SPACE, lower=False)
    h = w.hashes()
    names = [w.word(i) for i in range(w.n)]
    assert names == [b"a", b"bb", b"a", b"ccc", b"bb", b"a", b"bb", "é".encode(), b"bb"]
    assert len(set(h.tolist())) == len(set(names)) and [h[names.index(x)] for x in names] == h.tolist()
    assert w.first.tolist() == [0, 4, 4, 7, 7, 9]
    start, runs = W.windows(h, w.first, 2)
    assert start.tolist() == [0, 1, 2, 4, 5, 7]
    joined = [tuple(names[s : s + 2]) for s in start]
    assert len(set(runs.tolist())) == len(set(joined))
