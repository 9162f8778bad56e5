"""Ranked search against scores of all documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from samples import frame, words

from vigil.llm import lexical

ITEM_SCHEMA = "item_id long, text string, doc_id long, score long, rank int, item long, terms string, block int"


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "t", 5) for r in rows], ITEM_SCHEMA)


def brute(docs, items, top=10):
    terms = lambda t: [x.translate(lexical.UPPER) for x in lexical.TERM.findall(t or "")]
    found = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n_docs, length, df = len(found), sum(f[2] for f in found), Counter(t for f in found for t in f[1])
    out = []
    for item, text in items:
        scored = []
        for d, tf, n in found:
            m = 10 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if t in tf)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("bucket, share", [(2048, 1 / 64), (7, 1 / 4), (1, 1 / 100)])
def test_equal_to_all_scores(spark, monkeypatch, bucket, share):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "FIRST_SHARE", share)
    r = random.Random(3)
    docs = [(i, " ".join(words(i, r.choice([1, 3, 20, 90, 400])))) for i in range(150)] + [(200 + i, "tie tie breaker") for i in range(25)]
    items = [(i, " ".join(words(1000 + i, r.randint(1, 30)))) for i in range(12)] + [(50, "Tie"), (51, "unseen"), (52, ""), (53, None), (54, docs[3][1])]
    assert rows(lexical.report(frame(spark, docs), items_frame(spark, items))) == brute(docs, items)


def test_strange_rows(spark, strange_docs, strange_rows, no_docs):
    items = [(1, "alpha0 ONE two three"), (1, "alpha0 ONE two three"), (None, "passage text é ß5 漢字3"), (2, strange_rows[6][1])]
    assert rows(lexical.report(strange_docs, items_frame(spark, items))) == brute(strange_rows, items)
    assert rows(lexical.report(no_docs, items_frame(spark, items))) == []
    assert rows(lexical.report(strange_docs, items_frame(spark, []))) == []


def test_items_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 60)
    docs = [(i, " ".join(words(i, 30))) for i in range(60)]
    items = [(i, " ".join(words(500 + i, 8))) for i in range(8)]
    assert rows(lexical.report(frame(spark, docs), items_frame(spark, items), top=3)) == brute(docs, items, 3)


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(1)
    terms = [np.sort(r.choice(60, r.integers(1, 30), replace=False)).astype("<i4") for _ in range(300)]
    vals = [r.integers(1, 10**9, len(t)) for t in terms]
    bucket = lexical.Bucket([t.tobytes() for t in terms], [v.astype("<i8").tobytes() for v in vals], np.array([np.sqrt((v.astype(float) ** 2).sum()) for v in vals]), 60)
    pruned = 0
    for _ in range(40):
        coordinates = np.sort(r.choice(60, r.integers(1, 12), replace=False)).astype(np.int64)
        true = np.array([v[np.isin(t, coordinates)].sum() for t, v in zip(terms, vals)])
        assert (bucket.exact(np.arange(300), coordinates) == true).all()
        bar = int(np.sort(true)[-10])
        kept = bucket.survivors(coordinates, max(bar, 1))
        assert set(np.flatnonzero(true >= max(bar, 1))) <= set(kept)
        pruned += 300 - len(kept)
    assert pruned > 40 * 150
    assert len(bucket.survivors(np.arange(3), 10**15)) == 0
