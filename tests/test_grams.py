"""N-grams counted by slices of texts against those counted one text at a time."""

from collections import Counter

import numpy as np
import pytest

from vigil.operators import grams as G
from vigil.operators.features import TfidfConfig

TOKENS = [["a1", "b2", "a1", "b2", "c3"], [], None, ["b2"], ["a1", "b2", "ÿé"], ["c3", "c3", "c3", "a1", "b2"]]


def counted(tokens, cfg):
    tokens = tokens or []
    return Counter(" ".join(tokens[i : i + n]) for n in range(cfg.ngram_min, cfg.ngram_max + 1) for i in range(len(tokens) - n + 1))


@pytest.mark.parametrize("cfg", [TfidfConfig(), TfidfConfig(ngram_min=2, ngram_max=3, sublinear_tf=False)])
def test_grams_of_slices_are_those_of_each_text(spark, monkeypatch, cfg):
    bits = [1, 1, 3, 2, 3, 0]
    df = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate(zip(bits, TOKENS))], "id long, bits long, _tokens array<string>").coalesce(1)
    for piece in (G.PIECE, 1):
        monkeypatch.setattr(G, "PIECE", piece)
        want = {}
        for b, t in zip(bits, TOKENS):
            for term, tf in counted(t, cfg).items():
                row = want.setdefault(term, [0] * 4)
                for k in (0, 1):
                    row[2 * k] += b >> k & 1
                    row[2 * k + 1] += (b >> k & 1) * tf
        assert {r[0]: list(r[1:]) for r in G.frequencies(df, cfg, 2).collect()} == want
        terms, idf = ["b2", "c3 c3", "a1 b2", "c3", "none", "a1 b2 a1"], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
        for r in G.weighted(df, terms, cfg, ["id"], idf).collect():
            own = sorted((terms.index(t), n) for t, n in counted(TOKENS[r["id"]], cfg).items() if t in terms)
            assert r["_i"] == [i for i, _ in own]
            assert np.allclose(r["_w"], [idf[i] * (1 + np.log(n) if cfg.sublinear_tf else n) for i, n in own])


def test_terms_are_summed_before_they_leave_a_task(spark):
    """A term of many texts is one row of a slice, not one row a text."""
    df = spark.createDataFrame([(1, ["a1", "b2"])] * 500, "bits long, _tokens array<string>").coalesce(1)
    plan = G.frequencies(df, TfidfConfig())
    assert {tuple(r) for r in plan.collect()} == {("a1", 500, 500), ("b2", 500, 500), ("a1 b2", 500, 500)}
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_marks_are_found_behind_a_class_of_few_ranges():
    """The first class holds every mark, and leaves out what ordinary prose is made of."""
    import re

    from vigil.functions.tokens import _accent_tables, _ranges

    marks = _accent_tables()[2]
    coarse = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _ranges(marks, gap=512)))
    assert all(coarse.match(chr(k)) for k in marks)
    assert not any(coarse.match(c) for c in "éüßñ“”‘’–—…€")
    assert _ranges(marks, gap=512).count("-") < 30


def test_accents_and_marks_go(spark):
    from pyspark.sql import functions as F

    from vigil.functions.tokens import strip_accents

    rows = [("cafe\u0301 “na\u00efve”", "cafe “naive”"), ("\u0915\u093f\u0301", "\u0915\u093f"), ("plain", "plain"), (None, None), ("\u00e9\u20d0x", "ex")]
    got = spark.createDataFrame(rows, "c string, want string").select(strip_accents(F.col("c")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
