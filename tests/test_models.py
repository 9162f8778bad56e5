"""Features against a direct computation; models on toy comments."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import features as X
from vigil.operators import models as ML
from vigil.operators import metrics as M
from vigil.session import scratch_path

TEXTS = [
    ("i hate that group they are awful", 1),
    ("you people are disgusting", 1),
    ("have a great day everyone", 0),
    ("what a lovely sunset", 0),
    ("kill all of them", 1),
    ("the weather is nice today", 0),
    ("they should be wiped out", 1),
    ("happy birthday my friend", 0),
]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i * 10 + k, t, y) for k, (t, y) in enumerate(TEXTS) for i in range(4)]
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def direct_tfidf(texts, max_features, min_df):
    docs = []
    for t in texts:
        words = [w for w in t.split() if len(w) > 1]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    df = Counter(t for d in docs for t in d)
    cf = sum(docs, Counter())
    vocab = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t))[:max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}
    out = []
    for d in docs:
        w = {t: (1 + math.log(n)) * idf[t] for t, n in d.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / norm for t, v in w.items()})
    return out


def test_tfidf_matches_direct_computation(spark):
    texts = [t for t, _ in TEXTS] + ["they they they are are awful awful", "zzz"]
    cfg = X.TfidfConfig(max_features=12, min_df=1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = X.with_terms(df, cfg)
    got = {}
    for r in X.tfidf(docs, X.idf_table(docs, cfg), cfg).collect():
        got.setdefault(r.doc_id, {})[r.term] = r.weight
    for i, want in enumerate(direct_tfidf(texts, 12, 1)):
        assert set(got.get(i, {})) == set(want)
        assert all(abs(got[i][t] - v) < 1e-12 for t, v in want.items())


@pytest.fixture(scope="module")
def tfidf(toy):
    return ML.fit_tfidf(toy, X.TfidfConfig(max_features=200, min_df=1, max_iter=50))


def test_tfidf_model_fits_and_scores(toy, tfidf):
    out = ML.predictions(tfidf.score(toy, keep=("y",))).collect()
    assert len(out) == 32 and all(0 <= r.p_hate <= 1 for r in out)
    assert all(r.pred == r.y for r in out)


def test_inline_scores_equal_the_fitted_regression(spark, toy):
    """The in-row margin must be the margin of the ML model on the stored vectors."""
    cfg = X.TfidfConfig(max_features=30, min_df=1, max_iter=20)
    captured = {}
    original = ML.fit_regression

    def capture(features, *args, **kw):
        captured["features"] = features
        captured["lr"] = original(features, *args, **kw)
        return captured["lr"]

    ML.fit_regression = capture
    try:
        model = ML.fit_tfidf(toy, cfg)
    finally:
        ML.fit_regression = original
    direct = captured["lr"].transform(captured["features"]).select(
        "doc_id", ML.vector_to_array("probability")[1].alias("p")
    )
    both = model.score(toy).join(direct, "doc_id").collect()
    assert len(both) == 32 and all(abs(r.p_hate - r.p) < 1e-9 for r in both)


def test_text_without_known_terms_gets_the_intercept(spark, tfidf):
    df = spark.createDataFrame([(1, "qqq www"), (2, "")], "doc_id long, text string")
    p = 1 / (1 + math.exp(-tfidf.intercepts[0]))
    assert all(abs(r.p_hate - p) < 1e-12 for r in tfidf.score(df).collect())


def test_three_way(toy):
    rows = toy.withColumn("y", F.when(F.col("y") == 1, 0).when(F.col("doc_id") % 10 == 2, 1).otherwise(2))
    model = ML.fit_tfidf(rows, X.TfidfConfig(max_features=200, min_df=1, max_iter=50))
    out = ML.predictions(model.score(rows, keep=("y",))).collect()
    assert all(len(r.probabilities) == 3 and abs(sum(r.probabilities) - 1) < 1e-9 for r in out)
    assert sum(r.pred == r.y for r in out) >= 30


def test_save_and_load(spark, toy, tfidf):
    path = scratch_path(spark, "t-model")
    tfidf.save(path)
    a = {r.doc_id: r.p_hate for r in tfidf.score(toy).collect()}
    b = {r.doc_id: r.p_hate for r in ML.TfidfModel.load(spark, path).score(toy).collect()}
    assert a == b


def test_stage_models(spark, toy):
    embed = ML.fit_embedding(toy, ML.EmbedConfig(vector_size=16, buckets=512, min_count=1, max_iter=30))
    chars = ML.fit_verifier(toy, ML.VerifierConfig(buckets=4096, max_iter=30))
    for model in (embed, chars):
        out = model.score(toy, keep=("y",)).collect()
        assert len(out) == 32 and all(0 <= r.p_hate <= 1 for r in out)
        path = scratch_path(spark, "t-stage")
        model.save(path)
        again = {r.doc_id: r.p_hate for r in type(model).load(spark, path).score(toy).collect()}
        assert again == {r.doc_id: r.p_hate for r in out}
    assert M.evaluate(chars.score(toy, keep=("y",)), [], "y").first().roc_auc == 1.0
    vectors = embed.vectors(toy.select("doc_id", "text")).collect()
    assert all(len(r.vector) == 16 for r in vectors)


def test_select_best(toy):
    fits = {c: ML.fit_tfidf(toy, X.TfidfConfig(max_features=50, min_df=1, max_iter=20, C=float(c))) for c in ("1", "9")}
    best, board = ML.select_best(fits, toy)
    rows = {r.model: r.f1_macro for r in board.collect()}
    assert rows[best] == max(rows.values())


def test_balanced_weights_sum_to_n(toy):
    skewed = toy.filter((F.col("y") == 0) | (F.col("doc_id") < 10))
    counts = ML.class_counts(skewed)
    total = skewed.agg(F.sum(ML.class_weight(counts))).first()[0]
    assert abs(total - sum(counts.values())) < 1e-9


def test_character_buckets_are_those_of_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF

    from vigil.operators.characters import with_buckets

    texts = ["Ab ab  cde", "", None, "x", "héllo wörld \U0001f600\U0001f600 日本語", "one two three " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["i"] for r in with_buckets(df, "text", (3, 4, 5), 1 << 18).collect()}
    rows = []
    for i, t in enumerate(texts):
        grams = set()
        for word in {f" {w} " for w in (t or "").lower().split()}:
            for n in (3, 4, 5):
                grams |= {word[a : a + n] for a in range(max(len(word) - n, 0) + 1)}
        rows.append((i, sorted(grams)))
    hashed = HashingTF(numFeatures=1 << 18, binary=True, inputCol="g", outputCol="f").transform(spark.createDataFrame(rows, "id int, g array<string>"))
    assert got == {r["id"]: r["f"].indices.tolist() for r in hashed.collect()}
