"""Many regressions at once against the optimality conditions; hashed embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import batched as B
from vigil.operators import embedding as V
from vigil.operators import models as ML
from vigil.operators.features import TfidfConfig
from vigil.plans import many as Y

SIZE = 60


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(200):
        at = np.sort(r.choice(SIZE, 8, replace=False))
        rows.append((i, int(at[0] % 3 == 0), int(r.integers(0, 8)), at.tolist(), (r.random(8) + 0.1).tolist()))
    rows += [(500, 1, 7, [], []), (501, None, 0, [3], [1.0]), (501, None, 0, [3], [1.0])]
    scale = r.random((SIZE, 3)) + 0.5
    scale[:10, 0] = 0
    return rows, scale, spark.createDataFrame(rows, "id long, y int, bits long, i array<int>, v array<double>").repartition(3)


def dense(rows, scale, k):
    x = np.zeros((len(rows), SIZE))
    for a, (_, _, _, at, v) in enumerate(rows):
        x[a, at] = np.array(v) * scale[at, k]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@pytest.mark.parametrize("c", [1.0, np.array([0.1, 1.0, 10.0])])
def test_every_problem_is_at_its_optimum(data, c):
    rows, scale, df = data
    blocks = B.blocks_of(df, SIZE, 3, scale)
    fitted = B.fit(blocks, c)
    scores = {(r["id"], r["problem"]): r["p_hate"] for r in B.scores(blocks, fitted.coefficients, fitted.intercepts).collect()}
    for k in range(3):
        x, inside, y = dense(rows, scale, k), np.array([r[2] >> k & 1 for r in rows]), np.array([r[1] or 0 for r in rows])
        n = inside.sum()
        w = inside * np.where(y == 1, n / (2 * (inside * y).sum()), n / (2 * (inside * (1 - y)).sum()))
        p = 1 / (1 + np.exp(-(x @ fitted.coefficients[:, k] + fitted.intercepts[k])))
        left = x.T @ (w * (p - y)) + fitted.coefficients[:, k] / np.broadcast_to(c, 3)[k]
        assert np.abs(left).max() / n < 1e-6 and abs((w * (p - y)).sum()) / n < 1e-6
        assert max(abs(scores[r[0], k] - q) for r, q in zip(rows, p)) < 1e-12


def test_sums_by_slices_and_groups_of_problems_change_nothing(data, monkeypatch):
    _, scale, df = data
    one = B.fit(B.blocks_of(df, SIZE, 3, scale))
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    monkeypatch.setattr(B, "SLICE", 7)
    monkeypatch.setattr(B, "STATE_BYTES", 1)
    monkeypatch.setattr(B, "BLOCK_ENTRIES", 50)
    assert [list(g) for g in B.batches(3, SIZE)] == [[0], [1], [2]]
    two = B.fit(B.blocks_of(df, SIZE, 3, scale))
    assert np.abs(one.coefficients - two.coefficients).max() < 1e-6 and np.abs(one.intercepts - two.intercepts).max() < 1e-6


def comments(spark):
    r = np.random.default_rng(4)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(160):
        y = int(i % 4 == 0)
        text = " ".join([*r.choice(words[: 20 if y else 40], 12), *(["awful"] if y and i % 3 else [])])
        rows.append((i, text, y, y, "AB"[i % 2]))
    return spark.createDataFrame(rows, "doc_id long, text string, label int, label3 int, dataset string")


MODELS = {"tfidf": TfidfConfig(max_features=60), "embed": V.EmbedConfig(vector_size=8, buckets=256), "verifier": ML.VerifierConfig(buckets=512)}


@pytest.mark.parametrize("name", list(MODELS))
def test_fits_together_equal_fits_alone(spark, name):
    corpus = comments(spark)
    corpora = {d: corpus.filter(F.col("dataset") == d) for d in "AB"}
    together = Y.Runs(corpora, (":1", ":2"))
    cfg = MODELS[name]
    got = {}
    for r in together.scored(together.fit(name, cfg).score(), name).collect():
        got[r["train"], r["salt"], r["id"]] = (r["p_hate"], r["split"], r["label"])
    assert len(got) == 4 * 160
    alone = Y.Runs({"B": corpora["B"]}, (":2",))
    rows = alone.scored(alone.fit(name, cfg).score(), name).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    for r in rows:
        p, split, label = got["B", ":2", r["id"]]
        assert abs(p - r["p_hate"]) < 1e-5 and (split, label) == (r["split"], r["label"])


def test_batched_tfidf_is_the_single_model(spark):
    corpus = comments(spark)
    runs = Y.Runs({"A": corpus.filter("dataset = 'A'")})
    many = {r["id"]: r["p_hate"] for r in runs.fit("tfidf", MODELS["tfidf"]).score().collect()}
    train = runs.rows.filter("bits != 0").select(F.col("id").alias("doc_id"), "text", "y")
    single = ML.fit_tfidf(train, MODELS["tfidf"]).score(runs.rows.withColumnRenamed("id", "doc_id")).collect()
    assert max(abs(many[r["doc_id"]] - r["p_hate"]) for r in single) < 5e-3


def test_vectors_of_a_text_are_its_own(spark):
    corpus = comments(spark)
    model = ML.fit_embedding(corpus.withColumn("y", F.col("label")), MODELS["embed"])
    own = {r["doc_id"]: np.array(r["vector"]) for r in model.vectors(corpus).collect()}
    again = {r["doc_id"]: np.array(r["vector"]) for r in model.vectors(corpus.repartition(5)).collect()}
    ids, matrix = list(own), np.array(list(own.values()))
    for i, d in enumerate(ids):
        near = np.linalg.norm(matrix - again[d], axis=1)
        assert near[i] < 1e-9 and near[i] == near.min()
    strange = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(not any(r["vector"]) for r in model.vectors(strange).collect())


def test_contexts_are_sums_over_the_window():
    r = np.random.default_rng(2)
    signs, ids = r.choice([-1.0, 1.0], (30, 4)), r.integers(0, 30, 50)
    got = V.contexts(ids, signs.astype(np.float32), 3)
    for i in range(50):
        want = sum((signs[ids[j]] for j in range(max(0, i - 3), min(50, i + 4)) if j != i), np.zeros(4))
        assert np.allclose(got[i], want)


def test_words_of_like_contexts_are_near(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        pet, thing = r.choice(["cat", "dog"]), r.choice(["stone", "brick"])
        rows.append((i, f"the {pet} eats and sleeps at home . a heavy {thing} lies in the wall outside"))
    df = spark.createDataFrame(rows, "id long, text string")
    cfg = V.EmbedConfig(vector_size=32, buckets=4096, window=3)
    words = V.fit_words(V.with_buckets(df, cfg), cfg)
    at = V.with_buckets(spark.createDataFrame([(0, "cat dog stone brick")], "id long, text string"), cfg).first()["_ids"]
    cat, dog, stone, brick = (words[i] for i in at)
    assert cat @ dog > cat @ stone and stone @ brick > dog @ brick


def test_texts_fold_in_alone_as_together():
    r = np.random.default_rng(5)
    cfg = V.EmbedConfig(vector_size=8, buckets=64)
    words = V._unit(r.normal(size=(64, 8))).astype(np.float32)
    words[:5] = 0
    ids = [r.integers(0, 64, n) for n in (1, 30, 0, 7)] + [np.array([1, 2, 2])]
    got = V.fold_in(ids, words, cfg)
    assert not got[2].any() and not got[4].any()
    for k in (0, 1, 3):
        known = ids[k][words[ids[k]].any(axis=1)]
        v = words[known].astype(float)
        d = v.mean(axis=0)
        for _ in range(cfg.steps):
            d = d + (((1 - v @ d)[:, None] * v).mean(axis=0) - cfg.ridge * d) / (1 + cfg.ridge)
        assert np.allclose(got[k], d / np.linalg.norm(d), atol=1e-9)


def test_histories_are_as_long_as_the_state_has_room():
    for size in (200, 70_000, 1 << 18):
        for group in B.batches(6, size) + B.batches(2, size):
            held = B.steps_held(len(group), size)
            assert B.HISTORY <= held <= B.LONGEST_HISTORY
            assert (2 * held + 4) * 8 * size * len(group) <= B.STATE_BYTES
    assert B.steps_held(2, 1 << 18) == B.LONGEST_HISTORY and B.steps_held(6, 1 << 18) == B.HISTORY


def test_passes_do_not_grow_with_the_rows(spark):
    """A feature of every row and rare ones: Spark's scaling and a diagonal start take hundreds of passes."""
    r = np.random.default_rng(6)
    used = []
    for n in (400, 3200):
        rows = [(i, i % 4 == 0, 1, sorted({0, 1, 2, *r.choice(np.arange(3, 600 if i % 4 else 900), 25).tolist()})) for i in range(n)]
        df = spark.createDataFrame([(i, int(y), bits, at) for i, y, bits, at in rows], "id long, y int, bits long, i array<int>").repartition(2)
        fitted = B.fit(B.blocks_of(df, 900, 1))
        used.append(int(fitted.iterations[0]))
        assert fitted.left[0] < 1e-6
    assert max(used) <= 30
