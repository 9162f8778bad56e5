"""Blocks by problems, tasks of a pass, and the rows that an experiment asks for."""

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import batched as B
from vigil.operators import embedding as V
from vigil.plans import many as Y


def test_rows_that_train_the_same_problems_share_a_block(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ENTRIES", 40)
    rows = [(i, i % 2, 1 << (i % 3), [i % 50, 50 + i % 9]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, bits long, i array<int>").coalesce(1)
    blocks = B.blocks_of(df, 60, 3)
    found = blocks.opened().collect()
    assert sum(len(set(b["bits"].tolist())) > 1 for b in found) <= 1 < len(found) / 5
    entries = [(y, bits, i) for b in found for y, bits, i in zip(b["y"], b["bits"], np.split(b["used"][b["local"]], np.cumsum(b["sizes"])[:-1]))]
    assert sorted((int(y), int(k), i.tolist()) for y, k, i in entries) == sorted((y, k, i) for _, y, k, i in rows)


def test_a_pass_has_a_task_per_core(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "_fit", lambda blocks, problems, *rest: seen.append(blocks) or (np.zeros((9, 1)), np.zeros(1), np.zeros(1), np.zeros(1)))
    df = spark.createDataFrame([(i, i % 2, i % 3 // 2, [i % 9]) for i in range(90)], "id long, y int, bits long, i array<int>").repartition(30)
    blocks = B.blocks_of(df, 9, 1)
    blocks.data = blocks.data.repartition(30)
    blocks.partitions = 30
    B.fit(blocks)
    assert seen[0].partitions == seen[0].held.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert seen[0].held.map(lambda b: int((b["bits"] != 0).sum())).sum() == 30


def test_asked_scores_are_those_of_a_fit_that_scores_all(spark):
    r = np.random.default_rng(8)
    rows = [(i, " ".join([f"w{j}" for j in r.integers(0, 30, 12)] + ["bad"] * (i % 4 == 0)), int(i % 4 == 0), int(i % 4 == 0), "AB"[i % 2]) for i in range(160)]
    # One id in both corpora.
    rows += [(900, "w1 w2", 0, 0, d) for d in "AB"]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, label int, label3 int, dataset string")
    corpora = {d: corpus.filter(F.col("dataset") == d) for d in "AB"}
    cfg = V.EmbedConfig(vector_size=8, buckets=256)
    every, tested = Y.Runs(corpora), Y.Runs(corpora, asked=(("test",), False))
    want = every.scored(every.fit("embed", cfg).score(), "embed").filter("dataset = train and split = 'test'")
    model = tested.fit("embed", cfg)
    got = tested.scored(model.score(), "embed").filter("dataset = train and split = 'test'")
    key = lambda r: (r["train"], r["id"], r["label"], round(r["p_hate"], 4))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    # Rows of the other corpus that nothing asks for are not folded in.
    assert model.score().count() < 200


def test_rows_are_added_by_number():
    r = np.random.default_rng(9)
    at, rows = r.integers(0, 7, 300) ** 2, r.normal(size=(300, 5)).astype(np.float32)
    total, want = np.zeros((50, 5), dtype=np.float32), np.zeros((50, 5))
    V.add_rows(total, at, rows)
    np.add.at(want, at, rows)
    assert np.allclose(total, want, atol=1e-4)


def test_only_texts_that_meet_a_test_row_are_obfuscated(spark, monkeypatch):
    r = np.random.default_rng(10)
    rows = [(i, " ".join([f"w{j}" for j in r.integers(0, 30, 12)] + ["bad"] * (i % 4 == 0)), int(i % 4 == 0), int(i % 4 == 0), "AB"[i % 2]) for i in range(160)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, label int, label3 int, dataset string")
    corpora = {d: corpus.filter(F.col("dataset") == d) for d in "AB"}
    cfg, written = V.EmbedConfig(vector_size=8, buckets=256), {}
    real = Y.materialise

    def kept(df, name):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(Y, "materialise", kept)
    got = sorted(map(tuple, Y.robustness((("embed", cfg),), corpora).collect()))
    runs = Y.Runs(corpora)
    tested = {x["id"] for x in runs.keys.collect() if "test" in x["splits"].values()}
    assert {x["id"] for x in written["obfuscated"].collect()} == tested and len(tested) < 60
    model = runs.fit("embed", cfg)
    noisy = runs.rows.select("id", Y.obfuscate_text(F.col("text"), F.col("id")).alias("text"))
    clean = runs.scored(model.score(), "embed").filter("dataset = train and split = 'test'")
    changed = model.score(noisy).withColumnRenamed("p_hate", "p_obf").join(runs.names, "problem").select("id", "train", "salt", "p_obf")
    want = sorted(map(tuple, Y.R.robustness(clean.join(changed, ["id", "train", "salt"]), ["model", "dataset"], "p_hate", "p_obf").collect()))
    assert len(got) == len(want) == 2
    for a, b in zip(got, want):
        assert all(x == y or abs(x - y) < 1e-5 for x, y in zip(a, b))
