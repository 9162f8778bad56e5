"""Labels, votes, splits, sampling, files."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import corpus as C
from vigil.session import kept, materialise, scratch_path, scratch_root, scratch_scope
from vigil.sources import files as FS


def test_split_is_exact_per_class_and_skewed_class(spark):
    # One class holds nearly all rows; another has a single row.
    rows = [(i, 0) for i in range(2000)] + [(3000 + i, 1) for i in range(37)] + [(9999, 2)]
    df = spark.createDataFrame(rows, "doc_id long, label3 int").repartition(6)
    out = C.stratified_split(df, "doc_id", "label3").collect()
    assert len(out) == len(rows)
    n = Counter((r.label3, r.split) for r in out)
    assert (n[0, "train"], n[0, "val"], n[0, "test"]) == (1600, 200, 200)
    assert (n[1, "train"], n[1, "val"], n[1, "test"]) == (29, 4, 4)
    assert n[2, "test"] == 1
    again = {r.doc_id: r.split for r in C.stratified_split(df.repartition(3), "doc_id", "label3").collect()}
    assert again == {r.doc_id: r.split for r in out}
    other = {r.doc_id: r.split for r in C.stratified_split(df, "doc_id", "label3", salt=":7").collect()}
    assert other != again


def test_null_stratum_is_kept(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "doc_id long, label3 int")
    n = Counter(r.split for r in C.stratified_split(df, "doc_id", "label3").collect())
    assert n == {"train": 32, "val": 4, "test": 4}


def test_votes_in_row(spark):
    rows = [
        ("p1", [("hatespeech", ["African"]), ("normal", []), ("hatespeech", None)]),
        ("p2", [("offensive", ["None"]), ("normal", ["Women", "Islam"]), ("hatespeech", ["Islam"])]),
        ("p3", [("normal", []), ("normal", ["None"]), ("normal", [])]),
        ("p4", [("normal", ["Martian"]), ("offensive", ["Women"]), ("odd", [])]),
    ]
    schema = "id string, annotators array<struct<label:string,target:array<string>>>"
    df = spark.createDataFrame(rows, schema)
    fine = C.majority_target(F.col("annotators"))
    out = {
        r.id: (r.label, r.fine, r.category)
        for r in df.select(
            "id",
            C.majority_label(F.col("annotators")).alias("label"),
            fine.alias("fine"),
            C.target_category(fine).alias("category"),
        ).collect()
    }
    assert out == {
        "p1": ("hatespeech", "African", "Race"),
        "p2": ("offensive", "Islam", "Religion"),
        "p3": ("normal", "None", "None"),
        "p4": ("normal", "Martian", "Other"),
    }


def test_long_votes_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(0 if i % 3 == 0 else i, rng.choice("abc"), i) for i in range(900)]
    rows += [(-1, "None", 0), (-1, "None", 1), (-1, "x", 2)]
    df = spark.createDataFrame(rows, "k long, v string, at long")
    out = {r.k: r.winner for r in C.majority_vote(df, "k", "v", "at", weak="None").collect()}
    hot = Counter(v for k, v, _ in rows if k == 0)
    first = {v: min(at for k, w, at in rows if k == 0 and w == v) for v in hot}
    assert out[0] == max(hot, key=lambda v: (hot[v], -first[v]))
    assert out[-1] == "x"


def test_fewshot_counts(spark):
    df = spark.createDataFrame([(i, f"t{i}", int(i % 10 == 0)) for i in range(200)], "doc_id long, text string, label int")
    out = C.fewshot_examples(df, k=5).collect()
    assert Counter(r.label for r in out) == {1: 2, 0: 3}
    assert sorted(r.position for r in out) == [1, 2, 3, 4, 5]
    few = C.fewshot_examples(df.filter("label = 0 OR doc_id = 0"), k=4).collect()
    assert Counter(r.label for r in few) == {1: 1, 0: 2}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6, "label int")
    assert {r.label: r.weight for r in C.balanced_weights(df).collect()} == {1: 2.0, 0: 8 / 12}
    assert abs(C.with_weights(df).agg(F.sum("weight")).first()[0] - 8) < 1e-9


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val"), ("b", "val")], "id string, split string")
    assert [r.id for r in C.leaked_ids(df, "id").collect()] == ["a"]


def test_seed_names():
    assert C.seeded("run", None) == ("run", ":42") and C.seeded("run", 7) == ("run_s7", ":7")


def test_csv_corpus(spark):
    path = scratch_path(spark, "t-csv")
    df = spark.createDataFrame([(0, 'say "hi",\nthere'), (2, "ok"), (None, "x"), (1, None)], "class int, tweet string")
    FS.write_csv_corpus(df.coalesce(1), path)
    out = sorted(tuple(r) for r in FS.read_csv_corpus(spark, path).collect())
    assert out == [("ok", 0, 2), ('say "hi",\nthere', 1, 0)]


def test_posts_and_split_map(spark):
    data = {
        "7_x": {"post_tokens": ["a", "b"], "annotators": [{"label": "normal", "target": []}] * 3},
        "8_x": {"post_tokens": ["c"], "annotators": [{"label": "hatespeech", "target": ["Islam"]}] * 2},
        "9_x": {"post_tokens": [], "annotators": []},
    }
    path, ids = scratch_path(spark, "t-json"), scratch_path(spark, "t-ids")
    spark.createDataFrame([(json.dumps(data),)], "value string").write.text(path)
    spark.createDataFrame([(json.dumps({"train": ["7_x", "gone"], "validation": ["8_x"]}),)], "v string").write.text(ids)
    posts = FS.unify_posts(FS.read_posts(spark, path))
    assert sorted(tuple(r) for r in posts.collect()) == [("7_x", "a b", 0, 2), ("8_x", "c", 1, 0)]
    split = C.official_split(posts, FS.read_split_map(spark, ids), "post_id")
    assert {r.post_id: r.split for r in split.collect()} == {"7_x": "train", "8_x": "val"}


def test_partition_pruning(spark):
    path = scratch_path(spark, "t-corpus")
    rows = [(1, "A", "train", "Some Text", 0, 2), (2, "A", "test", "@u http://x.y", 1, 0), (3, "B", "test", "Hi", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, dataset string, split string, text string, label int, label3 int")
    FS.write_splits(df, path)
    assert [r.text for r in FS.read_splits(spark, path, "B", "test").collect()] == ["hi"]
    assert FS.read_splits(spark, path, "A", "test").count() == 0
    plan = FS.read_splits(spark, path, "B", "test")._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters")[1].split("]")[0]
    assert "dataset" in pruned and "split" in pruned


def test_run_names(spark):
    names = [("tfidf_news",), ("embed_cor_a_s7",), ("tfidf_a_3way",), ("tfidf_a_3way_s1337",), ("chat_cor_a_fewshot",), ("chat_b_zeroshot_s7",)]
    df = spark.createDataFrame(names, "r string").select("r", *[c.alias(k) for k, c in FS.run_key_columns(F.col("r")).items()])
    assert [tuple(r)[1:] for r in df.collect()] == [
        ("tfidf", "news", None, "binary", 42),
        ("embed", "cor_a", None, "binary", 7),
        ("tfidf", "a", None, "multiclass", 42),
        ("tfidf", "a", None, "multiclass", 1337),
        ("chat", "cor_a", "fewshot", "binary", 42),
        ("chat", "b", "zeroshot", "binary", 7),
    ]


def _file(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)
    return str(folder)


def test_public_csv_layout(spark, tmp_path):
    head = ",count,hate_speech,offensive_language,neither,class,tweet\n"
    path = _file(tmp_path / "a", "labeled.csv", head + '0,3,0,0,3,2,"!!! RT @u: say ""hi"",\nthere"\n1,3,0,3,0,1,plain\n2,3,3,0,0,0,bad\n3,3,0,0,3,,x\n')
    assert sorted(tuple(r) for r in FS.read_csv_corpus(spark, path).collect()) == [('!!! RT @u: say "hi",\nthere', 0, 2), ("bad", 1, 0), ("plain", 0, 1)]
    with pytest.raises(ValueError, match="class"):
        FS.read_csv_corpus(spark, _file(tmp_path / "b", "x.csv", "label,tweet\n1,a\n"))
    with pytest.raises(Exception, match="class is no number"):
        FS.read_csv_corpus(spark, _file(tmp_path / "c", "x.csv", "class,tweet\nhate,a\n")).collect()


def test_indented_documents(spark, tmp_path):
    data = {"7_x": {"post_id": "7_x", "post_tokens": ["a", "b"], "annotators": [{"label": "normal", "annotator_id": 1, "target": []}] * 3}}
    posts = _file(tmp_path / "posts", "dataset.json", json.dumps(data, indent=2))
    ids = _file(tmp_path / "ids", "divisions.json", json.dumps({"train": ["7_x"], "val": [], "test": ["8_x"]}, indent=4))
    assert [tuple(r) for r in FS.unify_posts(FS.read_posts(spark, posts)).collect()] == [("7_x", "a b", 0, 2)]
    assert sorted(tuple(r) for r in FS.read_split_map(spark, ids).collect()) == [("test", "8_x"), ("train", "7_x")]
    FS.posts_to_lines(FS.read_posts(spark, posts), str(tmp_path / "lines"))
    assert [r.post_id for r in FS.read_posts(spark, str(tmp_path / "lines"), lines=True).collect()] == ["7_x"]
    for broken in ('{"7_x": {"post_tokens": ["a"', "[1, 2]", "no json"):
        path = _file(tmp_path / f"broken{len(broken)}", "x.json", broken)
        with pytest.raises(Exception):
            FS.read_posts(spark, path).collect()
        with pytest.raises(Exception):
            FS.read_split_map(spark, path).collect()


def test_indented_metrics(spark, tmp_path):
    run = {"accuracy": 0.9, "precision": 0.8, "recall": 0.7, "f1_binary": 0.75, "f1_macro": 0.8, "roc_auc": None, "confusion": [[5, 1], [2, 3]]}
    _file(tmp_path / "runs" / "tfidf_a_s7", "metrics.json", json.dumps(run, indent=2))
    _file(tmp_path / "runs" / "tfidf_a_s7", "other.json", "{}")
    _file(tmp_path / "runs" / "gemini_a_fewshot", "metrics.json", json.dumps(run, indent=2))
    out = sorted((r.model, r.dataset, r.regime or "", r.seed, r.accuracy, r.confusion) for r in FS.read_run_folders(spark, str(tmp_path / "runs")).collect())
    assert out == [("gemini", "a", "fewshot", 42, 0.9, [[5, 1], [2, 3]]), ("tfidf", "a", "", 7, 0.9, [[5, 1], [2, 3]])]
    _file(tmp_path / "runs" / "bad_a", "metrics.json", '{"accu')
    with pytest.raises(Exception, match="no metrics"):
        FS.read_run_folders(spark, str(tmp_path / "runs")).collect()


def test_written_metrics_have_the_public_name(spark, tmp_path):
    df = spark.createDataFrame([("m_a", 0.5, None), ("m_b_s7", 0.25, 0.75)], "run_name string, accuracy double, roc_auc double")
    FS.write_metrics(df, str(tmp_path / "out"))
    text = (tmp_path / "out" / "m_a" / "metrics.json").read_text()
    assert json.loads(text) == {"accuracy": 0.5, "roc_auc": None} and text.count("\n") > 2
    assert sorted((r.run_name, r.accuracy) for r in FS.read_run_folders(spark, str(tmp_path / "out")).collect()) == [("m_a", 0.5), ("m_b_s7", 0.25)]


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    root = scratch_root(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    mine = scratch_path(spark, "mine")
    with scratch_scope(spark):
        a = materialise(spark.range(5), "inner")
        with scratch_scope(spark):
            n = materialise(a.filter("id > 1"), "innermost").count()
        out = kept(a.filter("id > 2"), mine)
        assert len(set(os.listdir(root)) - before) == 2
    assert n == 3 and out.count() == 2
    assert {os.path.join(root, x) for x in set(os.listdir(root)) - before} == {mine}
