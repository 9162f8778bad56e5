"""The pipeline's stages and the registered queries."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from vigil.llm import decontaminate, near_dedup, substring_dedup

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stage(spark, docs, SF).cache()
        out[name] = (given, docs)
    return out


def test_stages_keep_the_columns(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, (_, docs) in stages.items():
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    counts = [docs.count() for _, docs in stages.values()]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100


def test_decisions_take_effect(spark, stages):
    assert near_dedup.report(stages["near_dedup"][1], size=5).filter("not kept").count() == 0
    again = substring_dedup.report(stages["substring_dedup"][1])
    before = substring_dedup.report(stages["substring_dedup"][0])
    gone = lambda df: df.agg({"n_removed": "sum"}).first()[0]
    assert gone(before) > 0 and gone(again) < 0.05 * gone(before)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.report(stages["decontaminate"][1], bench).filter("contaminated").count() == 0


def test_clean_documents_stay(stages):
    given, docs = stages["substring_dedup"]
    clean = {r["doc_id"] for r in substring_dedup.report(given).filter("n_removed = 0").collect()}
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    assert {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in clean} == {i: texts[i] for i in clean}


def test_last_stage_equals_the_library(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages["bpe"][1].collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: r["ids_sha256"] for r in stages["bpe"][1].collect()}
