"""Every registered query with a SQL twin, and the shape of some plans."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    _, _, verdict = check.compare(spark, con, name, SF)
    assert verdict.startswith("ok"), verdict


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["met_binary", "exp_cascade_sweep", "win_spend_ceiling", "llm_preflight", "agg_seeds"])
def test_no_cartesian_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_metric_queries_do_not_read_texts(spark):
    for name in ("met_binary", "exp_cascade_sweep", "agg_target_group_audit", "split_stratified"):
        scans = [line for line in plan(spark, name).splitlines() if "FileScan" in line]
        assert scans and all("text:string" not in s for s in scans), name


def test_python_functions_are_absent(spark):
    for name in ("text_clean", "exp_obfuscate", "feat_tfidf", "llm_parse", "agg_latency_summary"):
        assert "Python" not in plan(spark, name), name


@pytest.mark.parametrize("name", ["exp_cross_dataset_fitted", "exp_threshold_tune_fitted", "exp_robustness_fitted", "exp_multi_seed"])
def test_fitted_analyses_cover_all_models_and_corpora(spark, name, monkeypatch):
    from vigil.operators import models as ML
    from vigil.operators import features as X
    from vigil.plans import queries_models as Q

    small = (("tfidf", X.TfidfConfig(max_features=50, max_iter=2)), ("embed", ML.EmbedConfig(vector_size=4, buckets=64, steps=2, max_iter=2)), ("verifier", ML.VerifierConfig(buckets=256, max_iter=2)))
    monkeypatch.setattr(Q, "MODELS", small, raising=False)
    corpus = "train" if name == "exp_cross_dataset_fitted" else "dataset"
    rows = entry.queries()[name](spark, SF).collect()
    assert {(r["model"], r[corpus]) for r in rows} == {(m, d) for m in ("tfidf", "embed", "verifier") for d in ("A", "B")}
