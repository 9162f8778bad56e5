"""Prompts, answers, cache and budget."""

import hashlib
import json

from pyspark.sql import functions as F

from vigil.functions import responses as A
from vigil.operators import responses as R
from vigil.session import scratch_path
from vigil.sources import files as FS


def test_prompt_and_key(spark):
    df = spark.createDataFrame([('say "x"', [("bad", 1), ("fine", 0)])], "t string, e array<struct<text:string,label:int>>")
    r = df.select(A.prompt(F.col("t")).alias("zero"), A.prompt(F.col("t"), F.col("e")).alias("few")).first()
    assert r.zero == 'Comment: "say "x""\n\nJSON:'
    assert r.few == (
        "Here are some labelled examples for reference:\n"
        'Example 1: "bad"\nLabel: hate\nExample 2: "fine"\nLabel: non-hate\n'
        "\nNow classify the following comment.\n" + r.zero
    )
    key = df.select(A.cache_key("m", F.lit("p")).alias("k")).first().k
    assert key == hashlib.sha1(b"m\np").hexdigest()


def test_parse_answers(spark):
    cases = [
        ('{"label": "hate", "p_hate": 0.9}', 1, 0.9),
        ('```json\n{"label": "non-hate", "p_hate": 0.7}\n```', 0, 0.7),
        ('text {"label": " HATE ", "p_hate": "0.25"} more', 1, 0.25),
        ('{"label": "other", "p_hate": 0.5}', 1, 0.5),
        ('{"label": "other", "p_hate": 0.49}', 0, 0.49),
        ('{"p_hate": 3}', 1, 1.0),
        ('{"label": "hate", "p_hate": -2}', 1, 0.0),
        ('{"label": "hate"}', 1, 0.0),
        ('{"label": "hate", "p_hate": }', 0, 0.0),
        ("no json here", 0, 0.0),
        ("{'label': 'hate', 'p_hate': 1}", 0, 0.0),
        ('{"a": 1} and {"b": 2}', 0, 0.0),
        ("", 0, 0.0),
        ('{"label": null, "p_hate": true}', 1, 1.0),
        ('{"label": "hate", "p_hate": "high"}', 1, 0.0),
    ]
    df = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(cases)], "i int, raw string")
    out = df.select("i", A.parse_answer(F.col("raw")).alias("a")).orderBy("i").collect()
    for r, (raw, label, p) in zip(out, cases):
        assert (r.a.label, r.a.p_hate) == (label, p), raw


def test_quota_and_cost(spark):
    df = spark.createDataFrame([("Error 429",), ("RESOURCE_EXHAUSTED",), ("timeout",), (None,)], "e string")
    assert [r[0] for r in df.select(A.is_quota_error(F.col("e"))).collect()] == [True, True, False, False]
    r = df.limit(1).select(
        A.call_cost(F.lit("google/gemini-2.5-flash"), F.lit(2_000_000), F.lit(1_000_000)).alias("known"),
        A.call_cost(F.lit("none"), F.lit(10), F.lit(10)).alias("unknown"),
    ).first()
    assert abs(r.known - 0.45) < 1e-12 and r.unknown == 0.0


def _log(spark):
    rows = [(1, "a", 0.2, None), (2, "b", 0.9, None), (3, "a", 0.8, None), (4, "c", None, True), (5, "b", None, True)]
    # One key holds a third of all lines.
    rows += [(100 + i, "hot", i / 1000.0, None) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, key string, p_hate double, errored boolean")
    return df.select("seq", "key", F.struct("p_hate", "errored").alias("response"))


def test_cache_semantics(spark):
    entries = R.latest_entries(_log(spark))
    assert {r.key: r.response.p_hate for r in entries.collect()} == {"a": 0.8, "b": None, "c": None, "hot": 0.299}
    status = R.cache_status(entries).first()
    assert (status.n_ok, status.n_errored) == (2, 2)
    ask = spark.createDataFrame([(1, "a", "x" * 8), (2, "b", "y" * 4), (3, "new", "z" * 5), (4, "new", "z" * 5)], "id int, key string, prompt string")
    assert sorted(r.id for r in R.cache_misses(ask, entries).collect()) == [2, 3, 4]
    scores = {r.id: (r.p_hate, r.cached) for r in R.cached_scores(ask.drop("prompt"), entries).collect()}
    assert scores == {1: (0.8, True), 2: (0.0, False), 3: (0.0, False), 4: (0.0, False)}
    model = F.lit("google/gemini-2.5-flash")
    pre = R.preflight(ask, entries, model).first()
    assert (pre.n_total, pre.n_cached, pre.n_new, pre.verdict) == (4, 1, 3, "ok")
    # 14 characters are 3 tokens: truncated once, after the sum.
    assert abs(pre.est_usd - (3 / 1e6 * 0.075 + 150 / 1e6 * 0.3)) < 1e-15
    assert R.preflight(ask, entries, model, confirm=1e-9).first().verdict == "confirm"
    assert R.preflight(ask, entries, model, ceiling=1e-9).first().verdict == "abort"


def test_log_skips_broken_lines(spark):
    path = scratch_path(spark, "t-cache")
    lines = ['{"seq": 1, "key": "a", "response": {"p_hate": 0.5}}', "", "  ", '{"seq": 2, "key": "a", "resp', "[1]", '{"seq": 3, "key": "b"}']
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(path)
    assert [(r.seq, r.key) for r in FS.read_cache_log(spark, path).collect()] == [(1, "a")]


def test_log_without_numbers(spark, tmp_path):
    lines = [("a", 0.1), ("b", 0.2), ("a", 0.3), ("c", 0.4), ("a", 0.5), ("d", 0.6)]
    text = "".join(json.dumps({"key": k, "response": {"label": 1, "p_hate": p}}) + "\n" for k, p in lines)
    text += '{"key": "c", "response": null}\n\n{"key": "d"}\n{"key": "b", "resp\n'
    (tmp_path / "cache.jsonl").write_text(text)
    entries = R.latest_entries(FS.read_cache_log(spark, str(tmp_path)))
    assert {r.key: r.response and r.response.p_hate for r in entries.collect()} == {"a": 0.5, "b": 0.2, "c": None, "d": 0.6}
    ask = spark.createDataFrame([("a",), ("c",), ("x",)], "key string")
    assert {r.key: (r.p_hate, r.cached) for r in R.cached_scores(ask, entries).collect()} == {"a": (0.5, True), "c": (0.0, False), "x": (0.0, False)}
    assert sorted(r.key for r in R.cache_misses(ask, entries).collect()) == ["c", "x"]


def test_appends_number_their_lines(spark):
    path = scratch_path(spark, "t-append")
    row = "key string, response struct<p_hate:double,errored:boolean>"
    for p in (0.1, 0.2, 0.3):
        FS.append_cache(spark.createDataFrame([(k, (p, None)) for k in "abc"], row), path)
    log = FS.read_cache_log(spark, path)
    assert {r.key: r.response.p_hate for r in R.latest_entries(log).collect()} == {"a": 0.3, "b": 0.3, "c": 0.3}
    assert log.select("seq").distinct().count() == 9


def test_spend_stops_after_the_call_that_exceeds(spark):
    df = spark.createDataFrame([(i * 70000, 0.3) for i in range(10)], "seq long, cost_usd double")
    out = sorted((r.seq, round(r.spent_usd, 6), r.over_ceiling) for r in R.spend_until_ceiling(df, ceiling=1.0).collect())
    assert [o[0] for o in out] == [0, 70000, 140000, 210000] and out[-1][1:] == (1.2, True)
    assert R.spend_until_ceiling(df, ceiling=100.0).count() == 10
