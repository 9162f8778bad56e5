"""Registered queries: prompts, cached answers, costs, timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import responses as A
from vigil.operators import corpus as C
from vigil.operators import metrics as M
from vigil.operators import report as P
from vigil.operators import responses as R
from vigil.operators import timing as L
from vigil.plans import sql as Q
from vigil.plans import tables as T
from vigil.plans.queries_corpus import _SHOTS
from vigil.plans.registry import query
from vigil.plans.rounding import rounded

CACHE = T.CACHE


# ------------------------------------------------------------------- prompts
@query(
    "llm_prompt",
    f"""WITH {T.CORPUS}, {_SHOTS}, head AS (
          SELECT 'Here are some labelled examples for reference:' || chr(10) ||
                 string_agg('Example ' || position || ': "' || text || '"' || chr(10) || 'Label: ' ||
                            CASE label WHEN 1 THEN 'hate' ELSE 'non-hate' END || chr(10), '' ORDER BY position) ||
                 chr(10) || 'Now classify the following comment.' || chr(10) AS shots FROM examples)
        SELECT doc_id, 'Comment: "' || text || '"' || chr(10) || chr(10) || 'JSON:' AS zero_shot,
               md5(shots || 'Comment: "' || text || '"' || chr(10) || chr(10) || 'JSON:') AS few_shot_md5
        FROM documents, head""",
)
def llm_prompt(spark, sf_dir):
    """Zero-shot prompt, and the digest of the few-shot prompt with four exemplars.

    The exemplars are one array of k entries, read by a scalar subquery.
    """
    shots = C.fewshot_examples(T.corpus(spark, sf_dir)).select("position", "text", "label")
    ordered = F.sort_array(F.collect_list(F.struct("position", "text", "label")))
    examples = shots.agg(F.transform(ordered, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"))))
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_shots", examples.scalar())
    return docs.select(
        "doc_id",
        A.prompt(F.col("text")).alias("zero_shot"),
        F.md5(A.prompt(F.col("text"), F.col("_shots"))).alias("few_shot_md5"),
    )


@query("llm_key", f"WITH {T.PROMPTS} SELECT doc_id, key FROM prompts")
def llm_key(spark, sf_dir):
    return T.prompts(spark, sf_dir).select("doc_id", "key")


_PARSED = r"""bodies AS (SELECT *, regexp_extract(raw, '(?s)\{.*\}') AS body FROM log WHERE raw IS NOT NULL),
fields AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN body::JSON END AS obj FROM bodies),
vals AS (SELECT *, lower(trim(coalesce(obj ->> '$.label', ''))) AS answer,
                greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast(obj ->> '$.p_hate' AS DOUBLE), 0.0))) AS p FROM fields),
parsed AS (SELECT doc_id, seq, CASE WHEN obj IS NULL THEN 0 WHEN answer = 'hate' THEN 1 WHEN answer = 'non-hate' THEN 0
                  WHEN p >= 0.5 THEN 1 ELSE 0 END AS label, CASE WHEN obj IS NULL THEN 0.0::DOUBLE ELSE p END AS p_hate FROM vals)"""


@query("llm_parse", f"WITH {CACHE}, {_PARSED} SELECT doc_id, seq, label, p_hate FROM parsed")
def llm_parse(spark, sf_dir):
    raw = F.col("response.raw")
    log = T.cache_log(spark, sf_dir).filter(raw.isNotNull())
    return log.select("doc_id", "seq", A.parse_answer(raw).alias("a")).select("doc_id", "seq", "a.*")


@query(
    "llm_quota_flag",
    f"WITH {CACHE} SELECT doc_id, seq, error, regexp_matches(lower(error), '{A.QUOTA}') AS quota FROM log WHERE errored",
)
def llm_quota_flag(spark, sf_dir):
    error = F.col("response.error")
    log = T.cache_log(spark, sf_dir).filter(F.col("response.errored"))
    return log.select("doc_id", "seq", error.alias("error"), A.is_quota_error(error).alias("quota"))


_MODEL_OF = "['google/gemini-2.5-flash', 'deepseek/deepseek-chat', 'unlisted/model'][(doc_id % 3 + 1)::INTEGER]"


@query(
    "llm_call_cost",
    f"""WITH {CACHE}, m AS (SELECT *, {_MODEL_OF} AS model FROM log WHERE input_tokens IS NOT NULL)
        SELECT doc_id, seq, model, round(CASE model WHEN 'google/gemini-2.5-flash' THEN input_tokens / 1e6::DOUBLE * 0.075::DOUBLE + output_tokens / 1e6::DOUBLE * 0.3::DOUBLE
          WHEN 'deepseek/deepseek-chat' THEN input_tokens / 1e6::DOUBLE * 0.14::DOUBLE + output_tokens / 1e6::DOUBLE * 0.28::DOUBLE ELSE 0.0 END, 12) AS cost_usd FROM m""",
)
def llm_call_cost(spark, sf_dir):
    names = F.array(F.lit("google/gemini-2.5-flash"), F.lit("deepseek/deepseek-chat"), F.lit("unlisted/model"))
    log = T.cache_log(spark, sf_dir).filter(F.col("response.input_tokens").isNotNull())
    model = F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int"))
    cost = A.call_cost(F.col("model"), F.col("response.input_tokens"), F.col("response.output_tokens"))
    return log.withColumn("model", model).select("doc_id", "seq", "model", F.round(cost, 12).alias("cost_usd"))


# --------------------------------------------------------------------- cache
def entries(spark, sf_dir, *fields):
    return R.latest_entries(T.cache_log(spark, sf_dir), list(fields) or None)


@query("win_last_per_key", f"WITH {CACHE} SELECT key, seq, p_hate, coalesce(errored, false) AS errored FROM entries")
def win_last_per_key(spark, sf_dir):
    e = entries(spark, sf_dir, "p_hate", "errored")
    return e.select("key", "seq", "response.p_hate", F.coalesce("response.errored", F.lit(False)).alias("errored"))


@query(
    "agg_cache_status",
    f"WITH {CACHE} SELECT count(*) FILTER (NOT errored) AS n_ok, count(*) FILTER (errored) AS n_errored FROM entries",
)
def agg_cache_status(spark, sf_dir):
    return R.cache_status(entries(spark, sf_dir, "errored"))


_MISSES = "misses AS (SELECT * FROM prompts WHERE key NOT IN (SELECT key FROM entries WHERE NOT errored))"


@query("join_anti_cache_miss", f"WITH {CACHE}, {_MISSES} SELECT doc_id, key FROM misses")
def join_anti_cache_miss(spark, sf_dir):
    ask = T.prompts(spark, sf_dir).select("doc_id", "key")
    return R.cache_misses(ask, entries(spark, sf_dir, "errored")).select("doc_id", "key")


_HITS = """hits AS (SELECT p.doc_id, p.lang, p.label, coalesce(e.p_hate, 0.0) AS p_hate, e.key IS NOT NULL AS cached
  FROM prompts p LEFT JOIN (SELECT key, p_hate FROM entries WHERE NOT errored) e USING (key))"""


def hits(spark, sf_dir):
    ask = T.prompts(spark, sf_dir).select("doc_id", "lang", "label", "key")
    return R.cached_scores(ask, entries(spark, sf_dir, "p_hate", "errored"))


@query("join_left_cache", f"WITH {CACHE}, {_HITS} SELECT doc_id, p_hate, cached FROM hits")
def join_left_cache(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", "p_hate", "cached")


@query(
    "llm_eval",
    f"WITH {CACHE}, {_HITS}, {Q.evaluated('e', 'hits', ['lang'], 'label', 'p_hate')} SELECT lang, tn, fp, fn, tp, {Q.rounded(Q.RATES)} FROM e",
)
def llm_eval(spark, sf_dir):
    return rounded(M.evaluate(hits(spark, sf_dir), ["lang"]))


# --------------------------------------------------------------------- costs
_EST = "floor(sum(length(prompt)) / 4.0)::BIGINT / 1e6::DOUBLE * 0.075::DOUBLE + count(*) * 50 / 1e6::DOUBLE * 0.3::DOUBLE"


@query(
    "agg_cost_estimate",
    f"WITH {T.PROMPTS} SELECT count(*) AS n_new, round(sum(length(prompt)) / 4.0::DOUBLE, 6) AS est_input_tokens, (count(*) * 50)::DOUBLE AS est_output_tokens, round({_EST}, 9) AS est_usd FROM prompts",
)
def agg_cost_estimate(spark, sf_dir):
    return rounded(R.estimate_cost(T.prompts(spark, sf_dir), F.lit(T.MODEL)))


@query(
    "llm_preflight",
    f"""WITH {CACHE}, {_MISSES}, e AS (SELECT count(*) AS n_new, {_EST} AS est_usd FROM misses)
        SELECT (SELECT count(*) FROM prompts) AS n_total, (SELECT count(*) FROM prompts) - n_new AS n_cached, n_new,
               round(est_usd, 9) AS est_usd, CASE WHEN est_usd > 1.0 THEN 'abort' WHEN est_usd > 0.01 THEN 'confirm' ELSE 'ok' END AS verdict FROM e""",
)
def llm_preflight(spark, sf_dir):
    ask = T.prompts(spark, sf_dir).select("key", "prompt")
    return rounded(R.preflight(ask, entries(spark, sf_dir, "errored"), F.lit(T.MODEL), confirm=0.01))


_CALLS = """calls AS (SELECT seq, doc_id, error IS NULL AND seq % 3 = 0 AS cached, coalesce(input_tokens, 0) AS input_tokens,
  coalesce(output_tokens, 0) AS output_tokens, coalesce(cost_usd, 0.0) AS cost_usd FROM log)"""


def calls(spark, sf_dir):
    r = F.col("response")
    return T.cache_log(spark, sf_dir).select(
        "seq",
        "doc_id",
        (r["error"].isNull() & (F.col("seq") % 3 == 0)).alias("cached"),
        F.coalesce(r["input_tokens"], F.lit(0)).alias("input_tokens"),
        F.coalesce(r["output_tokens"], F.lit(0)).alias("output_tokens"),
        F.coalesce(r["cost_usd"], F.lit(0.0)).alias("cost_usd"),
    )


@query(
    "agg_spend_total",
    f"""WITH {CACHE}, {_CALLS} SELECT '{T.MODEL}' AS model, count(*) FILTER (cached) AS n_cached, count(*) FILTER (NOT cached) AS n_new,
        coalesce(sum(input_tokens) FILTER (NOT cached), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens) FILTER (NOT cached), 0)::BIGINT AS output_tokens,
        round(coalesce(sum(cost_usd) FILTER (NOT cached), 0.0), 9) AS spent_usd FROM calls""",
)
def agg_spend_total(spark, sf_dir):
    return rounded(R.spend_total(calls(spark, sf_dir).withColumn("model", F.lit(T.MODEL)), ["model"]))


_CEILING = 0.02


@query(
    "win_spend_ceiling",
    f"""WITH {CACHE}, {_CALLS}, run AS (SELECT seq, cost_usd, sum(cost_usd) OVER (ORDER BY seq) AS spent_usd FROM calls WHERE NOT cached),
        stop AS (SELECT min(seq) AS s FROM run WHERE spent_usd > {_CEILING}::DOUBLE)
        SELECT seq, round(cost_usd, 9) AS cost_usd, round(spent_usd, 9) AS spent_usd, spent_usd > {_CEILING}::DOUBLE AS over_ceiling
        FROM run, stop WHERE s IS NULL OR seq <= s""",
)
def win_spend_ceiling(spark, sf_dir):
    new = calls(spark, sf_dir).filter(~F.col("cached")).select("seq", "cost_usd")
    return rounded(R.spend_until_ceiling(new, ceiling=_CEILING))


# -------------------------------------------------------------------- timing
LATENCY_SQL = f"""{T.TIMINGS}, o AS (
  SELECT run, ms, row_number() OVER (PARTITION BY run ORDER BY ms) AS rn, count(*) OVER (PARTITION BY run) AS n FROM timings),
c AS (SELECT run, any_value(n) AS n, median(ms) AS med, min(ms) AS lo, max(ms) AS hi,
      max(ms) FILTER (rn = least(greatest((n + 1) // 20, 1), n - 1)) AS a1, max(ms) FILTER (rn = least(greatest((n + 1) // 20, 1), n - 1) + 1) AS a2,
      max(ms) FILTER (rn = least(greatest(19 * (n + 1) // 20, 1), n - 1)) AS b1, max(ms) FILTER (rn = least(greatest(19 * (n + 1) // 20, 1), n - 1) + 1) AS b2
      FROM o GROUP BY run),
latency AS (SELECT run, n, med AS latency_ms_median,
  CASE WHEN n < 20 THEN lo ELSE (a1 * (20 - ((n + 1) - 20 * least(greatest((n + 1) // 20, 1), n - 1))) + a2 * ((n + 1) - 20 * least(greatest((n + 1) // 20, 1), n - 1))) / 20 END AS latency_ms_p05,
  CASE WHEN n < 20 THEN hi ELSE (b1 * (20 - (19 * (n + 1) - 20 * least(greatest(19 * (n + 1) // 20, 1), n - 1))) + b2 * (19 * (n + 1) - 20 * least(greatest(19 * (n + 1) // 20, 1), n - 1))) / 20 END AS latency_ms_p95
  FROM c)"""
_LATENCY_COLS = ["latency_ms_median", "latency_ms_p05", "latency_ms_p95"]


@query("agg_latency_summary", f"WITH {LATENCY_SQL} SELECT run, n, {Q.rounded(_LATENCY_COLS)} FROM latency")
def agg_latency_summary(spark, sf_dir):
    return rounded(L.latency_summary(T.timings(spark, sf_dir)))


THROUGHPUT_SQL = f"""{T.TIMINGS}, r AS (SELECT run, ms, row_number() OVER (PARTITION BY run ORDER BY seq) AS rn FROM timings),
b AS (SELECT run, (rn - 1) // 32 AS batch, count(*) AS n, sum(ms) AS ms FROM r WHERE rn <= 192 GROUP BY ALL HAVING count(*) = 32),
speed AS (SELECT run, sum(n)::BIGINT AS n_samples, count(*) AS n_batches, sum(n)::DOUBLE / (sum(ms) / 1000.0::DOUBLE) AS throughput_samples_per_sec FROM b GROUP BY run)"""


@query(
    "agg_throughput",
    f"WITH {THROUGHPUT_SQL} SELECT run, n_samples, n_batches, round(throughput_samples_per_sec, 6) AS throughput_samples_per_sec FROM speed",
)
def agg_throughput(spark, sf_dir):
    return rounded(L.throughput(T.timings(spark, sf_dir)), 6)


@query(
    "rep_cost",
    f"""WITH {LATENCY_SQL}, {THROUGHPUT_SQL.removeprefix(T.TIMINGS + ', ')}, dims AS (SELECT unnest(['view', 'click', 'error', 'purchase', 'signup', 'refund']) AS run)
        SELECT run, coalesce(printf('%.2f', latency_ms_median), '—') AS p50_ms,
               coalesce(printf('%.2f', latency_ms_p05), '—') || ' / ' || coalesce(printf('%.2f', latency_ms_p95), '—') AS p05_p95_ms,
               coalesce(printf('%.1f', throughput_samples_per_sec), '—') AS throughput
        FROM dims LEFT JOIN latency USING (run) LEFT JOIN speed USING (run)""",
)
def rep_cost(spark, sf_dir):
    t = T.timings(spark, sf_dir)
    runs = ["view", "click", "error", "purchase", "signup", "refund"]
    return P.cost_table(L.latency_summary(t), L.throughput(t), runs)
