"""Jobs over cached model answers: hits and misses, estimates, spend, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.responses import call_cost
from vigil.operators.ranking import sum_before

# Budget limits in USD and the token estimate per answer.
CEILING_USD = 1.0
CONFIRM_USD = 0.20
OUTPUT_TOKENS = 50
CHARS_PER_TOKEN = 4.0


def latest_entries(log: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Newest line per key, with all or only the named response fields.

    ``max_by`` combines before the exchange, so a key with very many lines sends
    one row per task; a window would bring all its lines to one task. Lines without
    a number come before numbered ones, in the order of their place in the files.
    A null response wins like any other.
    """
    response = F.col("response") if fields is None else F.struct(*[F.col(f"response.{f}") for f in fields])
    kept = F.when(F.col("response").isNotNull(), response)
    order = F.struct(F.coalesce("seq", F.lit(-1).cast("long")), *(["at"] if "at" in log.columns else []))
    slim = log.select("key", "seq", order.alias("order"), F.struct(kept.alias("response")).alias("held"))
    newest = slim.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("held", "order").alias("held"))
    return newest.select("key", "seq", "held.response")


def usable(entries: DataFrame) -> DataFrame:
    """Entries that count as hits: errored ones and those without an answer are tried again."""
    return entries.filter(F.col("response").isNotNull() & ~F.coalesce(F.col("response.errored"), F.lit(False)))


def cache_status(entries: DataFrame) -> DataFrame:
    errored = F.coalesce(F.col("response.errored"), F.lit(False))
    return entries.agg(F.count_if(~errored).alias("n_ok"), F.count_if(errored).alias("n_errored"))


def cache_misses(prompts: DataFrame, entries: DataFrame) -> DataFrame:
    return prompts.join(usable(entries).select("key"), "key", "left_anti")


def cached_scores(prompts: DataFrame, entries: DataFrame) -> DataFrame:
    """Every prompt with its cached score; 0.0 (a negative) where there is none.

    Pass ``prompts`` without the text columns: the rows are shuffled by key.
    """
    hits = usable(entries).select("key", F.col("response.p_hate").alias("_p"), F.lit(True).alias("_hit"))
    return (
        prompts.join(hits, "key", "left")
        .withColumns({"p_hate": F.coalesce("_p", F.lit(0.0)), "cached": F.coalesce("_hit", F.lit(False))})
        .drop("_p", "_hit")
    )


def estimate_cost(prompts: DataFrame, model: Column, output_tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """n_new, est_input_tokens, est_output_tokens, est_usd of sending all prompts.

    Characters are summed first and the token count is truncated once.
    """
    sums = prompts.agg(
        F.count(F.lit(1)).alias("n_new"), F.coalesce(F.sum(F.length("prompt").cast("long")), F.lit(0)).alias("_chars")
    )
    tokens_in = F.col("_chars") / CHARS_PER_TOKEN
    tokens_out = F.col("n_new") * output_tokens
    return sums.select(
        "n_new",
        tokens_in.alias("est_input_tokens"),
        tokens_out.cast("double").alias("est_output_tokens"),
        call_cost(model, F.floor(tokens_in), tokens_out).alias("est_usd"),
    )


def preflight(
    prompts: DataFrame, entries: DataFrame, model: Column, ceiling: float = CEILING_USD, confirm: float = CONFIRM_USD
) -> DataFrame:
    """n_total, n_cached, n_new, est_usd and the verdict abort / confirm / ok.

    Prompts collapse to (key, copies, characters) before anything is shuffled: no
    text crosses the network, and a prompt with very many copies is one row. Hits
    are flagged by a left join, so one pass gives both counts.
    """
    length = F.length("prompt").cast("long")
    keys = prompts.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_len"))
    flagged = keys.join(usable(entries).select("key", F.lit(True).alias("_hit")), "key", "left")
    new = F.col("_hit").isNull()

    def total(c: str, condition: Column | None = None) -> Column:
        return F.coalesce(F.sum(c if condition is None else F.when(condition, F.col(c))), F.lit(0).cast("long"))

    sums = flagged.agg(
        total("_n").alias("n_total"),
        total("_n", ~new).alias("n_cached"),
        total("_n", new).alias("n_new"),
        total("_len", new).alias("_chars"),
    )
    est = call_cost(model, F.floor(F.col("_chars") / CHARS_PER_TOKEN), F.col("n_new") * OUTPUT_TOKENS)
    out = sums.select("n_total", "n_cached", "n_new", est.alias("est_usd"))
    usd = F.col("est_usd")
    return out.withColumn(
        "verdict", F.when(usd > ceiling, "abort").when(usd > confirm, "confirm").otherwise("ok")
    )


def spend_total(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and USD per group, cached and new calls apart."""
    new = ~F.col("cached")
    return calls.groupBy(*by).agg(
        F.count_if("cached").alias("n_cached"),
        F.count_if(new).alias("n_new"),
        F.coalesce(F.sum(F.when(new, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(new, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.when(new, F.col("cost_usd"))), F.lit(0.0)).alias("spent_usd"),
    )


def spend_until_ceiling(calls: DataFrame, seq: str = "seq", cost: str = "cost_usd", ceiling: float = CEILING_USD) -> DataFrame:
    """Running spend in call order, up to and with the call that exceeds the ceiling.

    A call is made when the spend before it is within the ceiling. Costs are not
    negative, so that alone says which calls are made: later ones are not in the
    result, and no second pass has to look for the stop.
    """
    before = sum_before(calls, seq, cost, "_before").filter(F.col("_before") <= ceiling)
    spent = before.withColumn("spent_usd", F.col("_before") + F.col(cost)).drop("_before")
    return spent.withColumn("over_ceiling", F.col("spent_usd") > ceiling)
