"""Prompts, cache keys, answers and prices of scored comments, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD per million tokens, quota phrases, prompt wording.
PRICES = {
    "google/gemini-2.5-flash": (0.075, 0.30),
    "google/gemini-2.5-flash-lite": (0.025, 0.10),
    "google/gemini-2.5-pro": (1.25, 5.00),
    "anthropic/claude-3.5-haiku": (0.80, 4.00),
    "anthropic/claude-haiku-4.5": (1.00, 5.00),
    "anthropic/claude-sonnet-4.5": (3.00, 15.00),
    "meta-llama/llama-3.3-70b-instruct": (0.13, 0.40),
    "meta-llama/llama-3.1-8b-instruct": (0.03, 0.06),
    "deepseek/deepseek-chat": (0.14, 0.28),
    "qwen/qwen-2.5-72b-instruct": (0.35, 0.40),
}
QUOTA = "429|resource_exhausted|quota|rate limit|rate_limit"
EXAMPLES_HEAD = "Here are some labelled examples for reference:\n"
EXAMPLES_TAIL = "\nNow classify the following comment.\n"


def prompt(text: Column, examples: Column | None = None) -> Column:
    """User prompt; ``examples`` is an ordered array of (text, label) structs."""
    question = F.concat(F.lit('Comment: "'), text, F.lit('"\n\nJSON:'))
    if examples is None:
        return question
    lines = F.transform(
        examples,
        lambda e, i: F.concat(
            F.lit("Example "),
            (i + 1).cast("string"),
            F.lit(': "'),
            e["text"],
            F.lit('"\nLabel: '),
            F.when(e["label"] == 1, "hate").otherwise("non-hate"),
            F.lit("\n"),
        ),
    )
    shots = F.concat(F.lit(EXAMPLES_HEAD), F.array_join(lines, ""), F.lit(EXAMPLES_TAIL))
    return F.when(F.size(examples) > 0, F.concat(shots, question)).otherwise(question)


def cache_key(model: Column | str, text: Column) -> Column:
    name = model if isinstance(model, Column) else F.lit(model)
    return F.sha1(F.concat(name, F.lit("\n"), text))


def parse_answer(raw: Column) -> Column:
    """struct(label, p_hate) of a model answer.

    The JSON object is what lies between the first ``{`` and the last ``}``; code
    fences around it do not matter. Text that is no JSON object gives (0, 0.0).
    A probability that is no number counts as 0 and is clipped to [0, 1]; an
    unknown label falls back to p >= 0.5.
    """
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    obj = F.try_parse_json(F.when(body == "", None).otherwise(body))
    label = F.lower(F.trim(F.coalesce(F.try_variant_get(obj, "$.label", "string"), F.lit(""))))
    p = F.coalesce(
        F.try_variant_get(obj, "$.p_hate", "double"),
        F.try_variant_get(obj, "$.p_hate", "boolean").cast("double"),
        F.lit(0.0),
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    hate = F.when(label == "hate", 1).when(label == "non-hate", 0).otherwise((clipped >= 0.5).cast("int"))
    broken = obj.isNull()
    return F.struct(
        F.when(broken, 0).otherwise(hate).cast("int").alias("label"),
        F.when(broken, 0.0).otherwise(clipped).alias("p_hate"),
    )


def is_quota_error(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike(QUOTA), F.lit(False))


def price(model: Column, side: int) -> Column:
    """USD per million input (0) or output (1) tokens; 0 for an unknown model."""
    table = F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, float(p[side]))])
    return F.coalesce(table[model], F.lit(0.0))


def call_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens / F.lit(1e6) * price(model, 0) + output_tokens / F.lit(1e6) * price(model, 1)
