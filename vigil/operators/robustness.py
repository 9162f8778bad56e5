"""Experiments on given scores: variants side by side, transfer between corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.obfuscate import obfuscate_text
from vigil.functions.text import clean_text
from vigil.operators.metrics import evaluate


def robustness(df: DataFrame, by: list[str], clean: str, obfuscated: str, truth: str = "label") -> DataFrame:
    """Metrics of both score columns and obfuscated minus clean; a null AUC counts as 0.

    Each row carries both scores, so one aggregate sees the two variants at once;
    the result rows are folded by a conditional aggregate instead of a self join.
    """
    both = F.array(
        F.struct(F.lit("clean").alias("variant"), F.col(clean).alias("p")),
        F.struct(F.lit("obfuscated").alias("variant"), F.col(obfuscated).alias("p")),
    )
    long = df.select(*by, F.col(truth).alias("label"), F.inline(both))
    m = evaluate(long, [*by, "variant"], "label", "p")

    def of(variant: str, c: str):
        return F.max(F.when(F.col("variant") == variant, F.col(c)))

    wide = m.groupBy(*by).agg(
        *[
            of(v, c).alias(f"{short}_{v}")
            for v in ("clean", "obfuscated")
            for short, c in (("f1", "f1_binary"), ("macro", "f1_macro"), ("auc", "roc_auc"))
        ]
    )
    zero = F.lit(0.0)
    return wide.withColumns(
        {
            "delta_f1_hate": F.col("f1_obfuscated") - F.col("f1_clean"),
            "delta_f1_macro": F.col("macro_obfuscated") - F.col("macro_clean"),
            "delta_auc": F.coalesce("auc_obfuscated", zero) - F.coalesce("auc_clean", zero),
        }
    )


def pairs(datasets: list[str]) -> list[tuple[str, str]]:
    """Ordered (train, eval) pairs of different corpora."""
    return [(a, b) for a in datasets for b in datasets if a != b]


def cross_dataset(scores: DataFrame, truth: str = "label", score: str = "p") -> DataFrame:
    """Metrics per (model, train, eval) and the change of macro F1 against in-domain.

    ``scores`` holds test rows of every evaluated pair, in-domain ones included.
    """
    m = evaluate(scores, ["model", "train", "eval"], truth, score)
    home = m.filter(F.col("train") == F.col("eval")).select(
        "model", "train", F.col("f1_macro").alias("f1_macro_in_domain")
    )
    away = m.filter(F.col("train") != F.col("eval"))
    # Both sides have one row per model and pair of corpora.
    return away.join(home, ["model", "train"], "left").withColumn(
        "delta_f1_macro", F.col("f1_macro") - F.col("f1_macro_in_domain")
    )


def first_examples(df: DataFrame, text: str = "text", n: int = 5, width: int = 120) -> DataFrame:
    """The first n texts in key order, cleaned and obfuscated, shortened for display.

    The rows are picked before the text work: a distributed top-n on the key.
    """
    first = df.select("doc_id", text).orderBy("doc_id").limit(n).select("doc_id", clean_text(F.col(text)).alias("clean"))
    both = first.withColumn("obfuscated", obfuscate_text(F.col("clean"), F.col("doc_id")))
    return both.select("doc_id", *[F.substring(c, 1, width).alias(c) for c in ("clean", "obfuscated")])
