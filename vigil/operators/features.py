"""Sparse text features in long form: vocabulary, idf, TF-IDF weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.tokens import ngrams, strip_accents, with_term_counts, word_tokens


@dataclass(frozen=True)
class TfidfConfig:
    ngram_min: int = 1
    ngram_max: int = 2
    max_features: int = 50_000
    min_df: int = 2
    sublinear_tf: bool = True
    C: float = 1.0
    max_iter: int = 1000
    balanced: bool = True


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``_tokens``: lower-cased, accent-free words."""
    return df.withColumn("_tokens", word_tokens(strip_accents(F.lower(text)))).drop(text)


def with_grams(df: DataFrame, cfg: TfidfConfig, text: str = "text") -> DataFrame:
    """Replace the text by ``_grams``: lower-cased, accent-free word n-grams."""
    tokens = with_tokens(df, text)
    return tokens.withColumn("_grams", ngrams(F.col("_tokens"), cfg.ngram_min, cfg.ngram_max)).drop("_tokens")


def with_terms(df: DataFrame, cfg: TfidfConfig, text: str = "text") -> DataFrame:
    """Replace the text by ``terms``: array of (term, tf), one row per document.

    Lower-casing, accent removal, tokens, n-grams and counts stay inside the row:
    no exchange happens before the vocabulary.
    """
    return with_term_counts(with_grams(df, cfg, text), "_grams").drop("_grams")


def exploded_terms(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep + term, tf.

    By the outer generator: for the inner one the optimizer infers a
    ``size(terms) > 0`` filter and moves it to the scan, which would tokenise
    every text again, once per element of the lambda functions.
    """
    return docs.select(*keep, F.inline_outer("terms")).filter(F.col("term").isNotNull())


def term_frequencies(docs: DataFrame) -> DataFrame:
    """term -> df, cf. A term occurs once per document row, so df is a plain count.

    The aggregate combines map-side: a stop word found in every document sends
    one row per task.
    """
    return (
        exploded_terms(docs, [])
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    )


def vocabulary(frequencies: DataFrame, cfg: TfidfConfig) -> DataFrame:
    """Terms with df >= min_df; the ``max_features`` most frequent, ties in term order.

    ``orderBy().limit()`` is a distributed top-k; no global window is needed.
    """
    kept = frequencies.filter(F.col("df") >= cfg.min_df)
    return kept.orderBy(F.col("cf").desc(), F.col("term")).limit(cfg.max_features)


def idf(n_docs: Column | int, df: Column) -> Column:
    """Smoothed inverse document frequency: ln((1 + n) / (1 + df)) + 1."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log((1 + n) / (1 + df)) + 1


def idf_table(docs: DataFrame, cfg: TfidfConfig) -> DataFrame:
    """term, df, cf, idf of the fitted vocabulary: at most ``max_features`` rows."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    return vocabulary(term_frequencies(docs), cfg).withColumn("idf", idf(n, F.col("df")))


def tf_weight(tf: Column, cfg: TfidfConfig) -> Column:
    return F.log(tf) + 1 if cfg.sublinear_tf else tf.cast("double")


def weighted_terms(docs: DataFrame, table: DataFrame, cfg: TfidfConfig, keep: list[str]) -> DataFrame:
    """keep + term columns of ``table`` + w = tf weight * idf; unknown terms vanish.

    ``table`` is broadcast: its size is bounded by ``max_features``. The join is
    narrow, so the terms of one document stay together in their task.
    """
    joined = exploded_terms(docs, keep).join(F.broadcast(table), "term")
    return joined.withColumn("w", tf_weight(F.col("tf"), cfg) * F.col("idf"))


def tfidf(docs: DataFrame, table: DataFrame, cfg: TfidfConfig, key: str = "doc_id") -> DataFrame:
    """Long form (key, term, tf, weight), L2-normalised per document."""
    w = weighted_terms(docs, table, cfg, [key])
    # One document per group: the list holds at most its distinct terms.
    rows = w.groupBy(key).agg(
        F.collect_list(F.struct("term", "tf", "w")).alias("_terms"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
    )
    return rows.select(key, "_norm", F.inline("_terms")).select(
        key, "term", "tf", (F.col("w") / F.col("_norm")).alias("weight")
    )
