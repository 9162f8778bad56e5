"""Corpus pipeline: from raw documents to token ids, five operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; :func:`run` writes every stage's rows as Parquet and reads them back for the
next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, decontaminate, near_dedup, substring_dedup, toxicity
from vigil.llm.frames import read
from vigil.llm.queries import vocabulary_path
from vigil.session import kept, scratch_path, scratch_scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by the cut of their language go."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (words in fives, similarity 0.8) the smallest id stays."""
    return near_dedup.dedup(docs, size=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut from the text."""
    return substring_dedup.dedup(docs)


def cut_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut; documents made of them go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with the digests of the ids and of the decoded text."""
    coded = bpe.encode(docs, vocabulary_path())
    made = coded.columns[-1]
    fields = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return coded.select("doc_id", "text", "lang", "source", *[F.col(f"{made}.{f}").alias(f) for f in fields])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", cut_test_passages),
    ("bpe", encode),
]

#: A trained classifier and a vocabulary's merges have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            docs = kept(stage(spark, docs, sf_dir), path)
    return docs
