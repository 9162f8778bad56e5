"""Experiments with fitted models: clean, split, fit, score, measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import clean_nonempty
from vigil.operators import metrics as M
from vigil.operators import sweeps as S
from vigil.operators.corpus import stratified_split
from vigil.operators.models import (
    EmbedConfig,
    EmbedModel,
    TfidfConfig,
    TfidfModel,
    VerifierConfig,
    VerifierModel,
    fit_embedding,
    fit_tfidf,
    fit_verifier,
    predictions,
)
from vigil.session import materialise, scratch_path

Model = TfidfModel | EmbedModel | VerifierModel
Trainer = Callable[[DataFrame], Model]

TRAINERS: dict[str, Callable[..., Model]] = {
    "tfidf": lambda train, cfg=None: fit_tfidf(train, cfg or TfidfConfig()),
    "embed": lambda train, cfg=None: fit_embedding(train, cfg or EmbedConfig()),
    "verifier": lambda train, cfg=None: fit_verifier(train, cfg or VerifierConfig()),
}


def prepare(corpus: DataFrame, salt: str = ":split") -> DataFrame:
    """Split, cleaned, non-empty corpus as a table in the shared folder.

    The split reads only keys and labels, so it comes first; the texts are cleaned
    once, on the way into the table. It is partitioned by split, so that each
    later step opens only the files of its split.
    """
    split = stratified_split(corpus, "doc_id", "label3", salt=salt)
    path = scratch_path(corpus.sparkSession, "prepared")
    clean_nonempty(split).write.partitionBy("split").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def part(prepared: DataFrame, split: str, label: str = "label") -> DataFrame:
    """One split with its label as ``y``."""
    return prepared.filter(F.col("split") == split).withColumn("y", F.col(label))


def fit(model_type: str, prepared: DataFrame, label: str = "label", cfg=None) -> Model:
    return TRAINERS[model_type](part(prepared, "train", label).select("doc_id", "text", "y"), cfg)


def in_domain(model_type: str, prepared: DataFrame, cfg=None) -> DataFrame:
    """Fit on train, score test, full binary metrics at 0.5."""
    model = fit(model_type, prepared, cfg=cfg)
    scores = model.score(part(prepared, "test"), keep=("y",))
    return M.evaluate(scores, [], "y").select(F.lit(model_type).alias("model"), "*")


def three_way(model_type: str, prepared: DataFrame, cfg=None) -> tuple[DataFrame, DataFrame]:
    """Fit on label3, argmax on test: per-class rows and summary."""
    model = fit(model_type, prepared, "label3", cfg)
    scored = predictions(model.score(part(prepared, "test", "label3"), keep=("y",)))
    # Read by the per-class rows and by the summary.
    rows = materialise(scored.select("y", "pred", F.lit(model_type).alias("model")), "scores")
    classwise = M.per_class(rows, ["model"], "y", "pred", 3)
    return classwise, M.multiclass_summary(classwise, ["model"])


def cascade_scores(
    prepared: DataFrame, t1: float = 0.2, stage1: str = "tfidf", stage2: str = "verifier", cfgs=(None, None)
) -> DataFrame:
    """Cheap model on every test row, expensive model on the routed rows only."""
    first, second = fit(stage1, prepared, cfg=cfgs[0]), fit(stage2, prepared, cfg=cfgs[1])
    test = prepared.filter(F.col("split") == "test").select("doc_id", "text", "label")

    def cheap(df: DataFrame) -> DataFrame:
        # Only routed rows take their text along into the stage-1 table.
        return first.score(df, keep=("text", "label")).withColumn("text", F.when(F.col("p_hate") >= t1, F.col("text")))

    return S.run_cascade(
        test,
        cheap,
        lambda df: second.score(df, keep=("text", "label", "p1")),
        t1,
        lambda df: materialise(df, "stage1"),
    ).drop("text")


def cascade_frontier(prepared: DataFrame, cfgs=(None, None)) -> DataFrame:
    """Score both stages once, sweep all thresholds over the scores."""
    first, second = fit("tfidf", prepared, cfg=cfgs[0]), fit("verifier", prepared, cfg=cfgs[1])
    test = prepared.filter(F.col("split") == "test")
    # Both models score in the row: one narrow pass, no join.
    p1 = first.score(test, keep=("label", "text")).withColumnRenamed("p_hate", "p1")
    both = second.score(p1, keep=("label", "p1")).withColumnRenamed("p_hate", "p2")
    return S.cascade_sweep(both.withColumn("model", F.lit("tfidf>verifier")), ["model"])


def group_audit(model_type: str, prepared: DataFrame, group: str, order: list[str], cfg=None) -> DataFrame:
    """Audit the test predictions of a fitted model by group."""
    model = fit(model_type, prepared, cfg=cfg)
    scored = predictions(model.score(part(prepared, "test"), keep=("label", group)))
    return M.group_audit(scored, group, order)
