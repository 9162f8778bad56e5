"""Classifiers: n-gram TF-IDF, hashed word embeddings, hashed character n-grams.

All share one contract: ``fit(train, ...)`` on (doc_id, text, y) returns a model
whose ``score(df)`` adds ``p_hate`` (two classes) or ``probabilities``, and which
can be saved and loaded.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: F401
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.numeric import argmax, decide, let
from vigil.operators import batched
from vigil.operators.characters import lists, over_buckets
from vigil.operators.characters import with_buckets as with_char_buckets
from vigil.operators.embedding import EmbedConfig, document_vectors, fit_words, with_buckets
from vigil.operators.features import TfidfConfig, vocabulary, with_tokens
from vigil.operators.features import idf as idf_of
from vigil.operators.grams import frequencies, weighted
from vigil.operators.metrics import evaluate
from vigil.session import materialise, scratch_path

# How a sparse vector is stored; used to read assembled structs back as vectors.
SPARSE = 0


def class_counts(train: DataFrame, label: str = "y") -> dict[int, int]:
    """Rows per class: one small row per class reaches the driver."""
    return {int(r[0]): int(r[1]) for r in train.groupBy(label).count().collect()}


def class_weight(counts: dict[int, int], label: str = "y") -> Column:
    """n / (K * n_class) as a constant expression per class."""
    n, k = sum(counts.values()), len(counts)
    table = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, n / (k * m))])
    return table[F.col(label)]


def fit_regression(
    features: DataFrame, counts: dict[int, int], c: float = 1.0, max_iter: int = 1000, balanced: bool = True
) -> LogisticRegressionModel:
    """L2 logistic regression on (features, y), with balanced class weights.

    The penalty C is on the summed loss while ``regParam`` is on the mean, and
    balanced weights sum to n; hence regParam = 1 / (C * n). Classes must be
    0..K-1.
    """
    n = sum(counts.values())
    # Features are a written table, so its scan has a task for each split of bytes.
    data = features.withColumn("_weight", class_weight(counts) if balanced else F.lit(1.0))
    lr = LogisticRegression(
        labelCol="y",
        weightCol="_weight",
        family="multinomial" if max(counts) > 1 else "binomial",
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-4,
    )
    return lr.fit(data)


# ------------------------------------------------------------------- TF-IDF
def constant_array(values: list[float]) -> Column:
    """Numbers of the model (at most ``max_features``) as one folded array constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


@dataclass
class TfidfModel:
    """Term counter, idf per term index, one coefficient row per margin."""

    cfg: TfidfConfig
    counter: CountVectorizerModel
    idf: list[float]
    coefficients: list[list[float]]
    intercepts: list[float]

    def counts(self, df: DataFrame, cols: list[str], text: str = "text") -> DataFrame:
        """cols + _i, _w: indices and unscaled TF-IDF weights of the known terms, in the row."""
        rows = df.select(*cols, F.col(text).alias("_text"))
        return term_weights(rows, self.counter, self.idf, self.cfg, cols, "_text")

    def score(self, df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """key, keep, p_hate (two classes) or probabilities (more).

        Narrow: no text leaves its task.
        """
        cols = [key, *keep]
        l2 = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, w: a + w * w))
        weighted = self.counts(df, cols, text).withColumn("_l2", l2)

        def margin(row: list[float], intercept: float) -> Column:
            beta = constant_array(row)
            products = F.zip_with("_i", "_w", lambda i, w: F.get(beta, i) * w)
            dot = F.aggregate(products, F.lit(0.0), lambda a, p: a + p)
            return F.coalesce(F.try_divide(dot, F.col("_l2")), F.lit(0.0)) + intercept

        margins = [margin(r, b) for r, b in zip(self.coefficients, self.intercepts)]
        return weighted.select(*cols, probability(margins))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.counter.write().save(f"{path}/counter")
        state = {"cfg": asdict(self.cfg), "intercepts": self.intercepts}
        state |= {"idf": self.idf, "coefficients": self.coefficients}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TfidfModel":
        state = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()[0])
        counter = CountVectorizerModel.load(f"{path}/counter")
        return cls(TfidfConfig(**state["cfg"]), counter, state["idf"], state["coefficients"], state["intercepts"])


def term_weights(
    df: DataFrame, counter: CountVectorizerModel, idf: list[float], cfg: TfidfConfig, cols: list[str], text: str
) -> DataFrame:
    """cols + _i (term indices) + _w (tf weight * idf), no shuffle; n-grams counted by slices of texts."""
    return weighted(with_tokens(df, text), counter.vocabulary, cfg, cols, idf)


def sparse_features(weights: DataFrame, size: int, cols: list[str]) -> DataFrame:
    """cols + ``features`` (L2-normalised sparse vectors), as a table in the shared folder.

    Training reads its features many times, so they are written once. The write
    also turns the arrays into ML vectors without a Python function: a vector
    column is stored as exactly this struct. A document without a known term is
    an all-zero vector.
    """
    spark = weights.sparkSession
    l2 = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, w: a + w * w))
    stored = weights.select(
        *cols,
        F.struct(
            F.lit(SPARSE).cast("byte").alias("type"),
            F.lit(size).alias("size"),
            F.col("_i").alias("indices"),
            let(l2, lambda n: F.transform("_w", lambda w: w / n)).alias("values"),
        ).alias("features"),
    )
    path = scratch_path(spark, "features")
    stored.write.parquet(path)
    schema = T.StructType([f for f in stored.schema.fields if f.name != "features"]).add("features", VectorUDT())
    return spark.read.schema(schema).parquet(path)


def probability(margins: list[Column]) -> Column:
    """Logistic function of one margin, or softmax over several."""
    if len(margins) == 1:
        return (1.0 / (1.0 + F.exp(-margins[0]))).alias("p_hate")
    top = F.greatest(*margins)
    parts = F.transform(F.array(*[m - top for m in margins]), lambda m: F.exp(m))
    whole = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p)
    return F.transform(parts, lambda p: p / whole).alias("probabilities")


def fit_tfidf(train: DataFrame, cfg: TfidfConfig = TfidfConfig(), key: str = "doc_id") -> TfidfModel:
    """Fit vocabulary, idf and regression on (key, text, y).

    The texts are cut into tokens once, on the way into a table that the vocabulary
    and the features both read. The vocabulary is chosen by our own aggregate, with
    a fixed order at the cut.
    """
    tokens = materialise(with_tokens(train.select(key, "y", "text")), "tokens")
    counted = frequencies(tokens.withColumn("bits", F.lit(1).cast("long")), cfg).withColumnsRenamed({"df0": "df", "cf0": "cf"})
    table = vocabulary(counted, cfg).withColumn("idf", idf_of(tokens.count(), F.col("df")))
    # At most max_features terms and numbers reach the driver: they are the model.
    terms = table.orderBy(F.col("cf").desc(), "term").select("term", "idf").collect()
    if not terms:
        raise ValueError("no term is frequent enough for a vocabulary")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in terms], inputCol="_grams", outputCol="_tf")
    idf = [float(r["idf"]) for r in terms]
    features = sparse_features(weighted(tokens, [r["term"] for r in terms], cfg, [key, "y"], idf), len(idf), [key, "y"])
    lr = fit_regression(features, class_counts(train), cfg.C, cfg.max_iter, cfg.balanced)
    return TfidfModel(
        cfg, counter, idf, lr.coefficientMatrix.toArray().tolist(), [float(b) for b in lr.interceptVector]
    )


# ------------------------------------------------- hashed character n-grams
@dataclass(frozen=True)
class VerifierConfig:
    sizes: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 18
    C: float = 1.0
    max_iter: int = 1000


@dataclass
class VerifierModel:
    """Hashed character n-grams (binary, rows of length 1), one coefficient row per margin."""

    cfg: VerifierConfig
    coefficients: np.ndarray
    intercepts: list[float]

    def score(self, df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """key, keep, p_hate (two classes) or probabilities (more). Narrow."""
        shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(self.coefficients))
        free, cols = np.array(self.intercepts), [key, *keep]
        taken = [f"_{i}" for i in range(len(cols))]
        rows = df.select(*[F.col(c).alias(t) for c, t in zip(cols, taken)], F.col(text).alias("_text"))

        def margins(i: np.ndarray, n: np.ndarray) -> pa.Array:
            owner, length = np.repeat(np.arange(len(n)), n), np.sqrt(np.maximum(n, 1))
            sums = [np.bincount(owner, weights=row[i], minlength=len(n)) / length for row in shared.value]
            return lists((np.stack(sums, axis=1) + free).ravel(), np.full(len(n), len(free)))

        found = over_buckets(rows, "_text", self.cfg.sizes, self.cfg.buckets, "array<double>", "_margins", margins)
        out = probability([F.get("_margins", k) for k in range(len(free))])
        return found.select(*[F.col(t).alias(c) for c, t in zip(cols, taken)], out)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        state = json.dumps({"cfg": asdict(self.cfg), "intercepts": self.intercepts})
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.text(f"{path}/state")
        rows = [(j, bytearray(np.ascontiguousarray(row).tobytes())) for j, row in enumerate(self.coefficients)]
        spark.createDataFrame(rows, "margin int, data binary").write.parquet(f"{path}/coefficients")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VerifierModel":
        state = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()[0])
        cfg = VerifierConfig(**{**state["cfg"], "sizes": tuple(state["cfg"]["sizes"])})
        rows = sorted(map(tuple, spark.read.parquet(f"{path}/coefficients").collect()))
        return cls(cfg, np.stack([np.frombuffer(bytes(d)) for _, d in rows]), state["intercepts"])


@dataclass
class EmbedModel:
    """Word vectors of hashed buckets (fixed number of rows), one coefficient row per margin."""

    cfg: EmbedConfig
    words: np.ndarray
    coefficients: list[list[float]]
    intercepts: list[float]

    def _folded(self, df: DataFrame, cols: list[str], text: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.words)
        taken = [f"_{i}" for i in range(len(cols))]
        rows = with_buckets(df.select(*[F.col(c).alias(t) for c, t in zip(cols, taken)], F.col(text).alias("_text")), self.cfg, "_text").drop("_text")
        return document_vectors(rows, shared, self.cfg).select(*[F.col(t).alias(c) for c, t in zip(cols, taken)], "vector")

    def score(self, df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """key, keep, p_hate (two classes) or probabilities (more). Narrow."""
        margins = [F.aggregate(F.zip_with("vector", constant_array(row), lambda a, b: a * b), F.lit(b), lambda a, p: a + p) for row, b in zip(self.coefficients, self.intercepts)]
        return self._folded(df, [key, *keep], text).select(key, *keep, probability(margins))

    def vectors(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, vector: the text folded in against the fitted word vectors."""
        return self._folded(df, [key], text)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        state = json.dumps({"cfg": asdict(self.cfg), "coefficients": self.coefficients, "intercepts": self.intercepts})
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.text(f"{path}/state")
        slices = [(j, bytearray(self.words[j : j + 512].tobytes())) for j in range(0, len(self.words), 512)]
        spark.createDataFrame(slices, "slice int, data binary").write.parquet(f"{path}/words")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "EmbedModel":
        state = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()[0])
        cfg = EmbedConfig(**state["cfg"])
        slices = sorted(map(tuple, spark.read.parquet(f"{path}/words").collect()))
        words = np.frombuffer(b"".join(bytes(d) for _, d in slices), dtype=np.float32).reshape(-1, cfg.vector_size)
        return cls(cfg, words, state["coefficients"], state["intercepts"])


def fit_embedding(train: DataFrame, cfg: EmbedConfig = EmbedConfig()) -> EmbedModel:
    """Word vectors by hashed co-occurrence, texts folded in, regression on (text, y).

    The driver holds ``buckets`` rows, whatever the vocabulary."""
    ids = materialise(with_buckets(train, cfg).select("y", "_ids"), "buckets")
    words = fit_words(ids, cfg)
    shared = train.sparkSession.sparkContext.broadcast(words)
    features = document_vectors(ids, shared, cfg).select("y", array_to_vector("vector").alias("features"))
    lr = fit_regression(materialise(features, "embed-features"), class_counts(train), cfg.C, cfg.max_iter)
    return EmbedModel(cfg, words, lr.coefficientMatrix.toArray().tolist(), [float(b) for b in lr.interceptVector])


def fit_verifier(train: DataFrame, cfg: VerifierConfig = VerifierConfig()) -> VerifierModel:
    """Hashed character n-grams of words (robust to spelling) + regression.

    Two classes are fitted by the batched solver, which takes far fewer passes than Spark's
    regression (README)."""
    rows = with_char_buckets(train.select("y", "text"), "text", cfg.sizes, cfg.buckets)
    counts = class_counts(train)
    if sorted(counts) == [0, 1]:
        ready = rows.select(F.lit(0).cast("long").alias("id"), "y", F.lit(1).cast("long").alias("bits"), "i")
        fitted = batched.fit(batched.blocks_of(ready, cfg.buckets, 1), cfg.C, cfg.max_iter)
        return VerifierModel(cfg, fitted.coefficients.T, [float(b) for b in fitted.intercepts])
    features = sparse_features(rows.select("y", F.col("i").alias("_i"), F.array_repeat(F.lit(1.0), F.size("i")).alias("_w")), cfg.buckets, ["y"])
    lr = fit_regression(features, counts, cfg.C, cfg.max_iter)
    return VerifierModel(cfg, lr.coefficientMatrix.toArray(), [float(b) for b in lr.interceptVector])


# ---------------------------------------------------------------- selection
def select_best(fits: dict[str, "TfidfModel | VerifierModel"], validation: DataFrame, label: str = "y") -> tuple[str, DataFrame]:
    """Name of the fitted model with the best macro F1 on validation, and the scores of all."""
    scored = None
    for name, model in fits.items():
        rows = model.score(validation, keep=(label,)).withColumn("model", F.lit(name))
        scored = rows if scored is None else scored.unionByName(rows)
    # A row per model: written, so that choosing and returning do not score twice.
    board = materialise(evaluate(scored, ["model"], truth=label).select("model", "f1_macro", "f1_binary", "roc_auc"), "board")
    return board.orderBy(F.col("f1_macro").desc(), "model").first()["model"], board


def predictions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``pred``: threshold for p_hate, first maximum for probabilities."""
    if "p_hate" in scored.columns:
        return scored.withColumn("pred", decide(F.col("p_hate"), threshold))
    return scored.withColumn("pred", argmax(F.col("probabilities")))

