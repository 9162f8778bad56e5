"""Word and document vectors by hashed co-occurrence counts and a random projection.

Words are hashed to a fixed number of buckets. The context of a word is the sum of the
signed random vectors of its neighbours, frequent ones counting less; one pass adds the
contexts up per bucket (map-side in numpy, then by slices), which is the projected
co-occurrence matrix. It is centred and whitened by its own covariance (dimension x
dimension). No step holds a vocabulary: the model has ``buckets`` rows at any size of the
corpus, and so has a proven bound for its broadcast.

A document's vector is folded in against the frozen word vectors: ``steps`` gradient steps
on the squared distance of its words' products from one, in batches of texts. Texts of
the corpus and unseen ones are treated alike.

Defined cases: null and empty texts, and texts whose words are all rarer than
``min_count``, have zero vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.tokens import whitespace_tokens

SLICE = 512
#: Tokens that are worked on at a time, and repeats of a word among them that are added one by one.
PIECE = 1024
TURNS = 8


@dataclass(frozen=True)
class EmbedConfig:
    vector_size: int = 200
    window: int = 5
    min_count: int = 2
    buckets: int = 1 << 15
    #: Share of all tokens above which a context word counts less.
    frequent: float = 1e-3
    #: Gradient steps of the folding-in, and the weight of the vector's own length.
    steps: int = 20
    ridge: float = 0.1
    seed: int = 42
    C: float = 1.0
    max_iter: int = 1000


def with_buckets(df: DataFrame, cfg: EmbedConfig, text: str = "text", name: str = "_ids") -> DataFrame:
    """``df`` with the bucket of every word of ``text``."""
    tokens = whitespace_tokens(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(name, F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(cfg.buckets)).cast("int")))


def _signs(cfg: EmbedConfig) -> np.ndarray:
    return np.random.default_rng(cfg.seed).choice(np.array([-1, 1], dtype=np.float32), (cfg.buckets, cfg.vector_size))


def contexts(ids: np.ndarray, signs: np.ndarray, window: int) -> np.ndarray:
    """For each token the sum of the vectors of its neighbours within ``window``."""
    padded = np.zeros((len(ids) + 2 * window, signs.shape[1]), dtype=np.float32)
    padded[window : window + len(ids)] = signs[ids]
    total = np.zeros((len(ids), signs.shape[1]), dtype=np.float32)
    for shift in range(2 * window + 1):
        if shift != window:
            total += padded[shift : shift + len(ids)]
    return total


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each of ``rows`` to the row ``at`` of ``total``; numbers in ``at`` may repeat."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    turn = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    # The n-th rows of all numbers differ in their number; numbers of many rows are summed.
    for n in range(TURNS):
        own = order[turn == n]
        if not len(own):
            return
        total[at[own]] += rows[own]
    rest = order[turn >= TURNS]
    if len(rest):
        begin = np.flatnonzero(np.diff(at[rest], prepend=-1))
        total[at[rest][begin]] += np.add.reduceat(rows[rest], begin, axis=0)


def fit_words(rows: DataFrame, cfg: EmbedConfig) -> np.ndarray:
    """Vectors of the buckets (float32, unit length or zero) from ``rows`` with ``_ids``."""
    spark = rows.sparkSession
    # Every task sends ``buckets`` rows: there are no more tasks than cores.
    ids = rows.select("_ids").coalesce(spark.sparkContext.defaultParallelism)

    def count(batches):
        found = np.zeros(cfg.buckets, dtype=np.int64)
        for batch in batches:
            found += np.bincount(np.asarray(batch.column("_ids").flatten()), minlength=cfg.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["found"])

    counts = np.zeros(cfg.buckets)
    for (found,) in ids.mapInArrow(count, "found binary").collect():
        counts += np.frombuffer(found, "<i8")
    keep = np.sqrt(np.minimum(1.0, cfg.frequent * max(counts.sum(), 1) / np.maximum(counts, 1))).astype(np.float32)
    shared = spark.sparkContext.broadcast(keep)

    def run(batches):
        signs = _signs(cfg) * shared.value[:, None]
        total = np.zeros((cfg.buckets, cfg.vector_size), dtype=np.float32)
        for batch in batches:
            for ids in batch.column("_ids"):
                ids = np.asarray(ids.values) if ids.is_valid else np.zeros(0, dtype=np.int32)
                for begin in range(0, len(ids), PIECE):
                    left = max(0, begin - cfg.window)
                    part = ids[left : begin + PIECE + cfg.window]
                    found = contexts(part, signs, cfg.window)[begin - left :][:PIECE]
                    add_rows(total, part[begin - left :][:PIECE], found)
        slices = [j for j in range(0, cfg.buckets, SLICE) if total[j : j + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([total[j : j + SLICE].tobytes() for j in slices], pa.binary())], names=["slice", "data"])

    def add(table: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(d.as_buffer(), "<f4").astype(float) for d in table.column("data"))
        return pa.table({"slice": table.column("slice")[:1], "data": pa.array([data.astype("<f4").tobytes()], pa.binary())})

    vectors = np.zeros((cfg.buckets, cfg.vector_size))
    summed = ids.mapInArrow(run, "slice int, data binary").groupBy("slice").applyInArrow(add, "slice int, data binary")
    for j, data in summed.collect():
        part = np.frombuffer(data, "<f4").reshape(-1, cfg.vector_size)
        vectors[j : j + len(part)] = part
    known = counts >= cfg.min_count
    vectors[~known] = 0
    if not known.any():
        return vectors.astype(np.float32)
    vectors[known] = _unit(vectors[known])
    weight = counts[known] / counts[known].sum()
    vectors[known] -= weight @ vectors[known]
    values, axes = np.linalg.eigh((vectors[known] * weight[:, None]).T @ vectors[known])
    vectors[known] = _unit(vectors[known] @ (axes / np.sqrt(np.maximum(values, 0) + 1e-4)))
    return vectors.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def fold_in(ids: list[np.ndarray], vectors: np.ndarray, cfg: EmbedConfig) -> np.ndarray:
    """Vectors of texts given as bucket numbers, by a bounded number of steps."""
    out = np.zeros((len(ids), cfg.vector_size))
    for k, own in enumerate(ids):
        # Two matrix-vector products per step: a text's distinct words fit the cache.
        words, times = np.unique(own, return_counts=True)
        v = vectors[words].astype(float)
        known = v.any(axis=1)
        if not known.any():
            continue
        v, share = v[known], times[known] / times[known].sum()
        d = share @ v
        for _ in range(cfg.steps):
            d += ((share * (1 - v @ d)) @ v - cfg.ridge * d) / (1 + cfg.ridge)
        out[k] = _unit(d)
    return out


def document_vectors(rows: DataFrame, shared, cfg: EmbedConfig, name: str = "vector") -> DataFrame:
    """``rows`` with ``_ids`` replaced by the texts' vectors; ``shared`` is a broadcast of
    the word vectors. A text costs memory for its distinct words alone."""
    keep = [c for c in rows.columns if c != "_ids"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` array<double>"

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                ids = [np.asarray(i.values) if i.is_valid else np.zeros(0, dtype=np.int32) for i in part.column("_ids")]
                made = fold_in(ids, shared.value, cfg)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, cfg.vector_size), pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists], names=[*keep, name])

    return rows.select(*keep, "_ids").mapInArrow(run, schema)
