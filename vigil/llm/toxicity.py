"""Toxicity: a convolutional text classifier, trained in numpy on labelled rows.

Words and their first bytes are hashed into ``BUCKETS`` embedding rows. Filters of
width 1 to 3 slide over the whole text, each keeps its maximum, and a logistic layer
reads the maxima. Some embedding coordinates are set, not trained: how much more often
the word, and each of its beginnings, occurs in toxic training texts (z values,
cross-fitted between two folds so that a text never sees its own label); the others,
the filters and the output layer are learned with Adam. The output is shifted so that 0.5 is the best cut on validation rows, and
every language gets a cut of its own where it has enough validation rows.

Every labelled text outside the held-out fold is a training or a validation row, whole.
Adam starts on the driver with a bounded number of texts (:func:`train`: at most
``MAX_TOXIC`` and ``MAX_CLEAN``, each of at most ``MAX_TRAIN_BYTES``, the ones with the
smallest hash of their id). Where these are not all, the weights found are only the start
of :func:`refine`: the z values are counted over all training texts, tasks descend over
all of them and their weights are averaged, and the cuts come from all validation rows.
Scoring reads every text whole; language, source, id and label are no inputs.

Defined cases: null and empty texts get the score of a text without words; repeated
label rows count once, toxic if any says so; null labels are no training rows; without
a toxic and a clean training row every score is 0; a null or unknown language uses the
common cut 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.frames import fresh, plus
from vigil.llm.words import ALNUM, U64, Words, pieces, raw_texts
from vigil.session import materialise

BUCKETS = 1 << 16
LEARNED = 6
#: Bytes of the word beginnings that have embeddings besides the whole word.
PREFIXES = (4, 5, 6, 7, 8)
FIXED = 1 + len(PREFIXES)
DIM = FIXED + LEARNED
#: How the buckets of the texts that start the model travel to the driver.
PACKED = "<u2"
FILTERS = 12
WIDTHS = (1, 2, 3)
EPOCHS = 8
MAX_TOXIC = 2500
MAX_CLEAN = 5000
MAX_TRAIN_BYTES = 1 << 16
#: Folds of crc32(doc_id) mod 5: 0 is held out by the caller, this one validates.
VALIDATE = 1
LEAST_PER_LANGUAGE = 8
#: Texts of a step; passes of the tasks over all training texts, and their step size.
BATCH = 32
PASSES = 2
RATE = 0.003
#: Rows of the embedding in one slice of a sum, and steps of a cut for one unit of the logit.
SLICE = 4096
STEPS = 256


@dataclass
class Network:
    embed: np.ndarray
    fixed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    cuts: dict[str, float] = field(default_factory=dict)
    blank: bool = False


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word and its beginnings, and the first word of each text."""
    w = Words(texts, ALNUM, lower=True)
    rows = [(h >> U64(64 - (BUCKETS - 1).bit_length())).astype(np.int32) for h in w.prefix_hashes(PREFIXES)]
    return np.stack(rows, axis=1), w.first


def _inputs(embed: np.ndarray, fixed: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = np.empty((len(rows), DIM), dtype=np.float32)
    for k in range(FIXED):
        x[:, k] = fixed[k][rows[:, k]]
    x[:, FIXED:] = embed[rows[:, 0]]
    return x


def _pooled(net: Network, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum of every filter in every text; a text is followed by blank words."""
    n_texts, pad = len(first) - 1, max(WIDTHS)
    x = np.zeros((len(rows) + pad * n_texts, DIM), dtype=np.float32)
    begin = first[:-1] + pad * np.arange(n_texts)
    x[np.arange(len(rows)) + pad * np.repeat(np.arange(n_texts), np.diff(first))] = rows
    last = np.append(begin[1:], len(x))
    out = []
    for width, weights, bias in zip(WIDTHS, net.filters, net.bias):
        y = x @ weights[0]
        for j in range(1, width):
            y[:-j] += x[j:] @ weights[j]
        for back in range(1, width):
            y[last - back] = -np.inf
        out.append(np.maximum(np.maximum.reduceat(y, begin, axis=0) + bias, 0))
    return np.concatenate(out, axis=1)


def _logits_of(net: Network, rows: list[np.ndarray]) -> np.ndarray:
    """Logits of texts given as the buckets of their words."""
    out = []
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        first = np.concatenate(([0], np.cumsum([len(r) for r in part])))
        out.append(_pooled(net, _inputs(net.embed, net.fixed, np.concatenate(part)), first) @ net.out[:-1] + net.out[-1])
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def logits(net: Network, texts: list[bytes]) -> np.ndarray:
    out = []
    for piece in pieces(texts, 1 << 19):
        rows, first = word_buckets(texts[piece])
        a = _pooled(net, _inputs(net.embed, net.fixed, rows), first)
        out.append(a @ net.out[:-1] + net.out[-1])
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    if net.blank:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(logits(net, texts) - net.shift, -30, 30)))


def _z_values(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How far the share of toxic texts with a bucket exceeds that of clean texts,
    for the whole words and each length of beginnings."""
    pos, neg = np.zeros((FIXED, BUCKETS)), np.zeros((FIXED, BUCKETS))
    for r, t in zip(rows, y):
        for k in range(FIXED):
            (pos if t else neg)[k][np.unique(r[:, k])] += 1
    return _z_of_counts(pos, neg, int(y.sum()), int((1 - y).sum()))


def _z_of_counts(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    n1, n0 = max(1, n1), max(1, n0)
    both = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0))
    z[pos + neg < 3] = 0
    return np.clip(z / 4, -2, 4).astype(np.float32)


def _step(params: list, m: list, v: list, step: int, rate: float, own: list[np.ndarray], y, z) -> np.ndarray:
    """One step of Adam over the texts ``own`` with their set coordinates ``z``; the rows
    of the embedding that it moved."""
    n = len(WIDTHS)
    embed, filters, bias, out = params[0], params[1 : 1 + n], params[1 + n : 1 + 2 * n], params[-1]
    grads = [np.zeros_like(p) for p in params[1:]]
    touched, dx = [], []
    for r, fixed, toxic in zip(own, z, y):
        x = np.concatenate([_inputs(embed, fixed, r), np.zeros((max(WIDTHS), DIM), dtype=np.float32)])
        pooled, where = [], []
        for width, f, b in zip(WIDTHS, filters, bias):
            span = len(x) - width + 1
            c = sum(x[j : j + span] @ f[j] for j in range(width)) + b
            top = c.argmax(axis=0)
            where.append(top)
            pooled.append(c[top, np.arange(FILTERS)])
        pooled = np.concatenate(pooled)
        a = np.append(np.maximum(pooled, 0), 1).astype(np.float32)
        g = float(1 / (1 + np.exp(-np.clip(a @ out, -30, 30))) - toxic) / len(own)
        grads[-1] += g * a
        back = g * out[:-1] * (pooled > 0)
        for q, (width, f) in enumerate(zip(WIDTHS, filters)):
            d = back[q * FILTERS : (q + 1) * FILTERS]
            grads[n + q] += d
            for j in range(width):
                pos = where[q] + j
                grads[q][j] += x[pos].T * d
                real = pos < len(r)
                touched.append(r[pos[real], 0])
                dx.append((f[j] * d).T[real, FIXED:])
    touched, dx = np.concatenate(touched), np.concatenate(dx)
    used, inverse = np.unique(touched, return_inverse=True)
    de = np.zeros((len(used), LEARNED), dtype=np.float32)
    np.add.at(de, inverse, dx)
    for p, g, mm, vv, rows_at in [(embed, de, m[0], v[0], used), *[(p, g, a, b, slice(None)) for p, g, a, b in zip(params[1:], grads, m[1:], v[1:])]]:
        mm[rows_at] = 0.9 * mm[rows_at] + 0.1 * g
        vv[rows_at] = 0.999 * vv[rows_at] + 0.001 * g * g
        p[rows_at] -= rate * (mm[rows_at] / (1 - 0.9**step)) / (np.sqrt(vv[rows_at] / (1 - 0.999**step)) + 1e-7)
    return used


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, langs: list[str | None], seed: int = 7) -> Network:
    """Network of the labelled texts, given as the buckets of their words (:func:`word_buckets`);
    ``fold`` as crc32 mod 5, ``weight`` undoes the sampling."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, :FIXED, : FILTERS // 2] = np.abs(f[:, :FIXED, : FILTERS // 2])
    bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    embed = rng.normal(0, 0.1, (BUCKETS, LEARNED)).astype(np.float32)
    out = np.concatenate([rng.normal(0, 0.2, FILTERS * len(WIDTHS)), [0]]).astype(np.float32)
    net = Network(embed, np.zeros((FIXED, BUCKETS), dtype=np.float32), filters, bias, out, 0.0)
    if len(set(y.tolist())) < 2:
        net.blank = True
        return net
    train = np.flatnonzero(fold != VALIDATE)
    check = np.flatnonzero(fold == VALIDATE)
    if len(set(y[train].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        train = check = np.arange(len(y))
    half = rng.permutation(len(train)) % 2
    of_half = [_z_values([rows[i] for i in train[half != k]], y[train[half != k]]) for k in (0, 1)]
    params = [embed, *filters, *bias, out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    epochs = max(EPOCHS, -(-400 * BATCH // len(train)))
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(train)), max(1, len(train) // BATCH)):
            step += 1
            _step(params, m, v, step, 0.01 / (1 + step / 2000), [rows[i] for i in train[at]], y[train[at]], [of_half[k] for k in half[at]])
    net.fixed = _z_values([rows[i] for i in train], y[train])
    logit = _logits_of(net, [rows[i] for i in check])
    net.shift = _best_cut(logit, y[check], weight[check])
    for lang in {langs[i] for i in check} - {None}:
        at = np.array([j for j, i in enumerate(check) if langs[i] == lang])
        if min(y[check[at]].sum(), (1 - y[check[at]]).sum()) >= LEAST_PER_LANGUAGE:
            cut = _best_cut(logit[at], y[check[at]], weight[check[at]])
            net.cuts[lang] = float(1 / (1 + np.exp(-(cut - net.shift))))
    return net


def _best_cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Cut with the best F1; the middle of the gap around it."""
    order = np.argsort(-logit, kind="stable")
    s, t, w = logit[order], y[order], weight[order]
    tp, fp = np.cumsum(w * t), np.cumsum(w * (1 - t))
    f1 = 2 * tp / (tp + fp + (w * t).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    at = int(f1.argmax())
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else s[at] - 1)) / 2)


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Start: the network of a bounded number of labelled documents outside the held-out
    fold (crc32(doc_id) mod 5 = 0)."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    # Places go to labels whose document is there and short enough: ids and lengths alone.
    usable = docs.filter((fold != 0) & (F.octet_length("text") <= MAX_TRAIN_BYTES)).select("doc_id").distinct()
    named = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold != 0).join(usable, "doc_id", "left_semi")
    named = materialise(named, "labels")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    sizes = {r[0]: r[1] for r in named.groupBy(F.col("toxic") > 0).count().collect()}
    picked = None
    for toxic, most in ((True, MAX_TOXIC), (False, MAX_CLEAN)):
        part = named.filter((F.col("toxic") > 0) == toxic).select("doc_id", F.lit(toxic).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # At most MAX_TOXIC + MAX_CLEAN ids: broadcast, so that no other text is moved.
    texts = docs.select("doc_id", "text", lang.alias("lang")).filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(picked), "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    rows = one.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", fold.alias("fold"), "t.text", "t.lang")

    def run(batches):
        for batch in batches:
            for _, piece, r, first in _hashed([batch]):
                part = batch.slice(piece.start, len(first) - 1)
                packed = [r[a:b].astype(PACKED).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names if c != "text"], pa.array(packed, pa.binary())], names=[*[c for c in part.schema.names if c != "text"], "words"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns if c != "text")
    # The driver gets no text, only the buckets of the words, in two bytes each.
    found = sorted(rows.mapInArrow(run, f"{kept}, words binary").collect(), key=lambda r: (r["h"], r["doc_id"]))
    y, folds, langs = np.array([int(r["toxic"]) for r in found]), np.array([r["fold"] for r in found]), [r["lang"] for r in found]
    weights = np.array([sizes.get(bool(t), 0) / (y == t).sum() for t in y])
    words = [np.frombuffer(r["words"], PACKED).reshape(-1, FIXED) for r in found]
    del found
    return fit(words, y, weights, folds, langs)


def every_row(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, lang, fold and half of every labelled document outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    named = labels.filter("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).filter(fold != 0)
    texts = docs.filter((fold != 0) & F.col("text").isNotNull()).select("doc_id", "text", lang.alias("lang")).join(named, "doc_id")
    # Repeated ids count once; the join has brought them together already.
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    return one.select("t.text", "toxic", "t.lang", fold.cast("int").alias("fold"), half.alias("half"))


def _added(rows: DataFrame, run, dtype: str = "<f8") -> dict[int, np.ndarray]:
    """The slices that the tasks of ``run`` give, added up in the order of the tasks."""

    def numbered(batches):
        task = TaskContext.get().partitionId()
        made = list(run(batches))
        yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in made], pa.int32()), pa.array([task] * len(made), pa.int32()), pa.array([np.asarray(d, dtype).tobytes() for _, d in made], pa.binary())], names=["slice", "task", "data"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = sum(np.frombuffer(d.as_buffer(), dtype) for d in table.column("data"))
        return pa.table({"slice": table.column("slice")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(numbered, "slice int, task int, data binary").groupBy("slice").applyInArrow(add, "slice int, data binary")
    return {j: np.frombuffer(d, dtype) for j, d in sums.collect()}


def _hashed(batches):
    """Batch, number and buckets of every text."""
    for batch in batches:
        texts = raw_texts(batch.column("text"))
        for piece in pieces(texts):
            r, first = word_buckets(texts[piece])
            yield batch, piece, r, first


def _z_of_all(rows: DataFrame) -> list[np.ndarray]:
    """z values of the texts outside each half, and of all texts."""

    def run(batches):
        counts = np.zeros((FIXED, 4 * BUCKETS), dtype=np.int64)
        sizes = np.zeros(4, dtype=np.int64)
        for batch, piece, r, first in _hashed(batches):
            group = 2 * np.asarray(batch.column("half"))[piece] + np.asarray(batch.column("toxic").cast(pa.int32()))[piece]
            sizes += np.bincount(group, minlength=4)
            owner = np.repeat(np.arange(len(group)), np.diff(first))
            for k in range(FIXED):
                pairs = np.unique(owner * BUCKETS + r[:, k])
                counts[k] += np.bincount(group[pairs // BUCKETS] * BUCKETS + pairs % BUCKETS, minlength=4 * BUCKETS)
        yield -1, sizes
        yield from enumerate(counts)

    found = _added(rows, run, "<i8")
    sizes = found[-1].reshape(2, 2)
    counts = np.stack([found[k] for k in range(FIXED)]).reshape(FIXED, 2, 2, BUCKETS)
    of = lambda halves: _z_of_counts(counts[:, halves, 1].sum(axis=1), counts[:, halves, 0].sum(axis=1), int(sizes[halves, 1].sum()), int(sizes[halves, 0].sum()))
    return [of([1]), of([0]), of([0, 1])]


def _pass(rows: DataFrame, net: Network, of_half: list[np.ndarray]) -> None:
    """Every task descends over its texts from the weights of ``net``, which then takes the
    mean of their moves: by texts, and in the embedding by the steps that moved a row."""
    shared = rows.sparkSession.sparkContext.broadcast((net, of_half))

    def run(batches):
        net, of_half = shared.value
        start = [net.embed, *net.filters, *net.bias, net.out]
        params = [p.copy() for p in start]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        moved, texts, step, held = np.zeros(BUCKETS), 0, 0, []

        def descend():
            nonlocal step, texts
            step, texts = step + 1, texts + len(held)
            moved[_step(params, m, v, step, RATE, *map(list, zip(*held)))] += 1
            held.clear()

        for batch, piece, r, first in _hashed(batches):
            half, toxic = np.asarray(batch.column("half"))[piece], np.asarray(batch.column("toxic").cast(pa.int32()))[piece]
            for a, b, k, t in zip(first[:-1], first[1:], half, toxic):
                held.append((r[a:b], int(t), of_half[k]))
                if len(held) == BATCH:
                    descend()
        if held:
            descend()
        if texts:
            yield -1, np.concatenate([[texts], *[texts * (p - q).ravel() for p, q in zip(params[1:], start[1:])]])
            own = np.column_stack((moved, moved[:, None] * (params[0] - start[0])))
            yield from ((j, own[j : j + SLICE]) for j in range(0, BUCKETS, SLICE) if moved[j : j + SLICE].any())

    found = _added(rows, run)
    shared.destroy()
    dense, at = found.pop(-1), 1
    for p in [*net.filters, *net.bias, net.out]:
        p += (dense[at : at + p.size] / dense[0]).reshape(p.shape).astype(np.float32)
        at += p.size
    for j, data in found.items():
        data = data.reshape(-1, 1 + LEARNED)
        net.embed[j : j + len(data)] += (data[:, 1:] / np.maximum(data[:, :1], 1)).astype(np.float32)


def _cuts_of_all(rows: DataFrame, net: Network) -> None:
    """The common shift and the cuts of the languages, from the logits of all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            step = np.floor(np.clip(logits(shared.value, raw_texts(batch.column("text"))), -30, 30) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(step), batch.column("toxic")], names=["lang", "step", "toxic"])

    count = lambda toxic: F.count(F.when(F.col("toxic") == toxic, 1))
    # At most 60 * STEPS rows of a language, whatever the number of texts.
    steps = rows.select("text", "lang", "toxic").mapInArrow(run, "lang string, step int, toxic boolean").groupBy("lang", "step").agg(count(True), count(False)).collect()

    def cut(found) -> float:
        step, pos, neg = np.array(sorted(((r[1], r[2], r[3]) for r in found), reverse=True), dtype=float).T
        level, first = np.unique(-step, return_index=True)
        tp, fp = np.cumsum(np.add.reduceat(pos, first)), np.cumsum(np.add.reduceat(neg, first))
        at = int((2 * tp / (tp + fp + tp[-1])).argmax())
        low = -level[at]
        below = -level[at + 1] + 1 if at + 1 < len(level) else low - STEPS
        return (low + below) / 2 / STEPS

    net.shift, net.cuts = cut(steps), {}
    by_language: dict[str, list] = {}
    for r in steps:
        by_language.setdefault(r["lang"], []).append(r)
    for lang, found in by_language.items():
        if lang is not None and min(sum(r[2] for r in found), sum(r[3] for r in found)) >= LEAST_PER_LANGUAGE:
            net.cuts[lang] = float(1 / (1 + np.exp(-(cut(found) - net.shift))))


def refine(rows: DataFrame, net: Network) -> Network:
    """``net`` trained on and cut by all ``rows`` of :func:`every_row`."""
    tally = {(r[0], r[1]) for r in rows.select("toxic", F.col("fold") == VALIDATE).distinct().collect()}
    net.blank = len({t for t, _ in tally}) < 2
    if net.blank:
        return net
    train = check = rows
    if len(tally) == 4:
        train, check = rows.filter(F.col("fold") != VALIDATE), rows.filter(F.col("fold") == VALIDATE)
    *of_half, net.fixed = _z_of_all(train)
    for _ in range(PASSES):
        _pass(train, net, of_half)
    _cuts_of_all(check, net)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Network of all labelled documents outside the held-out fold."""
    rows = materialise(every_row(docs, labels), "training")
    net = train(docs, labels)
    n = rows.agg(*[F.count(F.when(c, 1)) for c in (F.col("toxic"), ~F.col("toxic"), F.octet_length("text") > MAX_TRAIN_BYTES)]).first()
    return net if n[0] <= MAX_TOXIC and n[1] <= MAX_CLEAN and not n[2] else refine(rows, net)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with score, the cut of its language and the decision, in one struct."""
    name, lang = fresh("toxicity", docs.columns), "lang" if "lang" in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for batch in batches:
            s = scores(net, raw_texts(batch.column("text")))
            langs = batch.column(lang).to_pylist() if lang else [None] * len(s)
            cut = np.array([net.cuts.get(x, 0.5) for x in langs])
            made = pa.StructArray.from_arrays([pa.array(s), pa.array(cut), pa.array(s >= cut)], names=["score", "cut", "toxic"])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    schema = plus(docs.schema, **{name: "struct<score:double,cut:double,toxic:boolean>"})
    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic by the cut of their language."""
    found = score(docs, learn(docs, labels))
    return found.filter(~F.col(f"{found.columns[-1]}.toxic")).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, language_cut, toxic_by_language."""
    docs = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []))
    found = score(docs, learn(docs, labels))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    t = found.columns[-1]
    return found.select("doc_id", held.alias("held_out"), F.col(f"{t}.score").alias("score"), (F.col(f"{t}.score") >= 0.5).cast("int").alias("predicted"), F.col(f"{t}.cut").alias("language_cut"), F.col(f"{t}.toxic").alias("toxic_by_language"))
