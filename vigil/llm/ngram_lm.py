"""Trigram language model on a log-frequency Bloom filter of n-gram counts.

Counting: chunks of documents send the distinct 1-, 2- and 3-grams of their texts, with
how often their training texts have them, to buckets of hash space. The buckets' exact
sums give the number of tokens N and of distinct tokens V and the counts c(w), which each
chunk is told for its own words.

Filter: every 2- and 3-gram of a training text, from count 1 on, is held with the quantised
count q (two levels per doubling: 1, 2, 3, 4-5, 6-7, 8-11, ...) as q insertions, (key, 1) to
(key, q). The filter has one
segment per order and bucket; a bucket sizes its segment from the insertions it has
counted, so that half of the bits are set at any size of the input. Reading asks for
(key, 1), (key, 2), ... until one is not held. With ``hashes`` = 8 bits per insertion a
question for something that was not inserted is answered yes at a rate of 2^-8.

Transport: a segment's bits come to the keys or the keys to the bits. Where a bound on the
filter that follows from the bytes of the texts (:func:`largest_filter`) is at most
``broadcast_bytes``, all segments are broadcast and the chunks probe them; beyond, a bucket
probes its segment with the keys it was sent and answers in the order of the questions.
Bits, probes and scores are the same in both ways.

Scoring: low and high are the least and the largest count of a level,

    p1(w) = (c(w) + 1) / (N + V + 1)
    p2(w | v) = (low(vw) + K * p1(w)) / (c(v) + K)
    p3(w | uv) = (low(uvw) + K * p2(w | v)) / (high(uv) + K)

sum to at most 1 over w (where no probe errs); the longer context weighs more the more
often it was seen, and one that was not seen falls back to the shorter one. The base score
uses p1 alone.

Defined cases: null and empty texts have one token, the end; a null id is a
training row; repeated rows count as often as they occur; without training rows
N = V = 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import exchange as X
from vigil.llm.frames import fresh
from vigil.llm.words import NOT_SPACE, U64, Words, mix, pieces, raw_texts, windows
from vigil.session import materialise

ORDERS = (2, 3)
HASHES = 8
BROADCAST_BYTES = 64 << 20
LEVELS = 80
#: Weight of the shorter context, as a count.
K = 4.0
#: Bits of a token's key: two of a billion tokens meet with a probability of 0.4.
WORD_BITS = 60
END = mix(np.array([0xE0D], dtype=np.uint64))[0]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end token, and where each text begins."""
    parts, first = [], [0]
    for piece in pieces(texts):
        w = Words(texts[piece], NOT_SPACE, lower=True)
        n = len(w.first) - 1
        out = np.full(w.n + n, END, dtype=np.uint64)
        out[np.arange(w.n) + w.text_of()] = w.hashes()
        parts.append(out)
        first += (w.first[1:] + np.arange(1, n + 1) + first[-1]).tolist()
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.array(first)


def keys_of(h: np.ndarray, first: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    start, run = windows(h, first, order)
    return start, run >> U64(64 - bits)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], X.groups(keys[order])
    return keys[at], np.add.reduceat(counts[order], at)


def _planes(a: np.ndarray) -> bytes:
    """Values by byte planes: the upper planes of small numbers compress to nothing."""
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _values(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts, from 1 on: two levels per doubling."""
    part, power = np.frexp(counts.astype(np.float64))
    return np.maximum(1, 2 * (power - 1) + (part >= 0.75)).astype(np.uint8)


def least_count(level: np.ndarray) -> np.ndarray:
    """Least count of each level, 0 for level 0."""
    level = level.astype(np.int64)
    return np.where(level > 1, (2 + level % 2) * 2.0 ** (level // 2 - 1), level)


def _places(keys: np.ndarray, level: np.ndarray | int, turn: int, bits: int) -> np.ndarray:
    """The bit that hash function ``turn`` gives (key, level) in a segment of ``bits`` bits."""
    one = mix(keys + np.asarray(level, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F))
    two = (one >> U64(32)) * U64(0x9E3779B97F4A7C15) | U64(1)
    return (mix(one + U64(turn) * two) % U64(bits)).astype(np.int64)


def segment_of(keys: np.ndarray, levels: np.ndarray, hashes: int) -> np.ndarray:
    """Bits, as bytes, that hold each key up to its level; sized from the insertions."""
    insertions = int(levels.sum(dtype=np.int64))
    size = -(-int(insertions * hashes / np.log(2)) // 8)
    held = np.zeros(8 * size, dtype=np.bool_)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        for turn in range(hashes):
            held[_places(keys, level, turn, 8 * size)] = True
    return np.packbits(held, bitorder="little")


def probe(segment: np.ndarray, keys: np.ndarray, hashes: int) -> np.ndarray:
    """Quantised count of each key, 0 where it is not held: one more level per hit."""
    level = np.zeros(len(keys), dtype=np.uint8)
    alive = np.arange(len(keys)) if len(segment) else np.zeros(0, dtype=np.int64)
    for lev in range(1, LEVELS + 1):
        for turn in range(hashes):
            bit = _places(keys[alive], lev, turn, 8 * len(segment))
            alive = alive[(segment[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
        if not len(alive):
            break
        level[alive] = lev
    return level


def largest_filter(text_bytes: int, hashes: int) -> int:
    """Bound on the bytes of all segments: a text of b bytes has at most b words, so at most b
    n-grams of an order, and an n-gram of count c takes no more than c insertions."""
    return int(len(ORDERS) * text_bytes * hashes / np.log(2) / 8) + 1


def smoothed(h: np.ndarray, first: np.ndarray, count: np.ndarray, total: int, distinct: int, levels: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Base and smoothed log10 probability of every token; ``count`` is c of each, ``levels``
    the quantised counts of the 2- and 3-grams in the order of :func:`windows`."""
    p1 = (count + 1) / (total + distinct + 1)
    p = p1.copy()
    start = windows(h, first, 2)[0]
    pair = np.zeros(len(h), dtype=np.uint8)
    pair[start + 1] = levels[2]
    at = start + 1
    context = count[at - 1].astype(np.float64)
    known = context > 0
    at, context = at[known], context[known]
    p[at] = (np.minimum(least_count(pair[at]), context) + K * p1[at]) / (context + K)
    start = windows(h, first, 3)[0]
    held = pair[start + 1] > 0
    start, triple = start[held], levels[3][held]
    at = start + 2
    high = np.minimum(least_count(pair[start + 1] + 1) - 1, np.maximum(count[start], 1))
    p[at] = (np.minimum(least_count(triple), high) + K * p[at]) / (high + K)
    return np.log10(p1), np.log10(p)


def grams_of(table: pa.Table, flag: str, bits: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple]]:
    """Tokens of a chunk, where its texts begin, and per order the key of every n-gram and
    whether a training text has it."""
    h, first = tokens(raw_texts(table.column("text")))
    own = np.repeat(np.array(table.column(flag).to_pylist(), dtype=np.uint32), np.diff(first))
    grams = {1: (h >> U64(64 - WORD_BITS), own)}
    for order in ORDERS:
        start, keys = keys_of(h, first, order, bits)
        grams[order] = keys, own[start]
    return h, first, grams


def report(docs: DataFrame, train, hashes: int = HASHES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    document row; ``train`` is the condition of the training rows."""
    docs = docs.select("doc_id", "text")
    flag = fresh("train", docs.columns)
    docs = docs.withColumn(flag, F.coalesce(train, F.lit(True)))
    layout = X.Layout.of(docs)
    width = {order: WORD_BITS if order == 1 else layout.bits for order in (1, *ORDERS)}
    shared = largest_filter(layout.size, hashes) <= broadcast_bytes
    parts, chunk = X.chunked(docs, layout)

    def ask(key, table):
        sent = []
        for order, (keys, own) in grams_of(table, flag, layout.bits)[2].items():
            keys, counts = _summed(keys, own)
            if order > 1 and shared:
                keys, counts = keys[counts > 0], counts[counts > 0]
            rows = X.to_buckets(key[0].as_py(), width[order], layout.buckets, keys, counts)
            sent.append(rows.append_column("ngram", pa.array([order] * len(rows), pa.int32())))
        return pa.concat_tables(sent)

    def answer(key, table):
        order, bucket = key[0].as_py(), key[1].as_py()
        sent = [X.unpack(d, np.uint32) for d in table.column("data").to_pylist()]
        keys, counts = (np.concatenate([s[i] for s in sent]) for i in (0, 1))
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by].astype(np.int64)
        at = X.groups(keys)
        sums = np.add.reduceat(counts, at)
        total, distinct = (int(sums.sum()), int((sums > 0).sum())) if order == 1 else (0, 0)
        if order > 1:
            some = sums > 0
            segment = segment_of(keys[at][some], level_of(sums[some]), hashes)
            if shared:
                return told_rows([None], order, bucket, [segment.tobytes()], 0, 0)
            sums = probe(segment, keys[at], hashes)
        told = np.empty(len(keys), dtype=sums.dtype)
        told[by] = np.repeat(sums, np.diff(np.append(at, len(keys))))
        # Answers stand in the order of the chunk's sorted keys, so no key travels back.
        data = [_planes(x) for x in np.split(told, np.cumsum([len(s[0]) for s in sent])[:-1])]
        return told_rows(table.column("chunk").to_pylist(), order, bucket, data, total, distinct)

    def told_rows(chunks, order, bucket, data, total, distinct):
        n = len(data)
        return pa.table(
            {
                "chunk": pa.array(chunks, pa.int32()),
                "ngram": pa.array([order] * n, pa.int32()),
                "bucket": pa.array([bucket] * n, pa.int32()),
                "data": pa.array(data, pa.binary()),
                "n_distinct": pa.array([distinct] + [0] * (n - 1), pa.int64()),
                "n_total": pa.array([total] + [0] * (n - 1), pa.int64()),
            }
        )

    def levels_of(order, keys, answers):
        """Quantised counts of sorted distinct keys: as told, or by probes of the shared filter."""
        if not shared:
            return np.concatenate([np.zeros(0, dtype=np.uint8), *[_values(d, np.uint8) for o, _, d in answers if o == order]])
        border = X.split_by_bucket(keys, layout.bits, layout.buckets)
        out = np.zeros(len(keys), dtype=np.uint8)
        for b in np.flatnonzero(np.diff(border)):
            part = slice(border[b], border[b + 1])
            out[part] = probe(np.frombuffer(filters.value.get((order, int(b)), b""), np.uint8), keys[part], hashes)
        return out

    def rate(key, table, told):
        h, first, grams = grams_of(table, flag, layout.bits)
        answers = sorted(zip(*(told.column(c).to_pylist() for c in ("ngram", "bucket", "data"))))
        words, place = np.unique(grams.pop(1)[0], return_inverse=True)
        count = np.concatenate([np.zeros(0, dtype=np.int64), *[_values(d, np.int64) for o, _, d in answers if o == 1]])[place]
        found = {}
        for order, (keys, _) in grams.items():
            keys, place = np.unique(keys, return_inverse=True)
            found[order] = levels_of(order, keys, answers)[place]
        base, smooth = smoothed(h, first, count, total, distinct, found)
        begin = first[:-1]
        sums = [np.add.reduceat(v, begin) if len(begin) else v for v in (base, smooth, (count > 0).astype(np.int64))]
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": pa.array([not t for t in table.column(flag).to_pylist()], pa.bool_()),
                "n_tokens": pa.array(np.diff(first), pa.int64()),
                "n_known": pa.array(sums[2], pa.int64()),
                "train_tokens": pa.array([total] * (len(first) - 1), pa.int64()),
                "base_score": pa.array(sums[0], pa.float64()),
                "score": pa.array(sums[1], pa.float64()),
            }
        )

    by_chunk = parts.groupBy(chunk)
    asked = by_chunk.applyInArrow(ask, f"{X.TO_BUCKET}, ngram int")
    told = materialise(asked.groupBy("ngram", "bucket").applyInArrow(answer, "chunk int, ngram int, bucket int, data binary, n_distinct long, n_total long"), "counts")
    distinct, total = (int(v or 0) for v in told.agg(F.sum("n_distinct"), F.sum("n_total")).first())
    # At most broadcast_bytes, by largest_filter.
    filters = docs.sparkSession.sparkContext.broadcast({(r[0], r[1]): bytes(r[2]) for r in told.filter("chunk IS NULL").select("ngram", "bucket", "data").collect()}) if shared else None
    told = told.filter("chunk IS NOT NULL").select("chunk", "ngram", "bucket", "data")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
