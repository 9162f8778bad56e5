"""Ranked lexical search: inner products of impact vectors, pruned by their lengths.

A document's vector has, for each term that occurs in an item, the term's weight times
its impact ``(10^9 tf) div (1000 tf + 8 m)``; an item is the 0/1 vector of its terms; the
score is their inner product. Vectors are ordered by length (Euclidean norm) and cut
into buckets of at most ``BUCKET`` vectors. Buckets are searched in two rounds: those of
the longest vectors, then the others, which know each item's bar, the score of its k-th
best document so far. In a bucket

* Cauchy-Schwarz prunes the items whose bar is above sqrt(terms) * the longest vector,
* coordinate bounds filter the rest: postings of an item's focus coordinates (rare in
  the bucket) are added up; what the other coordinates can add is at most the sum of
  their largest values in the bucket, and at most sqrt(their number) * the length that
  is left,
* survivors are rescored exactly in 64-bit integers.

All sums are below 2^53 and so exact in doubles; lengths get a relative slack. A bound
equal to the bar survives, so ties are decided by the ids alone.

Texts are read once: a table keeps, per document, its number of terms and the counts of
the items' terms. Items are taken in blocks of at most ``BLOCK_BYTES`` of text each, and
only a block's terms, weights and bars are broadcast.

Defined cases: null and empty texts have no terms and are never found; every row of
the items is an item of its own, so repeated rows are answered each; documents with
equal ids are told apart only by their scores, null ids come last among equal scores;
without documents or items there are no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.words import parts_of
from vigil.session import materialise

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
TOP = 10
#: Vectors of a bucket, and the share of all documents that the first round searches.
BUCKET = 2048
FIRST_SHARE = 1 / 64
#: Text of the items of one block.
BLOCK_BYTES = 8 << 20
#: Steps of the histogram of lengths for a factor 2, and bytes of vectors in one range.
LEVELS = 16
RANGE_BYTES = 8 << 20
LEAST_RANGES = 24
SLACK = 1 + 1e-9


def terms_of(text: str | None) -> list[str]:
    """Terms of a text, with repeats, lower-cased in A-Z."""
    if not text:
        return []
    return TERM.findall(text.lower() if text.isascii() else text.translate(UPPER))


class Items:
    """A block of items: sorted vocabulary, and for each item its distinct terms."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        found = [set(terms_of(r[1])) for r in rows]
        self.term = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        self.coordinates = [np.array(sorted(self.term[t] for t in f), dtype=np.int64) for f in found]


def vectors(docs: DataFrame, items) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (of the items' terms, as packed
    int32), for documents with at least one term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        get = None
        for batch in parts_of(batches, "text"):
            get = get or items.value.term.get
            ids, n, terms, counts = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                known = sorted((i, c) for t, c in Counter(found).items() if (i := get(t)) is not None)
                ids.append(doc)
                n.append(len(found))
                pairs = np.array(known, dtype="<i4").reshape(len(known), 2)
                terms.append(pairs[:, 0].tobytes())
                counts.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms binary, counts binary")


def document_counts(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequencies of the ``size`` terms, summed by the workers."""

    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for data in batch.column("terms").to_pylist():
                df[np.frombuffer(data, "<i4")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, dtype=np.int64)
    for term, n in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return int(total[0]), int(total[1]), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def values(n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, length: int, w: np.ndarray) -> np.ndarray:
    """Weight times impact of each entry, in integers; ``sizes`` entries per document."""
    m = np.repeat(10 + (90 * n * n_docs) // length, sizes)
    tf = counts.astype(np.int64)
    return w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def by_length(found: DataFrame, shared) -> DataFrame:
    """The vectors (doc_id, terms, values, length, level), longest first in ranges."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        n_docs, length, w = shared.value
        for batch in parts_of(batches, "terms"):
            sizes = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()], dtype=np.int64)
            terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4")
            v = values(np.asarray(batch.column("n")), sizes, terms, counts, n_docs, length, w)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            norm = np.sqrt([float(np.dot(x, x)) for x in (v[a:b].astype(float) for a, b in zip(ends, ends[1:]))])
            level = np.floor(LEVELS * np.log2(np.maximum(norm, 1))).astype(np.int32)
            packed = [v[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("terms"), pa.array(packed, pa.binary()), pa.array(norm), pa.array(level)], names=["doc_id", "terms", "vals", "length", "level"])

    return found.mapInArrow(run, f"doc_id {kind}, terms binary, vals binary, length double, level int").filter("length > 0")


class Bucket:
    """Vectors of similar length as postings by term."""

    def __init__(self, terms: list[bytes], vals: list[bytes], length: np.ndarray, size: int):
        self.n, self.size = len(terms), size
        sizes = np.array([len(t) // 4 for t in terms])
        term = np.frombuffer(b"".join(terms), "<i4").astype(np.int64)
        value = np.frombuffer(b"".join(vals), "<i8")
        self.owner = np.repeat(np.arange(self.n), sizes)
        #: (document, term) in ascending order, for exact scores.
        self.key, self.value = self.owner * size + term, value
        order = np.argsort(term, kind="stable")
        self.doc, self.post = self.owner[order], value[order].astype(float)
        self.term, self.begin = np.unique(term[order], return_index=True)
        self.end = np.append(self.begin[1:], len(term))
        self.largest = np.maximum.reduceat(self.post, self.begin) if len(term) else self.post
        self.length, self.square = length, length**2

    def exact(self, docs: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
        """Scores of ``docs``, in 64-bit integers."""
        want = docs[:, None] * self.size + coordinates[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.value[at], 0).sum(axis=1)

    def survivors(self, coordinates: np.ndarray, bar: int) -> np.ndarray:
        """Documents whose bound reaches ``bar`` for an item of these coordinates."""
        if len(coordinates) ** 0.5 * self.length.max() * SLACK < bar:
            return np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.term, coordinates)
        at = at[(at < len(self.term)) & (self.term[np.minimum(at, len(self.term) - 1)] == coordinates)]
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        at = at[np.argsort(self.end[at] - self.begin[at], kind="stable")]
        # Focus: the rarest coordinates, until the others alone cannot reach the bar.
        rest = np.append(np.cumsum(self.largest[at][::-1])[::-1], 0.0)
        part, square, done = np.zeros(self.n), np.zeros(self.n), 0
        stop = max(int(np.argmax(rest < max(bar, 1))), 1)
        for done in range(stop):
            a, b = self.begin[at[done]], self.end[at[done]]
            part[self.doc[a:b]] += self.post[a:b]
            square[self.doc[a:b]] += self.post[a:b] ** 2
        left = np.minimum(rest[stop], np.sqrt(np.maximum(self.square - square, 0) * (len(at) - stop)) * SLACK + 1e-3)
        # Without any focus coordinate a document stays below the bar.
        return np.flatnonzero((part > 0) & (part + left >= bar))


def search(ordered: DataFrame, items, bars, size: int, top: int) -> DataFrame:
    """item (place in the block), doc_id, score: each task's best documents per item."""
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def run(batches):
        block, bar = items.value, list(bars.value)
        best: list[tuple] = [(np.zeros(0, dtype=np.int64), [])] * len(bar)
        held: list[pa.RecordBatch] = []
        id_type = None

        def take(table: pa.Table):
            nonlocal id_type
            id_type = table.schema.field("doc_id").type
            bucket = Bucket(table.column("terms").to_pylist(), table.column("vals").to_pylist(), np.asarray(table.column("length")), size)
            ids = None
            for i, coordinates in enumerate(block.coordinates):
                docs = bucket.survivors(coordinates, bar[i])
                if not len(docs):
                    continue
                score = bucket.exact(docs, coordinates)
                good = score >= max(bar[i], 1)
                if not good.any():
                    continue
                ids = ids or table.column("doc_id").to_pylist()
                docs, score = docs[good], score[good]
                if len(docs) > top:
                    cut = np.partition(score, -top)[-top]
                    docs, score = docs[score >= cut], score[score >= cut]
                rows = sorted([*zip((-best[i][0]).tolist(), best[i][1]), *zip((-score).tolist(), [ids[d] for d in docs])], key=lambda r: (r[0], r[1] is None, r[1]))[:top]
                best[i] = (np.array([-r[0] for r in rows], dtype=np.int64), [r[1] for r in rows])
                if len(rows) == top:
                    bar[i] = max(bar[i], int(best[i][0][-1]))

        n = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, BUCKET):
                part = batch.slice(begin, BUCKET)
                held.append(part)
                n += part.num_rows
                if n >= BUCKET:
                    take(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            take(pa.Table.from_batches(held))
        if id_type is not None:
            item = np.repeat(np.arange(len(best)), [len(b[1]) for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array([d for b in best for d in b[1]], id_type), pa.array(np.concatenate([b[0] for b in best]), pa.int64())], names=["item", "doc_id", "score"]
            )

    return ordered.select("doc_id", "terms", "vals", "length").mapInArrow(run, f"item long, doc_id {kind}, score long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, rows: list[tuple], top: int) -> DataFrame:
    """item (place in ``rows``), doc_id, score, rank."""
    sc, block = docs.sparkSession.sparkContext, Items(rows)
    items, size = sc.broadcast(block), max(len(block.term), 1)
    found = materialise(vectors(docs, items), "vectors")
    n_docs, length, df = document_counts(found, size)
    shared = sc.broadcast((n_docs, max(length, 1), weights(n_docs, df)))
    valued = by_length(found, shared)
    ranges = max(LEAST_RANGES, 4 * (found.agg(F.sum(F.length("terms"))).first()[0] or 0) // RANGE_BYTES)
    ordered = materialise(valued.repartitionByRange(ranges, F.desc("length")).sortWithinPartitions(F.desc("length")), "ordered")
    # The longest vectors, down to a level that holds the share of the first round.
    levels = sorted(map(tuple, ordered.groupBy("level").count().collect()), reverse=True)
    seen, border = 0, 0
    for border, n in levels:
        seen += n
        if seen >= FIRST_SHARE * n_docs:
            break
    first = materialise(best_of(search(ordered.filter(F.col("level") >= border), items, sc.broadcast([1] * len(rows)), size, top), top), "first")
    bars = [1] * len(rows)
    for item, score in first.filter(F.col("rank") == top).select("item", "score").collect():
        bars[item] = max(1, score)
    second = search(ordered.filter(F.col("level") < border), items, sc.broadcast(bars), size, top)
    return best_of(first.drop("rank").unionByName(second), top)


def report(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    out = None
    for block in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == block).collect()]
        names = spark.createDataFrame(list(enumerate(r[0] for r in rows)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = search_block(docs, rows, top).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
