"""Benchmark decontamination: find test passages in training texts and cut them.

Items are cut into windows of ``window`` normalised words (an item with fewer
words is one window of its own length). Their hashes are broadcast once and every
window of every text is probed; a hit counts only if its words are equal. The
broadcast is allowed up to ``MAX_BROADCAST_BYTES`` of item text; a larger
benchmark is joined on the window hash instead (:func:`hits_by_join`), a shuffle of
(hash, document, position) rows, with the same result.

Defined cases: a null or empty text has no words and no hit; a null or wordless
item has no window; a null ``item_id`` counts as one item named by the empty
string; repeated item rows count once per id; repeated document rows are judged
one by one; an empty benchmark hits nothing; only ``doc_id`` and ``text`` are read,
so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.frames import fresh, plus
from vigil.llm.words import ALNUM, Words, covered, per_text, pieces, raw_texts, sha256_hex, windows

WINDOW = 10
MAX_BROADCAST_BYTES = 32 << 20
#: A document with at least this share of hit words is dropped, not cut.
DROP_SHARE = 0.5
_FLAG_BITS = 20


@dataclass
class Index:
    """Windows of one length: sorted hashes, a coarse flag table, words and items."""

    size: int
    hashes: np.ndarray
    flags: np.ndarray
    items: dict[bytes, tuple[str, ...]]


def build_index(items: list[tuple[str, bytes]], window: int) -> list[Index]:
    found: dict[int, dict[bytes, set[str]]] = {}
    hashes: dict[int, set[int]] = {}
    for item_id, text in items:
        w = Words([text], ALNUM, lower=True)
        size = min(window, w.n)
        if not size:
            continue
        starts, h = windows(w.hashes(), w.first, size)
        names = [w.word(i) for i in range(w.n)]
        hashes.setdefault(size, set()).update(h.tolist())
        for s in starts:
            found.setdefault(size, {}).setdefault(b" ".join(names[s : s + size]), set()).add(item_id)
    out = []
    for size, keys in found.items():
        h = np.array(sorted(hashes[size]), dtype=np.uint64)
        flags = np.zeros(1 << _FLAG_BITS, dtype=bool)
        flags[(h >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True
        out.append(Index(size, h, flags, {k: tuple(sorted(v)) for k, v in keys.items()}))
    return out


def without(part: list[bytes], w: Words, hit: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of ``w`` without their hit words, each run cut from its first to its last byte."""
    out, offset = [], 0
    for i, t in enumerate(part):
        if counts[i]:
            a, b = w.first[i], w.first[i + 1]
            edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
            kept, last = [], 0
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                kept.append(t[last : w.start[a + s] - offset])
                last = w.end[a + e - 1] - offset
            out.append(b"".join([*kept, t[last:]]))
        else:
            out.append(t)
        offset += len(t) + 1
    return out


def scan(texts: list[bytes], index: list[Index]):
    """For each text: words, hit words, ids of the items found, text without the hits.

    A run of hit words is cut from its first to its last byte.
    """
    n_words, n_hit, items, cut = [], [], [], []
    for piece in pieces(texts):
        part = texts[piece]
        w = Words(part, ALNUM, lower=True)
        h, of = w.hashes(), w.text_of()
        hit, seen = np.zeros(w.n, dtype=bool), [set() for _ in part]
        for ix in index:
            starts, wh = windows(h, w.first, ix.size)
            maybe = np.flatnonzero(ix.flags[(wh >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)])
            at = np.searchsorted(ix.hashes, wh[maybe])
            maybe = maybe[ix.hashes[np.minimum(at, len(ix.hashes) - 1)] == wh[maybe]]
            good = []
            for s in starts[maybe].tolist():
                ids = ix.items.get(b" ".join([w.word(i) for i in range(s, s + ix.size)]))
                if ids:
                    good.append(s)
                    seen[of[s]].update(ids)
            if good:
                hit |= covered(np.array(good), ix.size, w.n)
        counts = per_text(hit, w.first)
        n_words += np.diff(w.first).tolist()
        n_hit += counts.tolist()
        items += [sorted(s) for s in seen]
        cut += without(part, w, hit, counts)
    return n_words, n_hit, items, cut


def _broadcast_index(docs: DataFrame, benchmark: DataFrame, window: int):
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").filter("text is not null").collect()
    return docs.sparkSession.sparkContext.broadcast(build_index([(r[0], r[1].encode()) for r in rows], window))


def fits(benchmark: DataFrame) -> bool:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size <= MAX_BROADCAST_BYTES


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), items_sha256, contaminated per document row."""
    docs = docs.select("doc_id", "text")
    if not fits(benchmark):
        return hits_by_join(docs, benchmark, window)
    index = _broadcast_index(docs, benchmark, window)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"

    def run(batches):
        for batch in batches:
            n_words, n_hit, items, _ = scan(raw_texts(batch.column("text")), index.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([sha256_hex(",".join(x).encode()) for x in items], pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
            )

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = DROP_SHARE) -> DataFrame:
    """``docs`` without test passages: hit words are cut from the text, and a
    document with ``drop_share`` of its words hit is removed. Other rows and
    columns stay as they are; ``n_chars`` follows a changed text. A benchmark above the
    broadcast bound is joined: each text gets the places of its hit words."""
    columns = docs.columns
    share, cut = fresh("hit_share", columns), fresh("cut_text", columns)
    if fits(benchmark):
        index, at = _broadcast_index(docs, benchmark, window), None
        source = docs
    else:
        index, at = None, fresh("hit_places", docs.columns)
        row = fresh("row", docs.columns)
        places = _hits(docs, benchmark, window, row)[1].select(row, F.explode(F.expr("sequence(i, i + k - 1)")).alias("p"))
        places = places.groupBy(row).agg(F.collect_set("p").alias(at))
        source = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(places, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], at)

    def marked(texts: list[bytes], found: list) -> tuple[list, list, list]:
        n_words, n_hit, changed = [], [], []
        for t, at in zip(texts, found):
            w = Words([t], ALNUM, lower=True)
            hit = np.zeros(w.n, dtype=bool)
            hit[np.array(at or [], dtype=np.int64)] = True
            n_words.append(w.n)
            n_hit.append(int(hit.sum()))
            changed += without([t], w, hit, hit.sum(keepdims=True))
        return n_words, n_hit, changed

    def run(batches):
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            if at is None:
                n_words, n_hit, _, changed = scan(texts, index.value)
            else:
                n_words, n_hit, changed = marked(texts, batch.column(at).to_pylist())
            part = pa.array([h / n if n else 0.0 for h, n in zip(n_hit, n_words)], pa.float64())
            new = pa.array([c.decode() if h else None for c, h in zip(changed, n_hit)], pa.string())
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, part, new], names=[*columns, share, cut])

    schema = plus(docs.schema, **{share: "double", cut: "string"})
    seen = source.mapInArrow(run, schema).filter(F.col(share) < drop_share)
    cols = {c: F.col(c) for c in docs.columns}
    cols["text"] = F.coalesce(cut, "text")
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return seen.select(*[e.alias(c) for c, e in cols.items()])


def _word_list(text):
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, row: str) -> tuple[DataFrame, DataFrame]:
    """(row, w: words) of the distinct texts, and their hits (row, i, k, ids): windows as
    rows, joined on their words. Items are pre-aggregated by window, so no window meets
    more than one row."""

    def window_rows(df, key, sizes):
        starts = F.expr("sequence(0, size(w) - k)")
        at = df.select(key, "w", F.explode(sizes).alias("k")).filter("k > 0 and size(w) >= k").select(key, "w", "k", F.explode(starts).alias("i"))
        return at.select(key, "k", "i", F.array_join(F.slice("w", F.col("i") + 1, F.col("k")), " ").alias("words"))

    texts = docs.select(F.xxhash64("doc_id", "text").alias(row), "text").groupBy(row).agg(F.first("text").alias("text"))
    texts = texts.select(row, _word_list(F.coalesce("text", F.lit(""))).alias("w"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _word_list(F.coalesce("text", F.lit(""))).alias("w"))
    item_rows = window_rows(items, "item", F.array(F.least(F.lit(window), F.size("w")))).groupBy("k", "words").agg(F.collect_set("item").alias("ids"))
    doc_rows = window_rows(texts, row, F.array(*[F.lit(k) for k in range(1, window + 1)]))
    return texts, doc_rows.join(item_rows, ["k", "words"]).select(row, "i", "k", "ids")


def hits_by_join(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The report for a benchmark too large to broadcast."""
    row = fresh("row", docs.columns)
    hits = _hits(docs, benchmark, window, row)[1]
    docs = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    words = hits.select(row, F.explode(F.expr("sequence(i, i + k - 1)")).alias("at")).distinct().groupBy(row).agg(F.count("*").alias("n_hit"))
    ids = hits.select(row, F.explode("ids").alias("id")).groupBy(row).agg(F.sort_array(F.collect_set("id")).alias("items"))
    found = words.join(ids, row)
    none = F.array().cast("array<string>")
    out = docs.select("doc_id", row, F.size(_word_list(F.coalesce("text", F.lit("")))).cast("long").alias("n_words")).join(found, row, "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
