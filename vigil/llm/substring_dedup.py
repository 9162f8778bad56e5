"""Substring dedup: every later copy of a passage of ``WINDOW`` words goes.

Fixed-block anchors. A window of 13 words always holds a whole aligned block of
``BLOCK`` = 7 words of its document, wherever it begins. So

1. the aligned blocks of all documents are the index, and every rolling run of 7
   words is a probe; chunks send the distinct run hashes with a flag for "aligned
   here" and a bucket answers those that are indexed and occur in two documents;
2. hits are extended to the windows of 13 words around them; only these windows
   are sent with the smallest document id of the chunk, under 64 + 32 hash bits;
   their bucket finds the smallest id of all and answers where it is smaller;
3. a window counts if a smaller document has it; windows chain into maximal
   repeats, whose words are removed.

The passes read one shuffle of the texts. Nothing is gathered by passage: a chunk
sends a hash once however often it holds it, so hot passages cost one entry per chunk.

Defined cases: null and empty texts have no words; a null id counts as larger than
any id (so its copies go, it keeps nothing from others); rows with equal ids are not
"smaller" than each other and keep their words; other columns ride along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import exchange as X
from vigil.llm.frames import fresh, plus
from vigil.llm.words import NOT_SPACE, U64, Words, covered, per_text, pieces, raw_texts, sha256_hex, windows

WINDOW = 13
BLOCK = 7
_LAST = np.iinfo(np.int64).max


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()


def chunk_hashes(texts: list[bytes], both: bool = False):
    """Word hashes of a chunk (one or two kinds) and the first word of each text."""
    first, one, two = [0], [], []
    for piece in pieces(texts):
        w = Words(texts[piece], NOT_SPACE, lower=False)
        first += (w.first[1:] + first[-1]).tolist()
        one.append(w.hashes())
        if both:
            two.append(w.hashes(1))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return np.array(first), join(one), join(two)


def word_owner(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.repeat(ids, np.diff(first))


def _anchors(layout: X.Layout, block: int):
    def run(key, table):
        first, h, _ = chunk_hashes(raw_texts(table.column("text")))
        start, run_hash = windows(h, first, block)
        keys = run_hash >> U64(64 - layout.bits)
        begin_of = np.repeat(first[:-1], np.diff(first))
        aligned = (start - begin_of[start]) % block == 0
        owner = word_owner(first, np.arange(len(first) - 1))[start]
        order = np.argsort(keys, kind="stable")
        keys, aligned, owner = keys[order], aligned[order], owner[order]
        if not len(keys):
            return X.message("bucket", [], "chunk", [], [])
        at = X.groups(keys)
        flags = np.maximum.reduceat(aligned.astype(np.uint8), at)
        flags |= (owner[at] != owner[np.append(at[1:], len(keys)) - 1]).astype(np.uint8) << 1
        return X.to_buckets(key[0].as_py(), layout.bits, layout.buckets, keys[at], flags)

    return run


def _anchor_hits(key, table):
    chunks, (keys, flags) = X.gather(table, np.uint8)
    order = np.argsort(keys, kind="stable")
    keys, flags, chunks = keys[order], flags[order], chunks[order]
    at = X.groups(keys)
    count = np.diff(np.append(at, len(keys)))
    any_flag = np.bitwise_or.reduceat(flags, at)
    hit = np.repeat((any_flag & 1 > 0) & ((count > 1) | (any_flag & 2 > 0)), count)
    return X.answer(key[0].as_py(), chunks[hit], keys[hit])


def _hits(table: pa.Table, *kinds: type) -> list[np.ndarray]:
    got = [X.unpack(d, *kinds) for d in table.column("data").to_pylist()]
    if not got:
        return [np.zeros(0, dtype=k) for k in (np.uint64, *kinds)]
    cols = [np.concatenate([g[i] for g in got]) for i in range(len(kinds) + 1)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each value in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _extend(layout: X.Layout, window: int, block: int):
    def run(key, docs, marks):
        (hits,) = _hits(marks)
        if not len(hits) or not docs.num_rows:
            return X.message("bucket", [], "chunk", [], [])
        first, h, h2 = chunk_hashes(raw_texts(docs.column("text")), both=True)
        start, run_hash = windows(h, first, block)
        marked = np.zeros(len(h) + window + 1, dtype=np.int32)
        marked[start[_member(run_hash >> U64(64 - layout.bits), hits) >= 0]] = 1
        total = np.concatenate(([0], np.cumsum(marked)))
        start, wide = windows(h, first, window)
        _, check = windows(h2, first, window)
        near = total[start + window - block + 1] > total[start]
        start, wide, check = start[near], wide[near], (check[near] >> U64(32)).astype(np.uint32)
        if not len(start):
            return X.message("bucket", [], "chunk", [], [])
        owner = word_owner(first, ids_of(docs))[start]
        order = np.lexsort((owner, check, wide))
        wide, check, owner = wide[order], check[order], owner[order]
        at = np.flatnonzero(np.concatenate(([True], (wide[1:] != wide[:-1]) | (check[1:] != check[:-1]))))
        return X.to_buckets(key[0].as_py(), 64, layout.buckets, wide[at], check[at], owner[at])

    return run


def _smallest(key, table):
    chunks, (wide, check, owner) = X.gather(table, np.uint32, np.int64)
    order = np.lexsort((owner, check, wide))
    wide, check, owner, chunks = wide[order], check[order], owner[order], chunks[order]
    at = np.flatnonzero(np.concatenate(([True], (wide[1:] != wide[:-1]) | (check[1:] != check[:-1]))))
    least = np.repeat(owner[at], np.diff(np.append(at, len(wide))))
    told = least < owner
    return X.answer(key[0].as_py(), chunks[told], wide[told], check[told], least[told])


def _removed(docs: pa.Table, told: pa.Table, window: int):
    """Texts of the chunk and a flag for every word that goes."""
    texts = raw_texts(docs.column("text"))
    wide, check, least = _hits(told, np.uint32, np.int64)
    first, h, h2 = chunk_hashes(texts, both=True)
    start, mine = windows(h, first, window)
    mine2 = (windows(h2, first, window)[1] >> U64(32)).astype(np.uint32)
    owner = word_owner(first, ids_of(docs))[start]
    best = owner.copy()
    if len(start):
        order = np.lexsort((owner, mine2, mine))
        a, b = mine[order], mine2[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        best[order] = np.repeat(owner[order][at], np.diff(np.append(at, len(start))))
        place = _member(mine, wide)
        while len(wide):
            # Equal first hashes are told apart by the second.
            other = (place >= 0) & (check[place] != mine2)
            if not other.any():
                break
            after = place[other] + 1
            same = (after < len(wide)) & (wide[np.minimum(after, len(wide) - 1)] == mine[other])
            place[other] = np.where(same, after, -1)
        best = np.where(place >= 0, np.minimum(best, least[place] if len(least) else best), best)
    return texts, first, covered(start[best < owner], window, len(h))


def kept_texts(texts: list[bytes], first: np.ndarray, gone: np.ndarray):
    """For each text: kept words joined by one space; the text with the removed runs cut out."""
    words, cut = [], []
    for piece in pieces(texts):
        part, at = texts[piece], first[piece.start]
        w = Words(part, NOT_SPACE, lower=False)
        keep = ~gone[at : at + w.n]
        buf = np.append(w.buf, np.uint8(0x20))
        buf[w.end] = 0x20
        steps = np.zeros(len(buf) + 1, dtype=np.int8)
        steps[w.start[keep]] += 1
        steps[w.end[keep] + 1] -= 1
        out = buf[np.cumsum(steps[:-1], dtype=np.int8) > 0].tobytes()
        sizes = per_text(np.where(keep, w.end - w.start + 1, 0), w.first)
        lost = per_text(~keep, w.first)
        to = offset = 0
        for i, t in enumerate(part):
            words.append(out[to : to + max(0, sizes[i] - 1)])
            to += sizes[i]
            if lost[i]:
                a, b = w.first[i], w.first[i + 1]
                edge = np.diff(np.concatenate(([0], (~keep[a:b]).astype(np.int8), [0])))
                bits, last = [], 0
                for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    bits.append(t[last : w.start[a + s] - offset])
                    last = w.end[a + e - 1] - offset
                cut.append(b"".join([*bits, t[last:]]))
            else:
                cut.append(t)
            offset += len(t) + 1
    return words, cut


def _result(docs: DataFrame, window: int, block: int, schema: str, make) -> DataFrame:
    """The three passes; ``make(docs, texts, first, gone)`` gives the rows of a chunk."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it begins")
    layout = X.Layout.of(docs)
    parts, chunk = X.chunked(docs, layout)
    by_chunk = parts.groupBy(chunk)
    marks = by_chunk.applyInArrow(_anchors(layout, block), X.TO_BUCKET).groupBy("bucket").applyInArrow(_anchor_hits, X.TO_CHUNK)
    wide = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(_extend(layout, window, block), X.TO_BUCKET)
    told = wide.groupBy("bucket").applyInArrow(_smallest, X.TO_CHUNK)
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(lambda left, right: make(left.drop_columns([chunk]), *_removed(left, right, window)), schema)


def report(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document row."""
    docs = docs.select("doc_id", "text")

    def make(left: pa.Table, texts, first, gone) -> pa.Table:
        words, _ = kept_texts(texts, first, gone)
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_words": pa.array(np.diff(first), pa.int64()),
                "n_removed": pa.array(per_text(gone, first), pa.int64()),
                "kept_sha256": pa.array([sha256_hex(t) for t in words], pa.string()),
            }
        )

    return _result(docs, window, block, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string", make)


def dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` with the later copies cut from the texts; white space around kept words
    stays. A document that loses all its words goes; ``n_chars`` follows a changed text."""
    lost, cut = fresh("lost_words", docs.columns), fresh("cut_text", docs.columns)
    left_words = fresh("left_words", docs.columns)

    def make(left: pa.Table, texts, first, gone) -> pa.Table:
        _, changed = kept_texts(texts, first, gone)
        n = per_text(gone, first)
        new = pa.array([t.decode() if k else None for t, k in zip(changed, n)], pa.string())
        return left.append_column(lost, pa.array(n, pa.int64())).append_column(left_words, pa.array(np.diff(first) - n, pa.int64())).append_column(cut, new)

    schema = plus(docs.schema, **{lost: "long", left_words: "long", cut: "string"})
    found = _result(docs, window, block, schema, make).filter((F.col(lost) == 0) | (F.col(left_words) > 0))
    cols = {c: F.col(c) for c in docs.columns}
    cols["text"] = F.coalesce(cut, "text")
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return found.select(*[e.alias(c) for c, e in cols.items()])
