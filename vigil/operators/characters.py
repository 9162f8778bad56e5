"""Hashed character n-grams of words, by numpy on the distinct words of a slice.

Words repeat within a slice of texts, so each distinct word is cut and hashed once; a
text's features are the union of its words' buckets. The hash is that of Spark's
``HashingTF`` (murmur3 over UTF-8 with its seed), so both give the same features.

A word is padded by a blank on both sides; a padded word that is shorter than an n-gram is
one itself. A text without words, or null, has no feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.tokens import whitespace_tokens

#: Seed of ``HashingTF``.
SEED = 42
#: N-grams of the texts that are worked on at a time; a longer text is a slice of its own.
PIECE = 1 << 19


def distinct_words(text: str) -> Column:
    """Words of a text, each once: the features are binary."""
    return F.array_distinct(whitespace_tokens(F.lower(text)))


def murmur3(data: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Signed 32-bit murmur3 of every row of ``data`` (bytes, rows of one length)."""
    u = np.uint32
    turn = lambda h, r: (h << u(r)) | (h >> u(32 - r))
    mixed = lambda k: turn(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    n, length = data.shape
    padded = np.zeros((n, -(-length // 4) * 4), dtype=np.uint8)
    padded[:, :length] = data
    parts, h = padded.view("<u4"), np.full(n, seed, dtype=u)
    for j in range(length // 4):
        h = turn(h ^ mixed(parts[:, j]), 13) * u(5) + u(0xE6546B64)
    if length % 4:
        h ^= mixed(parts[:, -1])
    h ^= u(length)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``begin[j] .. begin[j] + count[j] - 1``, one span after the other."""
    first = np.cumsum(count) - count
    return np.repeat(begin - first, count) + np.arange(count.sum())


def word_buckets(words: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all ``words``, and how many each word has."""
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    padded = pc.binary_join_element_wise(blank, words.cast(pa.large_string()), blank, none)
    data = np.frombuffer(padded.buffers()[2] or b"", dtype=np.uint8)[: int(pc.sum(pc.binary_length(padded)).as_py() or 0)]
    # Byte positions of the characters, and the one behind the last.
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    length = np.asarray(pc.utf8_length(padded)).astype(np.int64)
    first = np.cumsum(length) - length
    count = [np.maximum(length - n + 1, 1) for n in sizes]
    each = np.sum(count, axis=0)
    out, place = np.empty(each.sum(), dtype=np.int32), np.cumsum(each) - each
    for n, c in zip(sizes, count):
        start = _spans(first, c)
        begin = at[start]
        wide = at[start + np.repeat(np.minimum(length, n), c)] - begin
        found = np.empty(len(start), dtype=np.int32)
        for w in np.unique(wide):
            own = wide == w
            found[own] = murmur3(data[begin[own][:, None] + np.arange(w)]) % buckets
        out[_spans(place, c)] = found
        place = place + c
    return out, each


def text_buckets(lists: pa.Array, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For slices of texts given as lists of words: the texts, the sorted distinct buckets
    of each, one after the other, and how many each has."""
    coded = lists.flatten().dictionary_encode()
    grams, each = word_buckets(coded.dictionary, sizes, buckets)
    begin = np.cumsum(each) - each
    words = np.asarray(coded.indices).astype(np.int64)
    per_text = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    last = np.cumsum(per_text)
    made = np.concatenate(([0], np.cumsum(each[words])))[np.concatenate(([0], last))]
    a = 0
    while a < len(per_text):
        b = max(a + 1, int(np.searchsorted(made, made[a] + PIECE, side="right")) - 1)
        own = words[last[a] - per_text[a] : last[b - 1]]
        text = np.repeat(np.arange(b - a), per_text[a:b])
        keys = np.repeat(text * buckets, each[own]) + grams[_spans(begin[own], each[own])]
        # Sorting beats the hash table of np.unique on keys that mostly differ.
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        yield slice(a, b), (keys % buckets).astype(np.int32), np.bincount(keys // buckets, minlength=b - a)
        a = b


def over_buckets(df: DataFrame, text: str, sizes: tuple[int, ...], buckets: int, made: str, name: str, of_slice) -> DataFrame:
    """``df`` without ``text`` and with the column ``name`` (SQL type ``made``): what
    ``of_slice`` gives for the buckets, and their number per text, of a slice of texts."""
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, distinct_words(text).alias("_words"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` {made}"

    def run(batches):
        for batch in batches:
            for texts, i, n in text_buckets(batch.column("_words"), sizes, buckets):
                part = batch.slice(texts.start, texts.stop - texts.start)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], of_slice(i, n)], names=[*keep, name])

    return rows.mapInArrow(run, schema)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``values`` cut into lists of ``sizes``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def with_buckets(df: DataFrame, text: str, sizes: tuple[int, ...], buckets: int, name: str = "i") -> DataFrame:
    """``df`` without ``text`` and with ``name``, its sorted distinct buckets (array of int)."""
    return over_buckets(df, text, sizes, buckets, "array<int>", name, lists)
