"""Word n-grams of texts, counted by numpy on the numbered tokens of a slice.

Tokens repeat within a slice of texts, so each distinct token and n-gram is numbered once:
an n-gram is a pair of numbers (its first n-1 tokens, its last one) until its distinct
strings are looked up or summed. The n-grams are those of ``functions.tokens.ngrams``, whose
tokens hold no blank.

A text without tokens, or null, has no n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.characters import lists
from vigil.operators.features import TfidfConfig

#: Tokens of the texts that are worked on at a time; a longer text is a slice of its own.
PIECE = 1 << 19


def text_grams(tokens: pa.Array, cfg: TfidfConfig) -> Iterator[tuple[slice, np.ndarray, np.ndarray, pa.Array]]:
    """For slices of texts given as lists of tokens: the texts, the text and the number of
    every n-gram in them, and the distinct n-grams by number."""
    per_text = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
    last = np.concatenate(([0], np.cumsum(per_text)))
    a = 0
    while a < len(per_text):
        b = max(a + 1, int(np.searchsorted(last, last[a] + PIECE, side="right")) - 1)
        coded = tokens.slice(a, b - a).flatten().cast(pa.large_string()).dictionary_encode()
        words, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        owner = np.repeat(np.arange(b - a), per_text[a:b])
        owners, numbers, terms, made = [], [], [], 0
        # The number of the n-gram that starts at each token.
        number, known = code, words
        for n in range(1, cfg.ngram_max + 1):
            at = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])
            if n > 1:
                pairs, found = np.unique(number[at] * len(words) + code[at + n - 1], return_inverse=True)
                first, second = (known.take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words)))))
                known = pc.binary_join_element_wise(first, second, pa.scalar(" ", pa.large_string()))
                number = np.zeros(len(owner), dtype=np.int64)
                number[at] = found
            if n >= cfg.ngram_min:
                owners.append(owner[at])
                numbers.append(number[at] + made)
                terms.append(known)
                made += len(known)
        yield slice(a, b), np.concatenate(owners), np.concatenate(numbers), pa.concat_arrays(terms)
        a = b


def _runs(owner: np.ndarray, number: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each comes."""
    keys = owner * width + number
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=int)
    return keys[at] // max(1, width), keys[at] % max(1, width), np.diff(np.append(at, len(keys)))


def frequencies(rows: DataFrame, cfg: TfidfConfig, problems: int = 1) -> DataFrame:
    """term, df0, cf0, ... from ``_tokens`` and ``bits``: how many texts that train a problem
    hold the term, and how often. A task sends the terms of a slice of texts, not of each text."""
    names = [f"{n}{k}" for k in range(problems) for n in ("df", "cf")]

    def run(batches):
        for batch in batches:
            bits = np.asarray(batch.column("bits")).astype(np.int64)
            for texts, owner, number, terms in text_grams(batch.column("_tokens"), cfg):
                text, term, tf = _runs(owner, number, len(terms))
                own, sums = bits[texts][text], []
                for k in range(problems):
                    inside = (own >> k) & 1
                    sums += [np.bincount(term, weights=w, minlength=len(terms)).astype(np.int64) for w in (inside, inside * tf)]
                yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), *map(pa.array, sums)], names=["term", *names])

    found = rows.select("bits", "_tokens").mapInArrow(run, ", ".join(["term string", *(f"{n} long" for n in names)]))
    return found.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def weighted(rows: DataFrame, terms: list[str], cfg: TfidfConfig, keep: list[str], idf: list[float] | None = None, names: tuple[str, str] = ("_i", "_w")) -> DataFrame:
    """keep + the places in ``terms`` (sorted) and the weights (tf, by ``idf`` if given) of the
    known n-grams of ``_tokens``. Narrow; ``terms`` are broadcast, at most the model's."""
    shared = rows.sparkSession.sparkContext.broadcast((terms, None if idf is None else np.array(idf, dtype=float)))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", `{names[0]}` array<int>, `{names[1]}` array<double>"

    def run(batches):
        terms, idf = shared.value
        vocabulary = pa.array(terms, pa.large_string())
        for batch in batches:
            for texts, owner, number, found in text_grams(batch.column("_tokens"), cfg):
                place = np.asarray(pc.fill_null(pc.index_in(found, value_set=vocabulary), -1)).astype(np.int64)[number]
                known = place >= 0
                text, i, tf = _runs(owner[known], place[known], len(vocabulary))
                w = np.log(tf) + 1 if cfg.sublinear_tf else tf.astype(float)
                n = np.bincount(text, minlength=texts.stop - texts.start)
                part = batch.slice(texts.start, texts.stop - texts.start)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists(i.astype(np.int32), n), lists(w if idf is None else w * idf[i], n)], names=[*keep, *names])

    return rows.select(*keep, "_tokens").mapInArrow(run, schema)
