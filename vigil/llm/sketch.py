"""Fast similarity sketching of sets of 64-bit hashes, for many sets at once.

``t`` coordinates are filled in rounds. In each of the first ``t`` rounds every
element draws one bin and leaves its value there if the bin was empty before the
round (the smallest value wins); rounds ``t`` to ``2t - 1`` offer all elements to
bin ``round - t``, so that every coordinate is filled in the end. A set leaves as
soon as it is full. Equal coordinates mean the same element in the same round, and
two sets agree in a coordinate with the probability of their Jaccard similarity,
with the concentration of independent samples, also for sets of a few elements.
"""

from __future__ import annotations

import numpy as np

from vigil.llm.words import U64, mix

COORDINATES = 128
ROWS = 4


def sketches(values: np.ndarray, first: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Sketch of each set ``values[first[i]:first[i + 1]]``; no set may be empty."""
    n = len(first) - 1
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    todo, sizes = np.arange(n), np.diff(first)
    elements, owner = values, np.repeat(np.arange(n), sizes)
    for turn in range(2 * t):
        h = mix(elements + U64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64)))
        bins = (h % U64(t)).astype(np.int64) if turn < t else np.full(len(h), turn - t)
        # A round number in the top bits makes any earlier round smaller.
        np.minimum.at(out, owner * t + bins, (U64(turn) << U64(56)) | (h >> U64(8)))
        full = (out.reshape(n, t)[todo] != np.iinfo(np.uint64).max).all(axis=1)
        if full.all():
            break
        if full.any():
            todo = todo[~full]
            stay = np.zeros(n, dtype=bool)
            stay[todo] = True
            at = stay[owner]
            elements, owner = elements[at], owner[at]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 63-bit key for each run of ``rows`` coordinates, different in each band."""
    n, t = sketch.shape
    key = np.zeros((n, t // rows), dtype=np.uint64)
    for j in range(rows):
        key = mix(key + sketch[:, j::rows][:, : t // rows] * U64(2 * j + 1))
    key = mix(key + np.arange(t // rows, dtype=np.uint64) * U64(0xD6E8FEB86659FD95))
    return (key >> U64(1)).astype(np.int64)
