"""Minimal acyclic transducer from byte strings to id lists, in one flat buffer.

Sorted words are added one by one; equal tails share their states. Every arc carries
how many words the arcs before it lead to, so the sum along a path numbers the
words and the number selects the ids: a transducer with additive outputs. The
buffer has no pointers, so it can be memory-mapped and shared by processes.
"""

from __future__ import annotations

import mmap
from array import array

import numpy as np

_HEAD = 6


def compile_words(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """Buffer of a transducer for ``words``."""
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []
    path: list[list] = [[False, []]]
    last = b""

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            is_final, out = path.pop()
            key = (is_final, tuple(out))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                final.append(is_final)
            parent = path[-1]
            parent[1][-1] = (parent[1][-1][0], register[key])

    order = sorted(words)
    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        freeze(same)
        for byte in word[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    arcs.append(tuple(path[0][1]))
    final.append(path[0][0])
    reach = [0] * len(arcs)
    first, labels, targets, skips = array("i"), bytearray(), array("i"), array("i")
    for s, out in enumerate(arcs):  # targets are frozen before their sources
        first.append(len(labels))
        total = int(final[s])
        for byte, target in out:
            labels.append(byte)
            targets.append(target)
            skips.append(total)
            total += reach[target]
        reach[s] = total
    first.append(len(labels))
    at, ids = array("i", [0]), array("i")
    for word in order:
        ids.extend(words[word])
        at.append(len(ids))
    ends = bytes(final)
    labels += b"\0" * (-len(labels) % 4)
    head = array("i", [len(arcs), len(targets), len(order), len(ids), len(labels), len(ends)])
    return b"".join([head.tobytes(), first.tobytes(), targets.tobytes(), skips.tobytes(), at.tobytes(), ids.tobytes(), bytes(labels), ends])


class Transducer:
    """Reader of a compiled buffer: ``bytes`` or a memory map."""

    def __init__(self, data: bytes | mmap.mmap):
        view = memoryview(data)
        head = view[: 4 * _HEAD].cast("i")
        self.states, n_arcs, n_words, n_ids, n_labels, n_ends = head
        offset = 4 * _HEAD

        def ints(n: int) -> memoryview:
            nonlocal offset
            part = view[offset : offset + 4 * n].cast("i")
            offset += 4 * n
            return part

        self.first, self.target, self.skip = ints(self.states + 1), ints(n_arcs), ints(n_arcs)
        self.at, self.ids = ints(n_words + 1), ints(n_ids)
        self.data, self.labels, self.ends = data, offset, offset + n_labels
        self.words = n_words
        self.arcs: np.ndarray | None = None

    @classmethod
    def mapped(cls, path: str) -> "Transducer":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, word: bytes) -> tuple[int, ...] | None:
        """Ids of ``word``, None if it was not compiled."""
        state, number, data, base = self.states - 1, 0, self.data, self.labels
        for i in range(len(word)):
            arc = data.find(word[i : i + 1], base + self.first[state], base + self.first[state + 1]) - base
            if arc < 0:
                return None
            number += self.skip[arc]
            state = self.target[arc]
        if not data[self.ends + state]:
            return None
        return tuple(self.ids[self.at[number] : self.at[number + 1]])

    def find_all(self, words: list[bytes]) -> list[bytes | None]:
        """For each word what :meth:`find` gives, as little-endian 32-bit integers. All
        words take their next arc at once; the arcs are sorted by state and label."""
        first = np.asarray(self.first, dtype=np.int64)
        if self.arcs is None:
            labels = np.frombuffer(self.data, np.uint8, len(self.target), self.labels)
            self.arcs = np.repeat(np.arange(self.states) << 8, np.diff(first)) | labels
        if not len(words) or not len(self.arcs):  # at most the empty word was compiled
            return [None if (ids := self.find(w)) is None else array("I", ids).tobytes() for w in words]
        target, skip = np.asarray(self.target), np.asarray(self.skip)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(len(words), self.states - 1), np.zeros(len(words), dtype=np.int64)
        live, done = np.flatnonzero(sizes > 0), 0
        while len(live):
            key = state[live] << 8 | data[begin[live] + done]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            met = self.arcs[arc] == key
            number[live[~met]] = -1
            live, arc = live[met], arc[met]
            number[live] += skip[arc]
            state[live] = target[arc]
            done += 1
            live = live[sizes[live] > done]
        ends = np.frombuffer(self.data, np.uint8, self.states, self.ends)
        number[ends[state] == 0] = -1
        at, ids = np.asarray(self.at), memoryview(self.ids).cast("B")
        ranges = zip(number.tolist(), (4 * at[number]).tolist(), (4 * at[number + 1]).tolist())
        return [bytes(ids[a:b]) if n >= 0 else None for n, a, b in ranges]
