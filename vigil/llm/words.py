"""Words of many texts at once: numpy arrays of positions and 64-bit hashes.

A batch of texts is joined into one byte buffer; a table of 256 flags finds the
words, and blocks of eight bytes are scrambled into the hashes of all words at once
(words above ``LONG_WORD`` bytes one by one with BLAKE2), so no Python loop runs over
common words. Null texts count as empty. Work is cut into pieces of bounded
size, a single longer text being a piece of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 1 << 21

_SPACE = [0x20, *range(0x09, 0x0E)]
#: Flags per byte: part of a word between white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[_SPACE] = False
#: Flags per byte: digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: Words above so many bytes are hashed one by one.
LONG_WORD = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SEED = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD95))


def _hash(blocks: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, kind: int) -> np.ndarray:
    """Hash of the bytes from each ``start``: blocks of eight, each scrambled with what the
    blocks before gave; ``blocks`` has the eight bytes from every place on."""
    h = mix(size.astype(np.uint64) * U64(2) + _SEED[kind])
    h = mix(h ^ (blocks[start] & _KEEP[np.minimum(size, 8)])) + _SEED[kind]
    at = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(at):
        h[at] = mix(h[at] ^ (blocks[start[at] + done] & _KEEP[np.minimum(size[at] - done, 8)])) + _SEED[kind]
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]], digest_size=8, salt=bytes([kind])).digest(), "little")
    return mix(h)


class Words:
    """Words of a piece: ``start`` and ``end`` in ``buf``; ``first`` has the word
    number at which each text begins and, last, the number of words."""

    def __init__(self, texts: list[bytes], flags: np.ndarray, lower: bool):
        joined = b"\n".join(texts)
        buf = np.frombuffer(joined, dtype=np.uint8)
        self.buf = LOWER[buf] if lower else buf
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = flags[self.buf]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.first = np.searchsorted(self.start, begins)
        self.first[-1] = len(self.start)
        self.n = len(self.start)

    def hashes(self, kind: int = 0) -> np.ndarray:
        """One 64-bit hash per word; ``kind`` 0 and 1 are independent."""
        return self.prefix_hashes((), kind)[0]

    def prefix_hashes(self, lengths: Iterable[int], kind: int = 0) -> list[np.ndarray]:
        """Hashes of the whole words, then of their first bytes for each of ``lengths``."""
        if not self.n:
            return [np.zeros(0, dtype=np.uint64) for _ in (0, *lengths)]
        padded = np.concatenate((self.buf, np.zeros(8, dtype=np.uint8)))
        blocks = np.ndarray(len(self.buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
        ends = (self.end, *[np.minimum(self.start + n, self.end) for n in lengths])
        return [_hash(blocks, padded, self.start, end - self.start, kind) for end in ends]

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``size`` words that lies in one text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    inside = np.ones(n, dtype=bool)
    for back in range(1, size):
        at = first[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    factor = mix(np.arange(1, size + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += h[j : j + n] * factor[j]
    start = np.flatnonzero(inside)
    return start, mix(total[start])


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Flags of the ``n`` words that lie in a run from one of ``starts``."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word) for each text."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[slice]:
    """Consecutive slices of ``texts`` with at most ``limit`` bytes or one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def parts_of(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` has at most ``limit`` bytes, or one row: what
    is made from a slice stays small however many rows Spark puts into a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = np.frombuffer(batch.column(column).buffers()[1], dtype=np.int64 if pa.types.is_large_string(batch.column(column).type) else np.int32)
        offsets = offsets[batch.column(column).offset : batch.column(column).offset + batch.num_rows + 1]
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
