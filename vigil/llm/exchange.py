"""Exchange of hashes between chunks of documents and buckets of hash space.

Documents are dealt into chunks of bounded size by their id. A chunk sends each
bucket ONE packed row with the distinct hashes that fall into the bucket's range,
so a passage that a third of all rows share costs one entry per chunk and no group
grows with the number of copies. Buckets answer with one packed row per chunk.
Sorted hashes travel as the byte planes of their differences; the upper planes are
zero and vanish in the shuffle's compression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.frames import fresh

U64 = np.uint64
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
LEAST = 24


@dataclass(frozen=True)
class Layout:
    """Sizes that follow from the bytes of all texts: chunks and buckets grow with the
    input, so that neither grows itself; ``bits`` keeps chance hits equally rare,
    ``size`` is those bytes."""

    chunks: int
    buckets: int
    bits: int
    size: int

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text") -> "Layout":
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        return cls(max(LEAST, -(-size // CHUNK_BYTES)), max(LEAST, -(-size // BUCKET_BYTES)), min(56, max(36, int(size).bit_length() + 8)), int(size))


def chunked(docs: DataFrame, layout: Layout) -> tuple[DataFrame, str]:
    """``docs`` with its chunk as first column, and that column's name."""
    name = fresh("chunk", docs.columns)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.chunks)).cast("int").alias(name)
    return docs.select(chunk, "*"), name


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes; the first is sorted and kept as differences."""
    first = columns[0].astype(np.uint64)
    out = [np.array([len(first)], dtype=np.int64).tobytes(), _planes(np.diff(first, prepend=U64(0)))]
    return b"".join([*out, *map(_planes, columns[1:])])


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns of :func:`pack`: the first as uint64, the others by ``kinds``."""
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in (np.uint64, *kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def split_by_bucket(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted ``keys`` of ``bits`` bits: equal ranges."""
    step = ((1 << bits) + buckets - 1) // buckets
    return np.searchsorted(keys, np.array([min(i * step, (1 << 64) - 1) for i in range(buckets)] + [(1 << 64) - 1], dtype=np.uint64))


def to_buckets(chunk: int, bits: int, buckets: int, *columns: np.ndarray) -> pa.Table:
    """Rows (bucket, chunk, data) with the packed columns; the first is sorted."""
    border = split_by_bucket(columns[0], bits, buckets)
    rows = [(b, pack(*[c[border[b] : border[b + 1]] for c in columns])) for b in range(buckets) if border[b] < border[b + 1]]
    return message("bucket", [r[0] for r in rows], "chunk", [chunk] * len(rows), [r[1] for r in rows])


def message(to: str, targets: list[int], of: str, sources: list[int], data: list[bytes]) -> pa.Table:
    return pa.table({to: pa.array(targets, pa.int32()), of: pa.array(sources, pa.int32()), "data": pa.array(data, pa.binary())})


TO_BUCKET = "bucket int, chunk int, data binary"
TO_CHUNK = "chunk int, bucket int, data binary"


def gather(table: pa.Table, *kinds: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """All packed rows of a bucket: the sender of each entry, and the columns."""
    sent = [unpack(d, *kinds) for d in table.column("data").to_pylist()]
    chunks = np.repeat(np.array(table.column("chunk").to_pylist(), dtype=np.int64), [len(s[0]) for s in sent])
    return chunks, [np.concatenate([s[i] for s in sent]) for i in range(len(kinds) + 1)]


def groups(keys: np.ndarray) -> np.ndarray:
    """Begin of each run of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def answer(bucket: int, chunks: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One packed row per chunk with its part of the columns, sorted by the first."""
    order = np.lexsort((columns[0], chunks))
    chunks, columns = chunks[order], [c[order] for c in columns]
    begin = groups(chunks) if len(chunks) else np.zeros(0, dtype=np.int64)
    end = np.append(begin[1:], len(chunks)) if len(begin) else begin
    rows = [pack(*[c[a:b] for c in columns]) for a, b in zip(begin, end)]
    return message("chunk", chunks[begin].tolist(), "bucket", [bucket] * len(rows), rows)
