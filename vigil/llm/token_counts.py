"""Token counts of documents in flat token files that have no index.

A flat file is a run of token ids in which an end-of-document id closes each
document; documents begin and end anywhere in its fixed-size blocks. Tasks search
whole blocks for the end id at once with numpy and report, per block, its length, the
number of ends, the place of the last end and the lengths between two ends. A prefix
scan (blocks within runs of ``RUN`` blocks, then the runs of a file) gives each block
the number of ends before it and the tokens left open by the blocks before; so the
first count of a block is completed however many blocks its document spans.

Files are tables (file, block, data) with little-endian ids; :func:`blocks_of_files`
makes them from raw binary files, :func:`write_token_files` from documents.

Defined cases: a document without tokens counts 0; tokens after a file's last end
are a last document with ``closed`` false; an empty file has no documents; null texts
are empty documents; repeated rows are documents of their own; null ids stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import scratch_path

BLOCK_TOKENS = 1 << 16
RUN = 1024


def blocks_of_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw binary files below ``path``; a file is one row of Spark's
    ``binaryFile`` source and so must be below 2 GB."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                view = memoryview(data.as_buffer())
                for at in range(0, len(view), block * width):
                    part = bytes(view[at : at + block * width])
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // (block * width)], pa.int64()), pa.array([part], pa.binary())], names=["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block long, data binary")


def write_token_files(docs: DataFrame, make_encoder, end: int, width: int = 2, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Flat files of all documents, one for each task: the blocks, and the order of
    the documents (file, first, doc_ids). ``make_encoder()`` gives a function from
    text to ids. Written to the shared folder, so recomputed tasks cannot differ."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        encode = make_encoder()
        name, number, done, open_ids, size = str(TaskContext.get().partitionId()), 0, 0, [], 0
        id_kind = None

        def row(block_no, data, first, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([block_no], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(id_kind))],
                names=["file", "block", "data", "first", "doc_ids"],
            )

        for batch in batches:
            id_kind = batch.column("doc_id").type
            ids = batch.column("doc_id").to_pylist()
            for text in batch.column("text").to_pylist():
                open_ids.append(np.array([*(encode(text) if text else ()), end], dtype=kind))
                size += len(open_ids[-1])
                if size >= 4 * block:
                    flat = np.concatenate(open_ids)
                    full = len(flat) // block * block
                    for at in range(0, full, block):
                        yield row(number, flat[at : at + block].tobytes(), None, None)
                        number += 1
                    open_ids, size = [flat[full:]], len(flat) - full
            yield row(None, None, done, ids)
            done += len(ids)
        if size:
            flat = np.concatenate(open_ids)
            for at in range(0, len(flat), block):
                yield row(number, flat[at : at + block].tobytes(), None, None)
                number += 1

    path = scratch_path(spark, "token-files")
    out = docs.select("doc_id", "text").mapInArrow(run, f"file string, block long, data binary, first long, doc_ids array<{id_type}>")
    out.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(out.schema).parquet(path)
    return made.filter("block is not null").select("file", "block", "data"), made.filter("first is not null").select("file", "first", "doc_ids")


def scan(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """file, block, n (tokens), ends, last (place of the last end), head, inner (lengths
    of the documents between two ends)."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        for batch in batches:
            n, ends, last, head, inner = [], [], [], [], []
            for data in batch.column("data").to_pylist():
                ids = np.frombuffer(data, kind)
                at = np.flatnonzero(ids == end)
                n.append(len(ids))
                ends.append(len(at))
                last.append(int(at[-1]) if len(at) else None)
                head.append(int(at[0]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.int64()), pa.array(last, pa.int64()), pa.array(head, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "n", "ends", "last", "head", "inner"],
            )

    return blocks.mapInArrow(run, "file string, block long, n long, ends long, last long, head long, inner array<long>")


def _before(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Exclusive prefix scan: tokens and ends before a row, place of the last end."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n0", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("ends0", F.coalesce(F.sum("ends").over(w), F.lit(0)))
    return rows.withColumn("last0", F.max(F.col("n0") + F.col("last")).over(w))


def counts(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """file, place (of the document in its file), n_tokens, closed."""
    found = scan(blocks, end, width).withColumn("run", F.floor(F.col("block") / RUN))
    local = _before(found, ["file", "run"], "block")
    whole = found.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    ends = local.groupBy("file", "run").agg(F.max(F.col("n0") + F.col("last")).alias("last"))
    runs = _before(whole.join(ends, ["file", "run"]), ["file"], "run")
    runs = runs.select("file", "run", F.col("n0").alias("n1"), F.col("ends0").alias("ends1"), F.col("last0").alias("last1"))
    at = local.join(runs, ["file", "run"])
    # Places count from the file's begin; before the first end the place is -1.
    last = F.coalesce(F.col("n1") + F.col("last0"), F.col("last1"), F.lit(-1))
    open_tokens = F.col("n1") + F.col("n0") - last - 1
    lengths = F.concat(F.array(open_tokens + F.col("head")), F.col("inner"))
    closed = at.filter("ends > 0").select("file", (F.col("ends1") + F.col("ends0")).alias("p"), F.posexplode(lengths).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("p") + F.col("i")).alias("place"), "n_tokens", F.lit(True).alias("closed"))
    total = runs.join(whole.join(ends, ["file", "run"]), ["file", "run"]).groupBy("file").agg(
        F.max(F.col("n1") + F.col("n")).alias("all"), F.max(F.col("ends1") + F.col("ends")).alias("place"), F.max(F.coalesce(F.col("n1") + F.col("last"), F.lit(-1))).alias("last")
    )
    rest = total.select("file", "place", (F.col("all") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.unionByName(rest)


def tiktoken_encoder_of(ranks, pattern: str):
    """Maker of an ``encode`` function for a public vocabulary of broadcast ranks."""

    def make():
        import tiktoken

        return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary

    return make


def report(docs: DataFrame, make_encoder, end: int, width: int = 2) -> DataFrame:
    """doc_id and n_tokens of every document row, counted in the flat files."""
    blocks, order = write_token_files(docs, make_encoder, end, width)
    ids = order.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("place"), "doc_id")
    return ids.join(counts(blocks, end, width), ["file", "place"]).select("doc_id", "n_tokens")
