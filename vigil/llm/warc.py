"""WARC archives: written by Spark's text sink, read back by a salvage reader.

Writing. A record is one row; payloads that occur again become ``revisit`` records of
the one with the smallest id. Records are gzip members, or plain, and go to files
through the text sink, whose line separator is the byte that every record ends with
(a member's last byte is zero below 16 MiB; a larger one gets an empty member behind
it). So archives are ordinary concatenated members on any file system Spark can write.

Reading. Spark's text source cuts the raw bytes at the three bytes that begin a member,
or at the version line of plain records, in splits, and keeps the rows of a split in
order (:func:`pieces`). Each piece is a candidate. A member that is not complete takes
the next piece, since the three bytes also occur inside members; one whose checks fail
(inflation, CRC and size, version, fields, length, block and payload digests) is
quarantined, and the search goes on at the next candidate, so later records are
recovered. Bytes that belong to no record come back as ``gap`` rows with offset, length
and reason. Where a candidate is still open at the end of a split, its file is read
again in file order by one streaming task; all other files stay split. Offsets follow
from the lengths of the pieces, summed over the splits of a file.

Memory of a task is bounded by the largest record, or ``LONGEST`` for a claimed length.

Defined cases: null payloads are empty; null addresses have no target field; null ids
give an id without number and are never the first of equal payloads if another id is
there; rows with equal payload and equal id are written alike, each as ``response`` if
the id is the smallest; empty tables give no records, empty files no rows; files that
end in .gz are read whole (below 2 GB), as Spark would unpack them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import materialise, scratch_path

MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: A member without content, whose last byte is zero.
EMPTY_MEMBER = MEMBER + bytes(6) + b"\xff\x03" + bytes(9)
END = b"\r\n\r\n"
#: Claims beyond this many bytes fail the length check.
LONGEST = 1 << 30
LEVEL = 6
#: File names that are broadcast; more are joined.
BROADCAST_FILES = 100_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:page:{}>"
NOT_GZ = "{*[!z],*[!g]z,*[!.]gz}"


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """Bytes of one record of a page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = ID.format("" if page_id is None else page_id)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", ID.format("" if refers_to is None else refers_to))]
    fields += [
        ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    """One gzip member; its last byte is zero."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, compress: bool = True, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``path``.

    Payloads of at least ``least_bytes`` bytes are stored once."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    # Copies are summed up before the shuffle; one row per distinct payload is joined.
    first = rows.groupBy("key").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "key").withColumn("revisit", (F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, payload, to, revisit in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "revisit")]):
                data = record(page_id, url, payload, to, revisit, date)
                out.append(member(data)[:-1] if compress else data[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["data"])

    made = rows.select("page_id", "url", "payload", "first", "revisit").mapInArrow(run, "data binary")
    made.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\0" if compress else "\n").option("compression", "none").text(path)


def pieces(spark: SparkSession, path: str, mark: bytes) -> DataFrame:
    """file, size, split, place, data: the bytes of the files below ``path`` between two
    marks, in order by split and place; the first row of a file has no mark before it."""
    raw = spark.read.option("recursiveFileLookup", "true").option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).option("pathGlobFilter", NOT_GZ).text(path)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split")]
    return raw.select(*meta, F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("data"))


def whole_pieces(spark: SparkSession, path: str, mark: bytes) -> DataFrame:
    """The rows of :func:`pieces` for files that end in .gz."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                view, at, place = bytes(content.as_buffer()), 0, 0
                while at <= len(view) and view:
                    end = view.find(mark, at)
                    end = len(view) if end < 0 else end
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(view)], pa.int64()), pa.array([0], pa.int64()), pa.array([place], pa.int64()), pa.array([view[at:end]], pa.binary())], names=["file", "size", "split", "place", "data"])
                    at, place = end + len(mark), place + 1

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, size long, split long, place long, data binary")


class Failed(Exception):
    """A check of a candidate failed."""


def parse(data: bytes) -> tuple[dict, int] | None:
    """The record at the begin of ``data`` and its length; None where bytes are missing."""
    head = data.find(END)
    if head < 0:
        if data.count(b"\r\n") and not re.match(rb"WARC/1\.[01]\r\n", data):
            raise Failed("version")
        return None
    lines = data[:head].decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Failed("version")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and fields:
            fields[next(reversed(fields))] += " " + line.strip()
        elif not colon:
            raise Failed("fields")
        else:
            fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= set(fields):
        raise Failed("fields")
    size = int(fields["content-length"])
    if size > LONGEST:
        raise Failed("length")
    total = head + 4 + size + 4
    if len(data) < total:
        return None
    if data[total - 4 : total] != END:
        raise Failed("length")
    block = data[head + 4 : total - 4]
    _same(fields.get("warc-block-digest"), block, "block digest")
    payload, n = block, size
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(END)
        n = len(payload)
        if fields["warc-type"] == "revisit":
            length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
            n = int(length[1]) if length else None
    known = fields.get("warc-payload-digest")
    if fields["warc-type"] == "revisit":
        payload = None
    else:
        _same(known, payload, "payload digest")
    return {
        "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_digest": known.split(":", 1)[-1] if known else payload is not None and digest(payload) or None,
        "payload_bytes": n, "payload": payload,
    }, total


def _same(known: str | None, data: bytes, what: str) -> None:
    """Compares a SHA-1 digest field; other kinds of digest are not checked."""
    if known and known.lower().startswith("sha1:") and known[5:] != digest(data):
        raise Failed(what)


class Plain:
    """A candidate among plain records: fed with pieces until it is complete."""

    mark = VERSION

    def __init__(self):
        self.data, self.missing = bytearray(), 0

    def feed(self, piece: bytes) -> tuple[list[dict], int] | None:
        """Records and the bytes left behind them, or None where more is needed."""
        self.data += self.mark + piece
        if len(self.data) < self.missing:
            return None
        found = parse(bytes(self.data))
        if found is None:
            head = self.data.find(END)
            length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)\r\n", bytes(self.data[: head + 2])) if head >= 0 else None
            self.missing = head + 8 + int(length[1]) if length else 0
            return None
        return [found[0]], len(self.data) - found[1]


class Member:
    """A candidate among gzip members."""

    mark = MEMBER

    def __init__(self):
        self.inflate, self.out, self.size = zlib.decompressobj(31), [], 0

    def feed(self, piece: bytes) -> tuple[list[dict], int] | None:
        try:
            self.out.append(self.inflate.decompress(self.mark + piece))
        except zlib.error:
            raise Failed("member") from None
        self.size += len(self.out[-1])
        if self.size > LONGEST + (1 << 20):
            raise Failed("length")
        if not self.inflate.eof:
            return None
        data, at, found = b"".join(self.out), 0, []
        while at < len(data):
            one = parse(data[at:])
            if one is None:
                raise Failed("length")
            found.append(one[0])
            at += one[1]
        return found, len(self.inflate.unused_data)


def salvage(rows: Iterator[bytes], kind: type, first: bool, last: bool) -> Iterator[tuple]:
    """Walks the pieces of a run in order. Yields ("record", offset, length, record),
    ("gap", offset, length, reason) and at the end ("size", bytes, 0, None); offsets count
    from the run's begin. ``first``: the first piece has no mark before it, being a file's
    begin. A candidate that is open at the end is a gap if this is the ``last`` run, and
    the search goes on behind its mark; else ("open", offset, length, None)."""
    step, at, candidate, held, todo = len(kind.mark), 0, None, [], deque()

    def drop(reason: str) -> tuple:
        nonlocal at, candidate
        gap = ("gap", at, step + len(held[0]), reason)
        at += gap[2]
        todo.extendleft(reversed(held[1:]))
        candidate = None
        return gap

    def drain():
        nonlocal at, candidate, held
        while todo:
            if candidate is None:
                candidate, held = kind(), []
            held.append(todo.popleft())
            try:
                found = candidate.feed(held[-1])
            except Failed as e:
                yield drop(str(e))
                continue
            if found is None:
                continue
            length = sum(step + len(p) for p in held) - found[1]
            for one in found[0]:
                yield "record", at, length, one
            if found[1]:
                yield "gap", at + length, found[1], "after a record"
            at += length + found[1]
            candidate = None

    for piece in rows:
        if first:
            first = False
            if piece:
                yield "gap", 0, len(piece), "no mark"
            at = len(piece)
            continue
        todo.append(piece)
        yield from drain()
    while last and candidate is not None:
        yield drop("cut off")
        yield from drain()
    if candidate is not None:
        length = sum(step + len(p) for p in held)
        yield "open", at, length, None
        at += length
    yield "size", at, 0, None


FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"
FOUND = f"file string, split long, at long, length long, kind string, reason string, {FIELDS}, payload binary"
NAMES = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
BATCH_BYTES = 8 << 20


def _walk(kind: type, payload: bool, whole: bool):
    """The mapInArrow function that walks runs of pieces: splits, or whole files."""

    def run(batches):
        rows, held = [], 0

        def out():
            nonlocal rows, held
            schema = ["file", "split", "at", "length", "kind", "reason", *NAMES]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.string()] * 5, pa.int64(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema)
            rows, held = [], 0
            return made

        def each():
            for batch in batches:
                data = batch.column("data")
                for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in ("file", "split", "size")])):
                    yield key, data[i].as_py()

        source = each()
        now = next(source, None)
        while now is not None:
            file, split, size = now[0]

            def same():
                nonlocal now
                while now is not None and now[0][0] == file and (whole or now[0][1] == split):
                    piece = now[1]
                    now = next(source, None)
                    yield piece

            for what, at, length, more in salvage(same(), kind, split == 0, whole):
                one = more if what == "record" else {}
                data = one.get("payload") if payload else None
                held += len(data or b"")
                rows.append((file, split, at, size if what == "size" else length, what, more if what == "gap" else None, *[one.get(n) for n in NAMES[:-1]], data))
                if len(rows) >= 1000 or held > BATCH_BYTES:
                    yield out()
        yield out()

    return run


def read_archives(spark: SparkSession, path: str, compress: bool = True, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives below ``path``: file, at (offset), length, kind
    (record or gap), reason, fields of the record and, if asked for, its payload."""
    kind = Member if compress else Plain
    given = pieces(spark, path, kind.mark).unionByName(whole_pieces(spark, path, kind.mark))
    found = materialise(given.mapInArrow(_walk(kind, payload, False), FOUND), "salvage")
    # Files with a candidate that is open where a split ends are read again in file order.
    again = found.filter("kind = 'open'").select("file").distinct()
    many, rows = again.count(), found
    if many:
        names = F.broadcast(again) if many <= BROADCAST_FILES else again
        ordered = given.join(names, "file", "left_semi").repartition("file").sortWithinPartitions("file", "split", "place")
        ordered = ordered.mapInArrow(_walk(kind, payload, True), FOUND)
        rows = found.join(again, "file", "left_anti").unionByName(materialise(ordered, "salvage"))
    # One row per split of a file.
    ends = rows.filter("kind = 'size'").select("file", "split", "at", "length")
    w = Window.partitionBy("file").orderBy("split")
    base = ends.select("file", "split", (F.sum("at").over(w) - F.col("at")).alias("base"))
    short = ends.groupBy("file").agg(F.sum("at").alias("seen"), F.max("length").alias("size")).filter("seen < size")
    tail = short.select("file", F.col("seen").alias("at"), (F.col("size") - F.col("seen")).alias("length"), F.lit("gap").alias("kind"), F.lit("cut off").alias("reason"))
    out = rows.filter("kind in ('record', 'gap')").join(base, ["file", "split"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "split")
    out = out.unionByName(tail, allowMissingColumns=True)
    return out if payload else out.drop("payload")


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from archives
    that hold a record for each row of ``pages``."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    found = read_archives(spark, path, payload=False).filter("kind = 'record'")
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
