"""Archives: exact round trip, and recovery around every kind of damage."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.llm import warc

SCHEMA = "page_id long, url string, html string, first string, revisit int, payload string, key int, data string, file string, kind string, at long, split long"
ROWS = [
    (5, "http://a/", "<p>one</p>"), (3, "http://b/\r\nX: y", "<p>one</p>"), (3, "http://b/", "<p>one</p>"), (7, None, None), (8, "http://c/ä", ""),
    (None, "http://d/", "<p>one</p>"), (None, "http://d/", "alone"), (9, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (10, "u", "\x1f\x8b\x08" * 9 + "\x00"),
    (11, "u", "".join(map(chr, range(1, 0x900)))), (12, "u", "x" * 300_000), (-1, "u", "\r\n\r\n"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "f", 1, "p", 2, "d", "e", "k", 3, 4) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    low = {}
    for p, _, h in rows:
        if p is not None:
            low[h or ""] = min(p, low.get(h or "", p))
    out = []
    for p, _, h in rows:
        data, first = (h or "").encode(), low.get(h or "")
        out.append((p, len(data), warc.digest(data), "response" if p == first else "revisit", None if p == first else first))
    return sorted(out, key=str)


def test_report_is_the_round_trip(spark):
    got = warc.report(pages(spark))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)
    assert warc.report(pages(spark, [])).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_payloads_come_back_and_small_ones_are_stored(spark, tmp_path, compress):
    warc.write_archives(pages(spark), f"{tmp_path}/a", least_bytes=11, compress=compress)
    rows = warc.read_archives(spark, f"{tmp_path}/a", compress).collect()
    assert all(r["kind"] == "record" for r in rows) and len(rows) == len(ROWS)
    for p, u, h in ROWS:
        mine = [r for r in rows if r["record_id"] == warc.ID.format("" if p is None else p)]
        assert any(r["payload"] == (h or "").encode() and r["record_type"] == "response" for r in mine)
    assert {r["target_uri"] for r in rows} >= {"http://b/%0D%0AX:%20y", "http://c/ä", None}


def archive(compress, n=60, seed=1):
    """Bytes of an archive and the (offset, length, id) of its records."""
    r, out, at, where = random.Random(seed), b"", 0, []
    for i in range(n):
        payload = bytes(r.choice(b"abcdef \x1f\x8b\x08") for _ in range(r.randint(0, 400)))
        if i % 7 == 0:  # a member stored without compression, with members and records inside
            inner = b"".join(warc.member(warc.record(900, None, b"q", None, False, "d")) + warc.record(901, None, b"q", None, False, "d") for _ in range(3))
            payload = inner + payload
        data = warc.record(i, "u", payload, None, False, "d")
        if compress:
            data = gzip.compress(data, 0 if i % 7 == 0 else 6)
        where.append((at, len(data), i))
        out += data
        at += len(data)
    return out, where


def read(spark, path, compress, split=None):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if split:
        spark.conf.set(key, str(split))
    try:
        rows = warc.read_archives(spark, str(path), compress).collect()
    finally:
        spark.conf.set(key, before)
    ids = sorted(int(re.search(r"\d+", r["record_id"])[0]) for r in rows if r["kind"] == "record")
    return ids, sorted((r["at"], r["length"]) for r in rows if r["kind"] == "gap"), {r["at"]: r["length"] for r in rows if r["kind"] == "record"}


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("split", [None, 777, 4000])
def test_any_split_gives_the_same_records(spark, tmp_path, compress, split):
    data, where = archive(compress)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(data)
    (tmp_path / "a" / "empty.warc").write_bytes(b"")
    ids, gaps, records = read(spark, tmp_path / "a", compress, split)
    assert ids == list(range(60)) and gaps == []
    assert records == {at: n for at, n, _ in where}


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("split", [None, 1500])
def test_damage_is_logged_and_later_records_are_read(spark, tmp_path, compress, split):
    data, where = archive(compress)
    hurt = bytearray(data)
    lost = {3, 14, 30, 31, 59}
    for i in (3, 14):  # a flipped byte in the middle: CRC or digest
        at, n, _ = where[i]
        hurt[at + n - 40] ^= 0x55
    at, n, _ = where[30]  # two records overwritten
    hurt[at : at + n + where[31][1]] = b"#" * (n + where[31][1])
    hurt = hurt[: where[59][0] + where[59][1] - 9]  # the end is cut off
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"junk" + bytes(hurt))
    ids, gaps, records = read(spark, tmp_path / "a", compress, split)
    kept = [i for i in ids if i < 900]
    assert kept == [i for i in range(60) if i not in lost]
    size = len(hurt) + 4
    taken = sorted([*records.items(), *gaps])
    # Records and gaps tile the file.
    assert taken[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(taken, taken[1:])) and sum(taken[-1]) == size
    assert gaps[0] == (0, 4)
    for i in lost - {31}:
        assert any(at <= where[i][0] + 4 < at + n for at, n in gaps)


def test_files_named_gz(spark, tmp_path):
    data, _ = archive(True, 10)
    (tmp_path / "x.warc.gz").write_bytes(data)
    assert read(spark, tmp_path, True)[0] == list(range(10))


def test_members_end_in_zero():
    big = warc.member(bytes(17 << 20))
    assert big[-1] == 0 and gzip.decompress(big) == bytes(17 << 20)


def test_hot_payload_is_stored_once(spark):
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(600)]
    got = warc.report(pages(spark, rows))
    assert got.filter("record_type = 'response' and payload_bytes = 4").select(F.col("page_id")).collect()[0][0] == 1
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
