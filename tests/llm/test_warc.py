"""WARC round trips; ZIP and ZIP64 directories built by hand or by the standard library."""

import hashlib
import io
import struct
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def expected(rows):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= warc.REVISIT_FROM:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    same = "<p>é</p>" * 40
    rows = [(9, same), (4, same), (None, same), (4, same), (1, None), (2, ""), (3, "short"), (6, "short"), (7, "\r\n\r\nWARC/1.1\r\n" * 20), (8, "x" * 2_000_000), (10, "y" * 100), (11, "y" * 100), (12, "z" * 99), (13, "z" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.concat(F.lit("http://a/b c\n é?"), "page_id")).withColumn("digest", F.lit(1)).repartition(3)
    out = warc.round_trip(pages, payloads=True, archive_bytes=200).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == expected(rows)
    html = dict(rows)
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in out if r.record_type == "response" and r.page_id is not None)
    assert warc.round_trip(pages.limit(0)).collect() == []


def stored(names, comment=b""):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for n, b in names:
            z.writestr(n, b)
    return raw.getvalue()


def test_directory_with_comment_that_holds_an_end_record():
    raw = stored([("a/é.txt", b"one"), ("b", b"two!")], comment=b"PK\x05\x06" + b"x" * 30)
    f = io.BytesIO(raw)
    found = warc.members(f, len(raw))
    assert [(m.name, m.size) for m in found] == [("a/é.txt", 3), ("b", 4)]
    at = warc.data_offset(f, found[1])
    assert raw[at : at + 4] == b"two!"


def test_zip64_directory():
    raw = stored([("data", b"payload")])
    size = raw.index(b"PK\x05\x06")
    start = raw.index(b"PK\x01\x02")
    central = bytearray(raw[start:size])
    central[20:28] = b"\xff" * 8
    central[42:46] = b"\xff" * 4
    central[30:32] = struct.pack("<H", 28 + 6)
    central += struct.pack("<HHH", 0x9999, 2, 7) + struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = raw[:start] + bytes(central) + end64 + locator + end
    f = io.BytesIO(raw)
    (m,) = warc.members(f, len(raw))
    assert (m.name, m.size, m.offset) == ("data", 7, 0)
    assert raw[warc.data_offset(f, m) :][:7] == b"payload"


def test_compressed_members_and_other_files_are_refused():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1000)
    with pytest.raises(ValueError):
        warc.data_offset(raw, warc.members(raw, len(raw.getvalue()))[0])
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no archive" * 10), 100)


def test_sql_of_pages_without_an_id(spark, tmp_path):
    rows = [(1, "u", "p" * 200), (None, "u", "p" * 200), (2, None, "p" * 200), (3, "u", "short"), (4, "u", "short"), (None, "u", None), (1, "u", "p" * 200), (None, "u", "q" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.round_trip(pages).collect()), key=str)
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    assert got == sorted(con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE_SQL})").fetchall(), key=str)
