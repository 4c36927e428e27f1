"""WARC records in ZIP-packaged archives: writing, and reading by ranges without extraction.

An archive is a ZIP whose members are stored, not compressed: ``archive/data.warc.gz``, one gzip member a
record, and ``indexes/index.cdxj``, one line a record with its place in the former. The reader parses the
end record, the ZIP64 end record where there is one, and the central directory, finds the members' bytes,
reads the index, and then reads spans of records by their place.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, new_path

#: Payloads under so many bytes are always written whole.
REVISIT_FROM = 100
#: An archive is closed when it holds so many bytes; a span that one read fetches.
ARCHIVE_BYTES, SPAN_BYTES = 64 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL, ZIP64_EXTRA = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04", 1


@dataclass
class Member:
    name: str
    method: int
    offset: int  # of its local header
    size: int  # as stored


def _tail(f, size: int) -> tuple[int, int, int]:
    """(entries, bytes, offset) of the central directory."""
    back = min(size, 65_557)
    f.seek(size - back)
    tail = f.read(back)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and size - back + at >= 20:
        f.seek(size - back + at - 20)
        locator = f.read(20)
        if locator[:4] == LOCATOR64:
            f.seek(struct.unpack_from("<Q", locator, 8)[0])
            end = f.read(56)
            if end[:4] != END64:
                raise ValueError("the ZIP64 end record is not where its locator says")
            count, length, offset = struct.unpack_from("<QQQ", end, 32)
    return count, length, offset


def members(f, size: int) -> list[Member]:
    """The central directory of an open file of so many bytes; 32-bit fields that overflow come from the ZIP64 extra field."""
    count, length, offset = _tail(f, size)
    f.seek(offset)
    raw, at, out = f.read(length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        stored, whole = struct.unpack_from("<II", raw, at + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", raw, at + 28)
        start = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode()
        e, stop = at + 46 + n_name, at + 46 + n_name + n_extra
        while e + 4 <= stop:
            tag, n = struct.unpack_from("<HH", raw, e)
            if tag == ZIP64_EXTRA:
                wide = [x[0] for x in struct.iter_unpack("<Q", raw[e + 4 : e + 4 + n // 8 * 8])]
                if whole == 0xFFFFFFFF:
                    wide.pop(0)
                if stored == 0xFFFFFFFF:
                    stored = wide.pop(0)
                if start == 0xFFFFFFFF:
                    start = wide.pop(0)
            e += 4 + n
        out.append(Member(name, method, start, stored))
        at = stop + n_note
    return out


def data_offset(f, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    f.seek(member.offset)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.offset + 30 + sum(struct.unpack_from("<HH", head, 26))


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record if it refers to another; a revisit keeps the HTTP head, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP length and payload (null in a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record is not as long as it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda v: int(v[10:-1]) if v and v != "<urn:page:>" else None
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not have its digest")
    return {"page_id": page(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which pages are written whole and which refer to an equal one.

    A null html is an empty payload. Of equal payloads of REVISIT_FROM bytes or more the smallest page_id is
    written whole, each other page_id refers to it; pages of no id never serve as the first. The smallest id
    is pre-aggregated before the shuffle; only digests that more than one row has are joined back, and a
    digest with many pages is one that Spark's skew join may split. Shorter payloads have a join key of their
    own, from id and address, so that they match nothing and empty pages do not gather.
    """
    with_digest = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= REVISIT_FROM
    firsts = with_digest.where(long).groupBy(F.col("digest").alias("_key")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    keyed = with_digest.withColumn("_key", F.when(long, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("short"), F.col("page_id").cast("string"), "url")))
    return keyed.join(firsts, "_key", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, records, bytes): ZIP archives of the records, one or more a partition. An archive has a new name in
    each attempt, and only those of tasks that succeed are listed; evaluate the result once."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        zipped = None
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(i)[k].as_py() for i in range(5))
                if zipped is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(f"{root}/{name}")
                    zipped = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                    data, index, at = zipped.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), [], 0
                packed = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to), 1, mtime=0)
                data.write(packed)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(packed)}))
                at += len(packed)
                if at >= archive_bytes:
                    yield _closed(zipped, sink, data, index, f"{folder}/{name}", at)
                    zipped = None
        if zipped is not None:
            yield _closed(zipped, sink, data, index, f"{folder}/{name}", at)

    return records.mapInArrow(run, "path string, records bigint, bytes bigint")


def _closed(zipped, sink, data, index: list[str], path: str, size: int) -> pa.RecordBatch:
    data.close()
    zipped.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
    zipped.close()
    sink.close()
    return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([size], pa.int64())})


def list_spans(archives: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(path, offset, lengths): spans of neighbouring records, from the directory and index of each archive in ``path``."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                size = store.get_file_info(at).size
                with store.open_input_file(at) as f:
                    found = {m.name: m for m in members(f, size)}
                    base, where = data_offset(f, found[DATA]), data_offset(f, found[INDEX])
                    f.seek(where)
                    lines = f.read(found[INDEX].size).decode().splitlines()
                spans: list[tuple[int, list[int]]] = []
                for line in lines:
                    x = json.loads(line)
                    if not spans or sum(spans[-1][1]) >= span_bytes or spans[-1][0] + sum(spans[-1][1]) != base + x["offset"]:
                        spans.append((base + x["offset"], []))
                    spans[-1][1].append(x["length"])
                yield pa.RecordBatch.from_pydict({"path": [path] * len(spans), "offset": pa.array([s[0] for s in spans], pa.int64()), "lengths": pa.array([s[1] for s in spans], pa.list_(pa.int64()))})

    return archives.select("path").mapInArrow(run, "path string, offset bigint, lengths array<bigint>")


def read_spans(spans: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the spans: ids, digest and length, and with ``payloads`` also url and payload."""
    wide = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("url", pa.string()), ("payload", pa.binary())] * payloads

    def run(batches):
        for batch in batches:
            for path, offset, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    f.seek(offset)
                    raw, k, rows = f.read(sum(lengths)), 0, []
                for n in lengths:
                    rows.append(parse_record(gzip.decompress(raw[k : k + n])))
                    k += n
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in wide], [c for c, _ in wide])

    return spans.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * payloads)


def round_trip(pages: DataFrame, payloads: bool = False, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """All pages written to archives in the shared folder, listed in a table there, and read back by ranges.

    A null html is an empty payload; a null url leaves its header out. Rows of one page_id that repeat the
    first payload are responses all; pages of no id with the payload of another revisit it. Long payloads
    take an archive of their own, as one is closed at ``archive_bytes``. No pages give no rows. Other columns
    are dropped.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    listed = cut(write_archives(plan_records(pages), folder if "://" in folder else f"file://{folder}", archive_bytes), "warc-list")
    spans = list_spans(listed.repartition(max(1, min(listed.count(), 10_000))))
    return read_spans(spans.repartition(spark.sparkContext.defaultParallelism * 4), payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
     d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {REVISIT_FROM} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
