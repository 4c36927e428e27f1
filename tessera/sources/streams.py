"""Byte streams: units behind start codes, and boxes with lengths, as hex columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import protect, unprotect
from ..functions.metadata import hex_of

START = "00000001"


def unit(kind: Column, payload: Column) -> Column:
    """A unit: start code, two header bytes (layer 0, type, temporal id 0), protected payload; all upper-case hex."""
    return F.concat(F.lit(START), F.lit("00"), hex_of(kind * 8 + 1, 2), protect(payload))


def units(streams: DataFrame, id_col: str, stream: Column) -> DataFrame:
    """(id, seq, type, payload): the units of each stream, in order, payloads unprotected.

    Start codes are found at whole bytes only: bytes are set apart before the split.
    """
    spaced = F.regexp_replace(stream, "(..)", "$1 ")
    parts = F.split(spaced, "(?:00 ){2,}01 ")  # the first is what stands before any start code
    parts = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p) >= 6)
    rows = streams.select(id_col, F.posexplode(parts).alias("seq", "raw"))
    body = F.regexp_replace("raw", " ", "")
    clean = F.regexp_replace(body, "(?:00)+$", "")
    return rows.select(id_col, "seq", F.floor(F.conv(F.substring(body, 3, 2), 16, 10).cast("int") / 8).cast("int").alias("type"), unprotect(F.substring(F.when(F.length(body) % 2 == 0, body), 5, 1 << 30)).alias("payload"))


def box(name: str, payload: Column) -> Column:
    """A box in upper-case hex: length, four letters, payload."""
    return F.concat(hex_of(F.length(payload).cast("bigint").__truediv__(2).cast("bigint") + 8, 8), F.lit(name.encode().hex().upper()), payload)


def boxes(rows: DataFrame, id_col: str, data: Column) -> DataFrame:
    """(id, seq, name, payload): the boxes that follow one another in ``data``; a broken length ends the list."""

    def step(s: Column, _: Column) -> Column:
        rest = s["rest"]
        size = F.coalesce(F.conv(F.substring(rest, 1, 8), 16, 10).cast("bigint"), F.lit(0))
        ok = (F.length(rest) >= 16) & (size >= 8) & (size * 2 <= F.length(rest))
        found = F.struct(F.decode(F.unhex(F.substring(rest, 9, 8)), "US-ASCII").alias("name"), F.expr("''").alias("_"), rest.substr(F.lit(17), (size * 2 - 16).cast("int")).alias("payload"))
        return F.struct(F.when(ok, rest.substr((size * 2 + 1).cast("int"), F.length(rest))).otherwise("").alias("rest"), F.when(ok, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"))

    empty = F.struct(data.alias("rest"), F.expr("cast(array() as array<struct<name:string,_:string,payload:string>>)").alias("out"))
    parsed = F.aggregate(F.sequence(F.lit(0), F.floor(F.length(data) / 16).cast("int")), empty, step, lambda s: s["out"])
    return rows.select(id_col, F.posexplode(parsed).alias("seq", "b")).select(id_col, "seq", F.col("b.name").alias("name"), F.col("b.payload").alias("payload"))

#: Boxes that hold boxes, and the bytes that stand before these.
CONTAINERS = {"meta": 4, "iprp": 0, "ipco": 0, "dinf": 0, "moov": 0, "trak": 0}


def _descend(data: bytes):
    """(path, name, start, end, error) of every box of a file, a box before its parts; offsets are those of the payload.

    A length of 1 means that 64 bits follow, 0 that the box ends with its parent. A length that leaves the parent
    or gives no progress ends the list with a row that says so; fewer than 8 bytes at the end are left out.
    """
    todo = [("", 0, len(data), 0)]  # the lists that are still open: path of the parent, place, end, number of the next box
    while todo:
        parent, at, end, k = todo.pop()
        if at + 8 > end:
            continue
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        stop, path = end if size == 0 else at + size, f"{parent}/{k}" if parent else str(k)
        if stop > end or stop < at + head:
            yield path, None, at, end, "broken length"
            continue
        yield path, name, at + head, stop, None
        todo.append((parent, stop, end, k + 1))
        if name in CONTAINERS:
            todo.append((path, at + head + CONTAINERS[name], stop, 0))


def box_tree(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, path, parent, name, start, end, error): every box of each file (hex) down to the innermost; a null file has none."""

    def run(batches):
        for batch in batches:
            found = [(i, *b) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None for b in _descend(bytes.fromhex(v))]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            kinds = [batch.schema.types[0], pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "path", "name", "start", "end", "error"])

    asked = rows.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    found = asked.mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, path string, name string, start bigint, end bigint, error string")
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[0-9]+$", ""))
    return found.select(F.col("id").alias(id_col), "path", parent.alias("parent"), "name", "start", "end", "error")


def _locations(payload: bytes):
    """(item, extent, offset, length) of a location box of version 0; what is cut off ends the list."""
    number = lambda at, n: int.from_bytes(payload[at : at + n], "big")
    wide, long, base = payload[4] >> 4 if len(payload) > 4 else 0, payload[4] & 15 if len(payload) > 4 else 0, payload[5] >> 4 if len(payload) > 5 else 0
    at = 8
    for _ in range(number(6, 2)):
        item, first, count = number(at, 2), number(at + 4, base), number(at + 4 + base, 2)
        at += 6 + base
        for k in range(count):
            if at + wide + long > len(payload):
                return
            yield item, k, first + number(at, wide), number(at + wide, long)
            at += wide + long


def item_extents(rows: DataFrame, boxes_: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, item, extent, offset, length, payload, error): the extents of each file's items, read out of the data box they lie in.

    Extents come from the location boxes and meet the data boxes (``box_tree``) by file; one outside of all of them has an error.
    """

    def run(batches):
        for batch in batches:
            found = [(i, *e) for i, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in _locations(bytes.fromhex(v)[a:b])]
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.types[0], *[pa.int64()] * 4], strict=True)], ["id", "item", "extent", "offset", "length"])

    files = rows.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    places = boxes_.select(F.col(id_col).alias("id"), "name", "start", "end")
    located = files.join(places.where("name = 'iloc'"), "id").select("id", "data", "start", "end")
    found = located.mapInArrow(run, f"id {files.schema['id'].dataType.simpleString()}, item bigint, extent bigint, offset bigint, length bigint")
    held = places.where("name = 'mdat'").select(F.col("id").alias("_id"), "start", "end")
    inside = (F.col("id") == F.col("_id")) & (F.col("offset") >= F.col("start")) & (F.col("offset") + F.col("length") <= F.col("end"))
    both = found.join(held, inside, "left").join(files, "id")
    payload = F.when(F.col("start").isNotNull(), F.substring("data", (2 * F.col("offset") + 1).cast("int"), (2 * F.col("length")).cast("int")))
    return both.select(F.col("id").alias(id_col), "item", "extent", "offset", "length", payload.alias("payload"), F.when(F.col("start").isNull(), "outside of the data").alias("error"))
