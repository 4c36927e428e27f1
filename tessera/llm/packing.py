"""Packing of tokenized documents into sequences by minimum bin slack.

The lengths alone decide the packing, and there are at most ``capacity`` of them, so the driver packs a
histogram: a bin begins with the longest piece left, and a subset-sum over the other lengths, a bitset of
reachable sums, finds the fullest feasible combination. As the next bins would be filled alike while their
lengths last, the combination is removed as often as it goes; each removal leaves some length with fewer
pieces than one bin takes, which happens at most capacity * (1 + ln capacity) times, however many documents
there are. Pieces find their places by their number among those of their length.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .ranks import numbered
from .shared import cut

CAPACITY, END = 2048, 0


@lru_cache(maxsize=1)
def encoding(path: str) -> tiktoken.Encoding:
    """The compiled encoder for a vocabulary file; its ids are those of the tokenizers library (tests)."""
    own = bpe.Bpe(path)
    return tiktoken.Encoding("pieces", pat_str=bpe.SPLIT.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{l}", r"\p{L}").replace("{n}", r"\p{N}").replace("{S}", bpe.SPACE), mergeable_ranks=own.ranks, special_tokens=own.special)


def ids_of(text: str, path: str) -> np.ndarray:
    """Ids of a whole text; the compiled encoder gives up on white space of millions of bytes, the own one of this package does not."""
    try:
        return encoding(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return bpe.load(path).encode(text)


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or cut so that only the first is shorter than the capacity."""
    n = len(ids)
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every whole text with an ``end`` id, and with ``ids`` the ids as
    little-endian unsigned 32-bit. A null text is empty: its one piece is the end id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                found = np.append(ids_of(batch.column(1)[k].as_py() or "", path), end).astype("<u4")
                for p, (start, n) in enumerate(pieces_of(found, capacity)):
                    raw = found[start : start + n].tobytes()
                    rows.append((k, p, start, n, zlib.crc32(raw), raw if ids else None))
            at, piece, start, length, crc, raw = zip(*rows, strict=True) if rows else [()] * 6
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *[pa.array(raw, pa.binary())] * ids]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids)


def fullest(counts: list[int], room: int, longest: int) -> list[tuple[int, int]]:
    """(length, pieces) of the fullest combination of at most ``room``; longer lengths are tried first."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in range(min(room, longest), 0, -1):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left, part = left - take, part * 2
            if reach >> room & 1:
                left = 0
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def recipes(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces a bin), ...]) until no piece is left."""
    counts = [histogram.get(n, 0) for n in range(capacity + 1)]
    out, longest = [], capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        used = dict(fullest(counts, capacity - longest, longest))
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= times * k
        out.append((times, sorted(used.items(), reverse=True)))


def places(found: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length of each recipe: the first number it takes, its pieces a bin, first bin and offset; sorted by ``key``."""
    rows, taken, base = [], [0] * (capacity + 1), 0
    for times, used in found:
        offset = 0
        for length, k in used:
            rows.append((length, taken[length], k, base, offset))
            taken[length] += times * k
            offset += length * k
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {c: table[:, i] for i, c in enumerate(("length", "first", "each", "bin", "offset"))}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to the capacity) with ``sequence_id`` and ``offset``.

    Sequences are numbered from 0 without gaps and filled without gaps from offset 0. Equal rows get a place each.
    ``pieces`` is read twice, so it should be a written table.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shipped = pieces.sparkSession.sparkContext.broadcast(places(recipes(histogram, capacity), capacity))
    ranked = numbered(pieces, "length", "_rank")
    n = len(pieces.columns)

    def run(batches):
        t = shipped.value
        by_length = np.searchsorted(t["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            row = np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.searchsorted(length[order], np.arange(capacity + 2))
            for value in np.unique(length):
                at = order[cuts[value] : cuts[value + 1]]
                lo, hi = by_length[value], by_length[value + 1]
                row[at] = lo + np.searchsorted(t["first"][lo:hi], rank[at], side="right") - 1
            k = rank - t["first"][row]
            sequence, offset = t["bin"][row] + k // t["each"][row], t["offset"][row] + k % t["each"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[:n], "sequence_id", "offset"])

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents.

    A null or empty text is one piece, its end id; a long one is cut, however long; repeated rows are packed
    each; equal lengths take places by number; an empty table gives no rows; other columns, whatever their
    names, are dropped.
    """
    return pack(cut(tokenized(docs, path, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"))
