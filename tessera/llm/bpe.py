"""Byte-level BPE by a contiguous rank array, with whole-text encoding and decoding on Spark.

A short word keeps two arrays: the boundaries of its parts and, for every two neighbouring parts,
the rank of their union. The smallest rank is searched again and again, its boundary deleted, and the
two ranks beside it looked up anew. That scan is quadratic in the word, so words over
``SHORT_WORD`` bytes take a heap over a linked list instead; both give the same parts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Longest word in bytes that the scan takes.
SHORT_WORD = 128
#: Words whose ids a Python worker remembers at most, in two generations; the older is dropped when the younger is full.
REMEMBERED = 400_000
NO_RANK = 1 << 60

# The split pattern of this family of vocabularies and Unicode's white space.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"

_any = regex.compile(SPLIT.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{l}", r"\p{L}").replace("{n}", r"\p{N}").replace("{S}", SPACE))
# Latin letters without the signs among them: for such texts the plain re module splits alike, and faster.
_LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
_latin = re.compile(SPLIT.replace("{L}", f"[{_LATIN}]").replace("{N}", "[0-9]").replace("{l}", _LATIN).replace("{n}", "0-9").replace("{S}", SPACE))
_only_latin = re.compile(rf"[\x00-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-ʯ‐-‧₠-₰]*")


def split_words(text: str) -> list[str]:
    """The words that merges never cross."""
    return (_latin if _only_latin.fullmatch(text) else _any).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file, by its public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated search of the smallest neighbouring rank."""
    rank = ranks.get
    cuts = list(range(len(word) + 1))
    near = [rank(word[i : i + 2], NO_RANK) for i in cuts[:-2]]
    while near and (least := min(near)) != NO_RANK:
        i = near.index(least)
        del cuts[i + 1], near[i]
        if i < len(near):
            near[i] = rank(word[cuts[i] : cuts[i + 2]], NO_RANK)
        if i:
            near[i - 1] = rank(word[cuts[i - 1] : cuts[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in pairwise(cuts)]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word in O(n log n)."""
    n = len(word)
    after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NO_RANK)) != NO_RANK]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, a, end = heapq.heappop(heap)
        if gone[a] or (mid := after[a]) >= n or after[mid] != end:
            continue
        gone[mid] = 1
        after[a] = end
        if end <= n - 1:
            before[end] = a
            if (r := ranks.get(word[a : after[end]], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, a, after[end]))
        if (p := before[a]) >= 0 and (r := ranks.get(word[p:end], NO_RANK)) != NO_RANK:
            heapq.heappush(heap, (r, p, end))
    cuts, i = [0], 0
    while i < n:
        i = after[i]
        cuts.append(i)
    return [ranks[word[a:b]] for a, b in pairwise(cuts)]


class Bpe:
    """Encoder and decoder of one vocabulary file; words seen before come from memory."""

    def __init__(self, path: str):
        file = json.load(open(path, encoding="utf-8"))
        letters, model = byte_letters(), file["model"]
        self.tokens: dict[int, bytes] = {i: bytes(map(letters.__getitem__, t)) for t, i in model["vocab"].items()}
        self.ranks = {t: i for i, t in self.tokens.items()}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in pairwise(made)):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ids = _Remembered(self.ranks)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._special is None or not any(t in text for t in self.special):
            return b"".join(map(self._ids.__getitem__, split_words(text)))
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(self._ids.__getitem__, split_words(part))) for part in self._special.split(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Remembered(dict):
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.older = ranks, {}

    def __missing__(self, word: str) -> bytes:
        if (out := self.older.get(word)) is not None:
            self[word] = out
            return out
        raw = word.encode()
        if (whole := self.ranks.get(raw)) is not None and len(raw) == 1:
            ids = [whole]
        else:
            ids = (merge_scan if len(raw) <= SHORT_WORD else merge_heap)(raw, self.ranks)
        out = np.array(ids, "<u4").tobytes()
        if len(raw) <= SHORT_WORD:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids binary, decoded): every whole text encoded, then decoded again from its ids.

    A null text counts as empty and has no ids; repeated rows give a row each; other columns are dropped.
    ``ids`` are little-endian unsigned 32-bit. No shuffle: one pass over the scan.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            rows = [(i := bpe.encode_bytes(t or ""), bpe.decode(np.frombuffer(i, "<u4"))) for t in batch.column(1).to_pylist()]
            ids = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``, hashed where they are made.

    The digests are taken inside the task, so neither ids nor texts go back to the JVM.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            counts, first, second = [], [], []
            for k in range(batch.num_rows):
                ids = bpe.encode_bytes(batch.column(1)[k].as_py() or "")
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"))
