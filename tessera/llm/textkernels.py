"""Words of whole texts and their 64-bit hashes, in numpy, block by block.

A word is a maximal run of bytes other than space and \\t-\\r. Its hash is a polynomial over random values
of its bytes, read off a running sum, then mixed; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 8, so that no difference of its small powers is even too often

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = (np.full(size, x, np.uint64) for x in (BASE, inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i below size at least."""
    return _powers_of(max(BLOCK + 1, 1 << int(size).bit_length()) if size > BLOCK else BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit hangs on all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    docs: np.ndarray  # docs[i] .. docs[i + 1]: the words of document i


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    white = WHITE[data]
    edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values[data] * up[: len(data)], out=run[1:])
    return starts, ends, mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in a byte array; blocks end at white space, so memory is bounded but for one word."""
    if lower:
        data = LOWER[data]
    if len(data) <= BLOCK:
        return _block_words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            gap = np.flatnonzero(WHITE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(len(data), end + BLOCK)
        s, e, h = _block_words(data[at:end])
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def blocks(texts: pa.Array, size: int = BLOCK):
    """(first row, byte array, offsets): documents joined by a space each, about ``size`` bytes a time; null is empty.

    Document i of the block lies at offsets[i] .. offsets[i + 1] - 1.
    """
    raw: list[bytes] = []
    first = n = 0
    for i, text in enumerate(texts):
        b = (text.as_py() or "").encode()
        if raw and n + len(b) > size:
            yield first, *_joined(raw)
            raw, first, n = [], i, 0
        raw.append(b)
        n += len(b) + 1
    if raw:
        yield first, *_joined(raw)


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=offsets[1:])
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), offsets


def document_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    starts, ends, hashes = words_of(data, lower)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


_turn = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; run i begins at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * _turn[k]
    return mix(out)


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its runs of ``width`` words, or of its whole sequence if it is shorter."""
    runs, out = window_hashes(words.hashes, width), []
    for a, b in zip(words.docs[:-1].tolist(), words.docs[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
