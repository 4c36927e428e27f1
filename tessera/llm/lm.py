"""Language-model scores of whole texts: causal self-attention over subword ids, whole-corpus counts, and a word-count base.

A text is its words, lower-cased (A-Z), and one end. The model is a mixture on three levels, each a probability:

- subword ids of a word, from a vocabulary file, by one block of masked self-attention over the last ids beside
  a bigram table. Both give classes of ids: SINGLE classes of one frequent id each, the others of ids alike in
  frequency and in beginning a word or not. A class is drawn in two steps, its group and its place there. An
  id's share in its class comes from counts;
- a word is spelled by the former, or, with the share COUNTED at every size, drawn from the counts of all training
  words: a floor for words whose ids are hard to foresee, which costs a well spelled one next to nothing;
- a phrase is drawn from the phrases of all other training documents, or word by word by the former. Phrases
  end where a hash of two words says so, after PHRASE words on average, so equal passages have equal phrases.
  A training document's own occurrences are taken off, else each would be its own memory.

All counts (ids, class bigrams, words, phrases) cover all training documents. The attention weights are
trained on every window of all of them, once: in each of ROUNDS rounds every task steps through another equal
part of the windows of each chunk it reads, and then the tasks' weights are averaged by their windows.

Texts are read once and written as chunks of about CHUNK bytes: distinct words with their ids, the texts as
numbers of those words, and hashes of words and phrases. Counts come from one shuffle of the hashes, a row
a chunk and hash, so no hash is frequent; only totals that a chunk can't know go back to it. Texts are cut into
windows of WINDOW ids that overlap by CONTEXT, so each id is scored once, with at least CONTEXT ids before it
unless the text begins there; the ids that overlap are only looked at. Windows of many texts run as one batch.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .fitting import Adam, fold
from .packing import encoding
from .shared import cut
from .textkernels import LOWER, blocks, document_words, mix, words_of

GROUPS, MEMBERS, SINGLE, DIM, INNER = 16, 32, 384, 24, 48
CLASSES = GROUPS * MEMBERS
WINDOW, CONTEXT, BATCH = 32, 8, 128
FRESH = WINDOW - CONTEXT
#: Windows a step of training, and rounds of it, each through another equal part of all windows.
STEP, ROUNDS, RATE = 64, 2, 0.006
#: Bytes of text of a chunk, words that are scored at a time, and words of a phrase on average.
CHUNK, STRETCH, PHRASE = 8 << 20, 1 << 18, 16
#: Words whose ids a Python worker remembers.
REMEMBERED = 1_000_000
#: Smoothing of the base, and the share of words that are drawn from word counts.
SMOOTH, COUNTED = 0.1, 0.15
LATER = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
SEEN = (LATER[CONTEXT:] == 0).astype(np.float32)
END_HASH = np.uint64(0x1F3B5D7A9C2E4F60)
_wide_space = re.compile(bpe.SPACE.join(("[", "]")).replace(r"\t-\r ", ""))


def encode_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words data[starts] .. data[ends], each after a blank, end to end, and the number of each word's.

    Words hold no ASCII white space, so they are encoded as lines of one text.
    """
    enc = encoding(path)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts + 2
    lines, first = np.full(int(size.sum()), 10, np.uint8), np.cumsum(size) - size
    lines[first] = 32
    lines[ragged(first + 1, size - 2)] = data[ragged(starts, size - 2)]
    text = lines[:-1].tobytes().decode()
    if _wide_space.search(text):  # white space that joins what stands around it: one by one
        each = [bpe.load(path).encode(w).astype(np.int64) if _wide_space.search(w) else None for w in text.split("\n")]
        rest = np.array([e is None for e in each])
        flat, per = encode_words(data, starts[rest], ends[rest], path)
        plain = iter(np.split(flat, np.cumsum(per)[:-1]) if len(per) else [])
        every = [next(plain) if e is None else e for e in each]
        return np.concatenate(every), np.array([len(e) for e in every], np.int64)
    ids = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    cuts = np.flatnonzero(ids == enc.encode_single_token(b"\n"))
    return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1


class Remembered:
    """Ids of words that a Python worker has encoded, by hash; at most REMEMBERED words and a chunk's."""

    def __init__(self, path: str):
        self.path = path
        self.keys, self.first, self.per, self.flat = np.zeros(0, np.uint64), *(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))

    def ids(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_words``, of words with these hashes, each given once."""
        known = np.isin(keys, self.keys, assume_unique=True)
        if not known.all():
            flat, per = encode_words(data, starts[~known], ends[~known], self.path)
            if len(self.keys) > REMEMBERED:
                self.__init__(self.path)
                return self.ids(keys, data, starts, ends)
            every = np.concatenate([self.keys, keys[~known]])
            first = np.concatenate([self.first, len(self.flat) + np.cumsum(per) - per])
            order = np.argsort(every, kind="stable")
            self.keys, self.first, self.per = every[order], first[order], np.concatenate([self.per, per])[order]
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        at = np.searchsorted(self.keys, keys)
        return self.flat[ragged(self.first[at], self.per[at])], self.per[at]


@lru_cache(maxsize=1)
def remembered(path: str) -> Remembered:
    return Remembered(path)


def subwords(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text, word by word, and its end."""
    out = []
    for t in texts:
        data = LOWER[np.frombuffer((t or "").encode(), np.uint8)]
        starts, ends, _ = words_of(data)
        out.append(np.append(encode_words(data, starts, ends, path)[0], encoding(path).n_vocab - 1))
    return out


def squeezed(a: np.ndarray, kind: str = "<i4") -> bytes:
    """An array of small numbers in few bytes, each byte's place by itself."""
    raw = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def spread(raw: bytes, kind: str = "<i4") -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    data = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], n * width, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data.reshape(width, n).T).view(kind)[:, 0] if n else np.zeros(0, kind)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(first - np.cumsum(size) + size, size)


def encoded(data: np.ndarray, offsets: np.ndarray, train: np.ndarray, path: str) -> dict:
    """A chunk of documents as a row: words, phrases, their hashes and how often its training documents have them.

    Words are numbered from the most frequent on, the end being one of them; phrases as they come. The lowest
    bit of a hash tells phrases from words.
    """
    w = document_words(data, offsets)
    _, first, number, n = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    first = first[np.argsort(rank)]
    words = w.hashes[first]
    flat, per = remembered(path).ids(words, LOWER[data], w.starts[first], w.ends[first])
    last = len(n)
    seq, hashes = np.insert(rank[number], w.docs[1:], last), np.insert(w.hashes, w.docs[1:], END_HASH)
    sizes = np.diff(w.docs) + 1
    del w, number  # as long as the words of the chunk, like all that is dropped below
    learned = np.repeat(train, sizes)

    ends = np.cumsum(sizes) - 1
    before = np.concatenate([[END_HASH], hashes[:-1]])
    stop = mix(before * np.uint64(0x5851F42D4C957F2D) + hashes) % np.uint64(PHRASE) == 0
    del before
    stop[ends] = True
    stops = np.flatnonzero(stop) + 1
    starts = np.concatenate([[0], stops[:-1]])
    span = stops - starts
    place = ragged(np.zeros(len(span), np.int64), span).astype(np.uint64)
    place *= np.uint64(0x9E3779B97F4A7C15)
    place += hashes
    keys = np.add.reduceat(mix(place), starts)
    del place, hashes
    keys, at, phrase = np.unique(mix(keys), return_index=True, return_inverse=True)
    rank = np.empty(len(keys), np.int64)
    rank[np.argsort(at)] = np.arange(len(keys))
    phrase = rank[phrase]

    count = np.bincount(seq, learned, last + 1).astype(np.int64)
    phrases = np.bincount(phrase, learned[starts], len(keys)).astype(np.int64)
    flat, per = np.append(flat, encoding(path).n_vocab - 1), np.append(per, 1)
    ids = np.bincount(flat, np.repeat(count, per), encoding(path).n_vocab)
    every = np.concatenate([np.append(words, END_HASH) & ~np.uint64(1), keys[np.argsort(rank)] | np.uint64(1)])
    n = np.concatenate([count, phrases])
    return {
        "sizes": squeezed(sizes), "seq": squeezed(seq), "words": squeezed(flat), "per": squeezed(per), "span": squeezed(span), "phrase": squeezed(np.diff(phrase, prepend=0)), "own": squeezed(n), "tokens": squeezed(ids),
        "keys": every.view(np.int64), "n": n, "learned": int(count.sum()), "ends": int(train.sum()), "phrases": int(phrases.sum()),
    }


BLOBS = ("sizes", "seq", "words", "per", "span", "phrase", "own", "tokens")


def chunked(docs: DataFrame, path: str, id_col: str, text_col: str, folds: int) -> DataFrame:
    """The table of chunks of ``docs``, written to the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            held = batch.column(2)
            for first, data, offsets in blocks(batch.column(1), CHUNK):
                size = len(offsets) - 1
                mine = held.slice(first, size)
                row = encoded(data, offsets, ~mine.to_numpy(zero_copy_only=False), path)
                lists = [pa.array([row["keys"]], pa.list_(pa.int64())), pa.array([row["n"]], pa.list_(pa.int32()))]
                ids = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), batch.column(0).slice(first, size))
                flags = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), mine)
                totals = [pa.array([row[c]], pa.int64()) for c in ("learned", "ends", "phrases")]
                chunk = pa.array([uuid.uuid4().int >> 65], pa.int64())
                yield pa.RecordBatch.from_arrays([chunk, ids, flags, *[pa.array([row[c]], pa.binary()) for c in BLOBS], *lists, *totals], ["chunk", "docs", "held", *BLOBS, "keys", "n", "learned", "ends", "phrases"])

    schema = f"chunk bigint, docs array<{kind}>, held array<boolean>, {', '.join(f'{c} binary' for c in BLOBS)}, keys array<bigint>, n array<int>, learned bigint, ends bigint, phrases bigint"
    asked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), (fold(id_col, folds) == 0).alias("held"))
    return cut(asked.mapInArrow(run, schema), "chunks")


def totals_of(chunks: DataFrame) -> DataFrame:
    """(chunk, pos, total, word, first): corpus counts of a chunk's hashes where they exceed its own; ``first`` once a hash.

    A hash is in a chunk once, so the rows of one hash are as many as chunks have it.
    """
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "n")).alias("pos", "x")).select("chunk", "pos", F.col("x.keys").alias("key"), F.col("x.n").alias("n"))
    same = Window.partitionBy("key")
    found = rows.select("chunk", "pos", "n", (F.col("key") % 2 == 0).alias("word"), F.sum("n").over(same).alias("total"), (F.min("chunk").over(same) == F.col("chunk")).alias("first"))
    told = (F.col("total") > F.col("n")) | (F.col("first") & (F.col("total") > F.when(F.col("word"), 0).otherwise(1)))
    return cut(found.where(told).select("chunk", "pos", "total", "word", "first"), "totals")


def classes_of(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each id, numbered so that a group holds classes alike.

    The most frequent ids and the end, the last id, are classes of their own; the others are sorted by whether they
    begin a word and by frequency, and cut into classes of about equal mass.
    """
    order = np.argsort(-counts, kind="stable")
    order = np.concatenate([[len(counts) - 1], order[order != len(counts) - 1]])
    single, rest = order[:SINGLE], order[SINGLE:]
    rest = rest[np.argsort(~starts[rest], kind="stable")]
    mass = np.cumsum(np.sqrt(counts[rest] + 0.1))
    shared = np.minimum((mass / mass[-1] * (CLASSES - SINGLE)).astype(np.int64), CLASSES - SINGLE - 1)
    of = np.zeros(len(counts), np.int64)
    of[single], of[rest] = np.arange(SINGLE), SINGLE + shared
    n, begins = np.bincount(of, counts, CLASSES), np.bincount(of, starts, CLASSES) > 0
    place = np.empty(CLASSES, np.int64)
    place[np.lexsort((-n, ~begins))] = np.arange(CLASSES)
    return place[of]


@dataclass
class Model:
    of: np.ndarray  # class of each id
    share: np.ndarray  # log10 of each id's share in its class
    group: np.ndarray  # bigram logits: CLASSES + 1 (begin) x GROUPS
    member: np.ndarray  # CLASSES + 1 x GROUPS x MEMBERS
    parts: list[np.ndarray]  # embedding, position, query, key, value, out, first, second, up to groups, up to members

    def log_ids(self, ids: np.ndarray, lengths: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """log10 probability of each id of pieces that lie end to end; the first ``leads`` of a piece are only context (and 0)."""
        piece, first, keep = windows(lengths, leads)
        start = (np.cumsum(lengths) - lengths)[piece]
        classes, out, work = self.of[ids], np.zeros(len(ids)), Workspace(self)
        for k in range(0, len(piece), BATCH):
            used = keep[k : k + BATCH]
            at = (start[k : k + BATCH, None] + first[k : k + BATCH, None] + np.arange(CONTEXT, WINDOW))[used]
            out[at] = work.log_shares(before_of(classes, start[k : k + BATCH], first[k : k + BATCH]), used, classes[at]) / np.log(10)
        return out + self.share[ids] * (np.arange(len(ids)) >= np.repeat(np.cumsum(lengths) - lengths + leads, lengths))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids, not empty, by attention and bigrams alone."""
        n = np.array([len(t) for t in texts])
        return np.add.reduceat(self.log_ids(np.concatenate(texts), n, np.zeros(len(n), np.int64)), np.cumsum(n) - n)


def windows(lengths: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window its piece, the place of its first id, and which places it scores of those after its first CONTEXT.

    Places before a piece, as a first window has, count as its beginning.
    """
    count = np.maximum(1, -(-lengths // FRESH))
    piece = np.repeat(np.arange(len(lengths)), count)
    first = ragged(np.zeros(len(count), np.int64), count) * FRESH - CONTEXT
    place = first[:, None] + np.arange(CONTEXT, WINDOW)
    return piece, first, (place < lengths[piece][:, None]) & (place >= leads[piece][:, None])


def before_of(classes: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class before each place of windows; a piece begins at ``start`` in ``classes``."""
    place = first[:, None] + np.arange(WINDOW)
    at = np.minimum(start[:, None] + np.maximum(place, 1) - 1, len(classes) - 1)
    return np.where(place <= 0, CLASSES, classes[at])


class Workspace:
    """``forward`` and the softmax for scoring, in arrays that are made once: fresh ones of this size cost more than the sums."""

    def __init__(self, model: Model):
        e, pos, wq, wk, wv, wo = model.parts[:6]
        rows, new = BATCH * FRESH, lambda *s: np.empty(s, np.float32)
        self.model = model
        # What a class and a place each add to queries, keys and values (these as they leave attention): sums of two rows, no products.
        with np.errstate(over="ignore", invalid="ignore"):
            self.query, self.key, self.value = ([u @ w for u in (e, pos)] for w in (wq * np.float32(DIM**-0.5), wk, wv @ wo))
        self.value = [np.column_stack([u, np.full(len(u), x, np.float32)]) for u, x in zip(self.value, (1, 0), strict=True)]  # a column of ones sums the shares
        self.b, self.q, self.k, self.v = new(BATCH, FRESH, DIM), new(BATCH, FRESH, DIM), new(BATCH, WINDOW, DIM), new(BATCH, WINDOW, DIM + 1)
        self.s, self.w, self.h, self.r, self.o = new(BATCH, FRESH, WINDOW), new(BATCH, FRESH, DIM + 1), new(rows, DIM), new(rows, INNER), new(rows, DIM)
        self.z, self.y, self.g, self.hid, self.zeros = new(rows, GROUPS), new(rows, MEMBERS), new(rows, MEMBERS), new(rows, DIM), np.zeros((rows, INNER), np.float32)
        self.gg = new(rows, GROUPS)
        self.flat = model.member.reshape(-1, MEMBERS)
        self.ones = {n: np.ones(n, np.float32) for n in (GROUPS, MEMBERS)}

    def _softmax(self, z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The target's entry and the sum of the exponentials, of each row."""
        found = z[np.arange(len(z)), target].astype(np.float64)
        np.exp(z, out=z)
        return found, (z @ self.ones[z.shape[1]]).astype(np.float64)

    def log_shares(self, before: np.ndarray, used: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of the target class at each used place, of the FRESH last of each window."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            out = self._fast(before, used, target)
        return out if np.isfinite(out).all() else careful(self.model, before, used, target)  # weights of a size that overflows

    def _fast(self, before: np.ndarray, used: np.ndarray, target: np.ndarray) -> np.ndarray:
        e, pos, w1, w2, up1, up2 = (self.model.parts[i] for i in (0, 1, 6, 7, 8, 9))
        n, late = len(before), np.ascontiguousarray(before[:, CONTEXT:])
        b, q, k, v, s, w = (u[:n] for u in (self.b, self.q, self.k, self.v, self.s, self.w))
        h, r, o = (u[: n * FRESH] for u in (self.h, self.r, self.o))
        for (classes, places), at, out in (((e, pos), late, b), (self.query, late, q), (self.key, before, k), (self.value, before, v)):
            np.take(classes, at, axis=0, out=out, mode="clip")
            out += places[-out.shape[1] :]
        np.matmul(q, k.transpose(0, 2, 1), out=s)
        np.exp(s, out=s)
        s *= SEEN
        np.matmul(s, v, out=w)
        np.divide(w[:, :, :DIM], w[:, :, DIM:], out=h.reshape(b.shape))
        h += b.reshape(h.shape)
        np.matmul(h, w1, out=r)
        np.maximum(r, self.zeros[: len(r)], out=r)
        np.matmul(r, w2, out=o)
        h += o
        group = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        places = np.flatnonzero(used.ravel())[order]
        group, target, prev = group[order].astype(np.int64), target[order], late.ravel()[places]
        hid, z, y, g, gg = (u[: len(places)] for u in (self.hid, self.z, self.y, self.g, self.gg))
        np.take(h, places, axis=0, out=hid, mode="clip")
        np.matmul(hid, up1, out=z)
        np.take(self.model.group, prev, axis=0, out=gg, mode="clip")
        z += gg
        outer, every = self._softmax(z, group)
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        for i in range(GROUPS):
            if cuts[i] < cuts[i + 1]:
                np.matmul(hid[cuts[i] : cuts[i + 1]], up2[i], out=y[cuts[i] : cuts[i + 1]])
        np.take(self.flat, prev * GROUPS + group, axis=0, out=g, mode="clip")
        y += g
        inner, own = self._softmax(y, target % MEMBERS)
        back = np.empty_like(outer)
        back[order] = outer + inner - np.log(every * own)
        return back


def careful(model: Model, before: np.ndarray, used: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What ``Workspace.log_shares`` gives, without overflow."""
    hid = forward(before, model.parts)["h2"][used].astype(np.float64)
    prev, group = before[:, CONTEXT:][used], target // MEMBERS
    log = lambda z, t: z[np.arange(len(z)), t] - z.max(1) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
    outer = log(hid @ model.parts[8] + model.group[prev], group)
    return outer + log(np.einsum("nd,ndk->nk", hid, model.parts[9][group]) + model.member[prev, group], target % MEMBERS)


class Room:
    """Arrays by name that are made once and used again: fresh ones of a step's size cost more than most of its sums."""

    def __init__(self):
        self.held = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size, old = math.prod(shape), self.held.get(name)
        if old is None or old.size < size or old.dtype != kind:
            old = self.held[name] = np.empty(size, kind)
        return old[:size].reshape(shape)


@lru_cache(maxsize=1)
def step_room() -> Room:
    """That of a Python worker's training steps."""
    return Room()


def forward(x: np.ndarray, parts: list[np.ndarray], context: int = CONTEXT, room: Room | None = None) -> dict[str, np.ndarray]:
    """What stands at each place but the first ``context``, which are only looked at; in arrays of ``room``, if it is given.

    ``u`` is the attention before its division by the row sums ``z``. Queries (scaled), keys and values lie side by
    side in ``qkv``, as ``w3`` makes them in one product; a last column of ones sums the attention.
    """
    e, pos, wq, wk, wv, wo, w1, w2, *_ = parts
    (n, t), kind, room = x.shape, e.dtype, room or Room()
    fresh = t - context
    rows = n * fresh
    a = room("a", kind, n, t, DIM)
    np.take(e, x, axis=0, out=a, mode="clip")
    a += pos[:t]
    w3 = np.concatenate([wq * kind.type(DIM**-0.5), wk, wv], 1)
    qkv = room("qkv", kind, n, t, 3 * DIM + 1)
    qkv[:, :, -1] = 1
    # One product over all rows: numpy takes a stack of small matrices one by one.
    np.matmul(a.reshape(-1, DIM), w3, out=qkv.reshape(n * t, -1)[:, :-1])
    q, k, v = qkv[:, context:, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
    u, m = room("u", kind, n, fresh, t), room("m+z", kind, n, fresh, DIM + 1)
    np.matmul(q, k.transpose(0, 2, 1), out=u)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(u, out=u)
        u *= LATER[context:t, :t] == 0 if context != CONTEXT or t != WINDOW else SEEN
        np.matmul(u, v, out=m)
    z = m[:, :, DIM:]
    if not (n and z.min() > 1e-30 and z.max() < 1e30):  # else sums that are too large or small for the numbers' kind
        np.matmul(q, k.transpose(0, 2, 1), out=u)
        u += LATER[context:t, :t]
        u -= u.max(2, keepdims=True, initial=-np.inf)
        np.exp(u, out=u)
        np.matmul(u, v, out=m)
    shares = room("m", kind, rows, DIM)
    np.divide(m[:, :, :DIM], z, out=shares.reshape(n, fresh, DIM))
    h, r, h2, zeros = room("h", kind, rows, DIM), room("r", kind, rows, INNER), room("h2", kind, rows, DIM), room("zeros", kind, rows, INNER)
    np.matmul(shares, wo, out=h)
    wide = h.reshape(n, fresh, DIM)
    wide += a[:, context:]
    np.matmul(h, w1, out=r)
    zeros.fill(0)  # numpy compares with an array thrice as fast as with a number
    np.maximum(r, zeros, out=r)
    np.matmul(r, w2, out=h2)
    h2 += h
    return {"a": a, "w3": w3, "q": q, "k": k, "v": v, "u": u, "z": z, "m": shares, "h": wide, "r": r, "h2": h2.reshape(n, fresh, DIM)}


def backward(x: np.ndarray, y: np.ndarray, mask: np.ndarray, model: Model, context: int = CONTEXT) -> tuple[float, list[np.ndarray]]:
    """Mean loss of the next classes ``y`` where ``mask`` is set, and the gradients of the parts."""
    e, pos, wq, wk, wv, wo, w1, w2, up1, up2 = model.parts
    (size, t), kind, room = x.shape, e.dtype, step_room()
    f = forward(x, model.parts, context, room)
    wide = (size, t - context, DIM)
    rows, h, h2, m, r = size * wide[1], *(f[c].reshape(size * wide[1], -1) for c in ("h", "h2", "m", "r"))
    at = np.flatnonzero(mask.ravel())
    group = (y.ravel()[at] // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order].astype(np.int64)
    target, prev, n, loss = y.ravel()[at], x[:, context:].ravel()[at], max(1, len(at)), 0.0
    hid, dhid, more = (room(c, kind, len(at), DIM) for c in ("hid", "dhid", "more"))
    np.take(h2, at, axis=0, out=hid, mode="clip")

    def softmax(z: np.ndarray, want: np.ndarray) -> np.ndarray:
        nonlocal loss
        ones, places, p = np.ones(z.shape[1], kind), np.arange(len(z)) * z.shape[1] + want, room(f"p{z.shape[1]}", kind, *z.shape)
        found = z.ravel().take(places)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(z, out=p)
            sums = p @ ones
        if not (len(z) and sums.min() > 1e-30 and sums.max() < 1e30):
            top = z.max(1, keepdims=True, initial=-np.inf)
            np.exp(z - top, out=p)
            sums, found = p @ ones, found - top[:, 0]
        loss -= (found - np.log(sums)).sum() / n
        sums *= n
        p *= (1 / sums)[:, None]
        p.ravel()[places] -= kind.type(1 / n)
        return p

    z, own = room("groups", kind, len(at), GROUPS), room("own groups", model.group.dtype, len(at), GROUPS)
    np.matmul(hid, up1, out=z)
    np.take(model.group, prev, axis=0, out=own, mode="clip")
    z += own
    d = softmax(z, group)
    g_up1, g_up2 = hid.T @ d, np.zeros_like(up2)
    np.matmul(d, up1.T, out=dhid)
    z, own = room("members", kind, len(at), MEMBERS), room("own members", model.member.dtype, len(at), MEMBERS)
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    spans = [(i, slice(cuts[i], cuts[i + 1])) for i in range(GROUPS) if cuts[i] < cuts[i + 1]]
    for i, part in spans:
        np.matmul(hid[part], up2[i], out=z[part])
    np.take(model.member.reshape(-1, MEMBERS), prev * GROUPS + group, axis=0, out=own, mode="clip")
    z += own
    d = softmax(z, target % MEMBERS)
    for i, part in spans:
        np.matmul(hid[part].T, d[part], out=g_up2[i])
        np.matmul(d[part], up2[i].T, out=more[part])
    dhid += more

    dh, dr, dm, flow = room("dh", kind, rows, DIM), room("dr", kind, rows, INNER), room("dm", kind, rows, DIM + 1), room("flow", kind, rows, DIM)
    dh2 = room("dh2", kind, rows, DIM)
    dh2.fill(0)
    dh2[at] = dhid
    np.matmul(dh2, w2.T, out=dr)
    dr *= np.greater(r, 0, out=room("active", np.dtype(bool), rows, INNER))
    np.matmul(dr, w1.T, out=dh)
    dh += dh2
    np.matmul(dh, wo.T, out=flow)
    # dm holds the gradient of the sums before the division, and in its last column what it takes off each share.
    np.divide(flow, f["z"].reshape(rows, 1), out=dm[:, :DIM])
    np.einsum("ij,ij->i", dm[:, :DIM], m, out=dm[:, DIM])
    np.negative(dm[:, DIM], out=dm[:, DIM])
    dm = dm.reshape(size, wide[1], DIM + 1)
    ds, d3, da = room("ds", kind, size, wide[1], t), room("d3", kind, size, t, 3 * DIM), room("da", kind, size, t, DIM)
    np.matmul(dm, f["v"].transpose(0, 2, 1), out=ds)
    ds *= f["u"]
    d3[:, :context, :DIM] = 0
    np.matmul(ds, f["k"], out=d3[:, context:, :DIM])
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=d3[:, :, DIM : 2 * DIM])
    np.matmul(f["u"].transpose(0, 2, 1), dm[:, :, :DIM], out=d3[:, :, 2 * DIM :])
    a, flat3 = f["a"].reshape(-1, DIM), d3.reshape(-1, 3 * DIM)
    np.matmul(flat3, f["w3"].T, out=da.reshape(-1, DIM))
    da[:, context:] += dh.reshape(wide)
    g3 = (flat3.T @ a).T
    g_e, g_pos = np.zeros_like(e), np.zeros_like(pos)
    order = np.argsort(x.astype(np.uint16).ravel(), kind="stable")
    found = x.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    sorted_ = room("sorted", kind, len(order), DIM)
    np.take(da.reshape(-1, DIM), order, axis=0, out=sorted_, mode="clip")
    g_e[found[first]] = np.add.reduceat(sorted_, first)
    g_pos[:t] = da.sum(0)
    return loss, [g_e, g_pos, g3[:, :DIM] * kind.type(DIM**-0.5), g3[:, DIM : 2 * DIM], g3[:, 2 * DIM :], m.T @ dh, h.T @ dr, r.T @ dh2, g_up1, g_up2]


def start_model(counts: np.ndarray, pairs: np.ndarray, of: np.ndarray, seed: int = 3) -> Model:
    """The model before training: shares and bigrams from counts (CLASSES + 1 x CLASSES), attention that adds nothing yet."""
    n, total = np.bincount(of, minlength=CLASSES), np.bincount(of, counts, CLASSES)
    share = np.log10((counts + 0.01) / (total + 0.01 * n)[of])
    alone = (pairs.sum(0) + 0.5).reshape(GROUPS, MEMBERS)
    inside, outside = alone / alone.sum(1, keepdims=True), alone.sum(1) / alone.sum()
    pairs = pairs.reshape(-1, GROUPS, MEMBERS)
    grouped = pairs.sum(2)
    group = np.log((grouped + 5 * outside) / (grouped.sum(1, keepdims=True) + 5))
    member = np.log((pairs + 5 * inside) / (grouped[:, :, None] + 5))
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    parts = [draw(CLASSES + 1, DIM) * 6, draw(WINDOW, DIM), *(draw(DIM, DIM) for _ in range(4)), draw(DIM, INNER), draw(INNER, DIM) * np.float32(0.5), np.zeros((DIM, GROUPS), np.float32), np.zeros((GROUPS, DIM, MEMBERS), np.float32)]
    return Model(of, share, group.astype(np.float32), member.astype(np.float32), parts)


class Flat(Adam):
    """Adam over copies of parts that lie end to end in one array: a step is few operations, not some for each part."""

    def __init__(self, parts: list[np.ndarray], rate: float):
        flat = np.concatenate([p.ravel() for p in parts])
        cuts = np.cumsum([p.size for p in parts])[:-1]
        self.parts = [u.reshape(p.shape) for u, p in zip(np.split(flat, cuts), parts, strict=True)]
        super().__init__([flat], rate)

    def step(self, grads: list[np.ndarray]) -> None:
        super().step([np.concatenate([g.ravel() for g in grads])])


def learn(model: Model, adam: Adam, classes: np.ndarray, lengths: np.ndarray, turn: int, rate: float) -> int:
    """Steps through this turn's part, one in ROUNDS, of the windows of texts of classes that lie end to end; how many there were."""
    if not len(lengths):
        return 0
    text, first, keep = windows(lengths, np.zeros(len(lengths), np.int64))
    start = (np.cumsum(lengths) - lengths)[text]
    order = np.random.default_rng(zlib.crc32(classes.tobytes())).permutation(len(text))
    chosen = order[turn % ROUNDS :: ROUNDS]
    for k in range(0, len(chosen), STEP):
        w = chosen[k : k + STEP]
        at = np.minimum(start[w, None] + first[w, None] + np.arange(CONTEXT, WINDOW), len(classes) - 1)
        _, grads = backward(before_of(classes, start[w], first[w]), classes[at], keep[w], model)
        adam.rate = rate / (1 + adam.turn / 1000)
        adam.step(grads)
    return len(chosen)


def text_ids(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a chunk, end to end, and the number of each."""
    seq, per, sizes = spread(row["seq"]), spread(row["per"]).astype(np.int64), spread(row["sizes"])
    first = np.cumsum(per) - per
    ids = spread(row["words"])[ragged(first[seq], per[seq])]
    return ids, np.add.reduceat(per[seq], np.cumsum(sizes) - sizes)


def training_classes(row: dict, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, lengths = text_ids(row)
    train = ~np.array(row["held"], bool)
    return of[ids[np.repeat(train, lengths)]], lengths[train]


def _rows(chunks: DataFrame, names: list[str], each, schema: str) -> DataFrame:
    """``each`` of an iterator of a task's chunks as dicts gives record batches."""

    def run(batches):
        yield from each(row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())

    return chunks.select(*names).mapInArrow(run, schema)


def counted(chunks: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the training documents."""

    def each(rows):
        total = np.zeros(size, np.int64)
        for row in rows:
            total += spread(row["tokens"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"key": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return _filled(_rows(chunks, ["tokens"], each, "key bigint, n bigint"), size)


def paired(chunks: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each class follows each, or begins a text, in the training documents: CLASSES + 1 x CLASSES."""
    shipped = chunks.sparkSession.sparkContext.broadcast(of)

    def each(rows):
        total = np.zeros((CLASSES + 1) * CLASSES, np.int64)
        for row in rows:
            classes, lengths = training_classes(row, shipped.value)
            if len(classes):
                before = np.concatenate([[CLASSES], classes[:-1]])
                before[np.cumsum(lengths) - lengths] = CLASSES
                total += np.bincount(before * CLASSES + classes, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"key": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    size = (CLASSES + 1) * CLASSES
    return _filled(_rows(chunks, ["held", "sizes", "seq", "words", "per"], each, "key bigint, n bigint"), size).reshape(CLASSES + 1, CLASSES)


def _filled(counts: DataFrame, size: int) -> np.ndarray:
    """Sums (key, n) as an array; keys are under ``size``, which bounds what the driver gets."""
    found, out = counts.groupBy("key").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size, np.int64)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out


def trained(chunks: DataFrame, model: Model) -> Model:
    """``model`` after ROUNDS rounds: every task trains on its own chunks, then all weights are averaged."""

    def packed(parts: list[np.ndarray], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"parts": pa.array([pickle.dumps(parts)], pa.binary()), "n": pa.array([n], pa.int64())})

    def mean(batches):
        total, n = None, 0
        for batch in batches:
            for parts, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [p.astype(np.float64) * k for p in pickle.loads(parts)]
                total, n = found if total is None else [a + b for a, b in zip(total, found, strict=True)], n + k
        if n:
            yield packed([(p / n).astype(np.float32) for p in total], n)

    for turn in range(ROUNDS):
        shipped = chunks.sparkSession.sparkContext.broadcast(model)

        def each(rows, turn=turn, shipped=shipped):
            start = shipped.value
            adam, n = Flat(start.parts, RATE), 0
            own = Model(start.of, start.share, start.group, start.member, adam.parts)
            for row in rows:
                n += learn(own, adam, *training_classes(row, own.of), turn, RATE / (1 + turn))
            if n:
                yield packed(own.parts, n)

        some = _rows(chunks, ["held", "sizes", "seq", "words", "per"], each, "parts binary, n bigint")
        row = some.repartition(32).mapInArrow(mean, some.schema).repartition(1).mapInArrow(mean, some.schema).first()
        if row:
            model = Model(model.of, model.share, model.group, model.member, pickle.loads(row["parts"]))
    return model


@dataclass
class Mixture:
    model: Model
    words: int  # training tokens
    kinds: int  # distinct ones
    known: float  # share of words that come from the counts
    phrases: int  # of all training documents
    kept: float  # share of phrases that come from the counts

    def spelled(self, row: dict) -> np.ndarray:
        """log10 probability of the ids of each word of the chunk, STRETCH words at a time."""
        seq, per, sizes, words = spread(row["seq"]), spread(row["per"]).astype(np.int64), spread(row["sizes"]), spread(row["words"])
        first, ends, out = np.cumsum(per) - per, np.cumsum(sizes), np.zeros(len(seq))
        for a in range(0, len(seq), STRETCH):
            b = min(len(seq), a + STRETCH)
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right") + 1  # texts of the stretch
            ids = words[ragged(first[seq[a:b]], per[seq[a:b]])]
            cuts = np.clip(np.concatenate([[a], ends[lo:hi]]), a, b)
            lengths = np.add.reduceat(per[seq[a:b]], cuts[:-1] - a)
            leads = np.zeros(len(lengths), np.int64)
            from_ = ends[lo] - sizes[lo]
            if from_ < a:  # its text goes on from the stretch before: the last ids there are context
                tail = seq[max(from_, a - CONTEXT) : a]
                tail = words[ragged(first[tail], per[tail])][-CONTEXT:]
                ids = np.concatenate([tail, ids])
                leads[0] = len(tail)
                lengths[0] += len(tail)
            logs = self.model.log_ids(ids, lengths, leads)[leads[0] :]
            n = per[seq[a:b]]
            out[a:b] = np.add.reduceat(logs, np.cumsum(n) - n)
        return out

    def scored(self, row: dict, pos: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base and score of each text of a chunk; ``total``: corpus counts of the hashes at ``pos``."""
        count = spread(row["own"]).astype(np.int64)
        count[pos] = total
        seq, sizes, span = spread(row["seq"]), spread(row["sizes"]).astype(np.int64), spread(row["span"]).astype(np.int64)
        phrase, kinds, starts = np.cumsum(spread(row["phrase"])), len(spread(row["per"])), np.cumsum(sizes) - sizes
        c = count[:kinds].astype(np.float64)
        norm = np.log10(self.words + SMOOTH * (self.kinds + 1))
        base = np.add.reduceat((np.log10(c + SMOOTH) - norm)[seq], starts)
        known = np.add.reduceat((c > 0).astype(np.int64)[seq], starts)
        with np.errstate(divide="ignore"):
            drawn = np.log(c * self.known / max(1, self.words))
            word = np.logaddexp(drawn[seq], self.spelled(row) * np.log(10) + np.log(1 - self.known))
            first = np.cumsum(span) - span
            doc = np.searchsorted(starts, first, "right") - 1
            pair = doc * (len(count) + 1) + phrase
            _, which, own = np.unique(pair, return_inverse=True, return_counts=True)
            others = count[kinds:][phrase] - np.where(np.array(row["held"], bool)[doc], 0, own[which])
            memory = np.log(np.maximum(others, 0) * (self.kept / max(1, self.phrases)))
            logs = np.logaddexp(memory, np.add.reduceat(word, first) + np.log(1 - self.kept))
        return sizes, known, base, np.add.reduceat(logs, np.searchsorted(first, starts)) / np.log(10)


def fitted(chunks: DataFrame, totals: DataFrame, path: str) -> Mixture:
    """The mixture of all training documents of ``chunks``; without any, nearly uniform."""
    enc = encoding(path)
    starts = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(enc.n_vocab)])
    starts[-1] = True
    counts = counted(chunks, enc.n_vocab)
    of = classes_of(counts, starts)
    model = trained(chunks, start_model(counts, paired(chunks, of), of))
    words, phrases = (x or 0 for x in chunks.agg(F.sum("learned"), F.sum("phrases")).first())
    once = totals.where("first").agg(F.count_if("word"), F.sum(F.when(~F.col("word") & (F.col("total") > 1), F.col("total")))).first()
    kinds, repeated = (x or 0 for x in once)
    return Mixture(model, words, kinds, COUNTED if words else 0.0, phrases, (repeated + 1) / (phrases + 2))


def score_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Learns from the documents outside fold 0 only. A null text is empty: one end. A long text is one chunk and
    is scored in stretches. Repeated rows give a row each, and each counts as a document; ids that are null
    are in fold 0. Without training documents every count is 0, and the model is nearly uniform. No documents
    give no rows. Other columns, whatever their names, are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = chunked(docs, path, id_col, text_col, folds)
    totals = totals_of(chunks)
    mixture = fitted(chunks, totals, path)
    shipped = docs.sparkSession.sparkContext.broadcast(mixture)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out, order = [], np.argsort(right["pos"].to_numpy(), kind="stable")
        pos, total = right["pos"].to_numpy()[order], right["total"].to_numpy()[order]
        for row in left.to_pylist():
            out.append((row["docs"], row["held"], *shipped.value.scored(row, pos, total)))
        docs, held, tokens, known, base, score = zip(*out, strict=True) if out else [()] * 6
        flat = lambda x, t: pa.array(np.concatenate([np.zeros(0), *x]), pa.float64()).cast(t)
        ids = pa.chunked_array([c.flatten() for c in left["docs"].chunks], left["docs"].type.value_type).combine_chunks()
        flags = pa.array([h for x in held for h in x], pa.bool_())
        return pa.table({"id": ids, "held_out": flags, "n_tokens": flat(tokens, pa.int64()), "n_known": flat(known, pa.int64()), "train_tokens": pa.array(np.full(len(ids), shipped.value.words), pa.int64()), "base_score": flat(base, pa.float64()), "score": flat(score, pa.float64())})

    left = chunks.select("chunk", "docs", "held", "sizes", "seq", "words", "per", "span", "phrase", "own").groupBy("chunk")
    out = left.cogroup(totals.select("chunk", "pos", "total").groupBy("chunk")).applyInArrow(scored, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"))
