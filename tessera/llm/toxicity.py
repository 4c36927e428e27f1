"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word, between two blanks, has the embeddings of its character n-grams (3 to 6 bytes, hashed), so words of
no training text share them with those they resemble. The embeddings of a window of WINDOW words are
averaged and meet a linear softmax; a document's score is that of its worst window, wherever it begins, as a
few words make a long text toxic. Embeddings and softmax are trained jointly: each round scores all windows of the sample,
takes of each document its worst and a few others of clean ones, and steps through them; the first round takes of
toxic documents the window whose n-grams are most theirs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fitting import Adam, fit_in_task, fold, keep_where, labelled_sample, sigmoid
from .textkernels import BLOCK, LOWER, WHITE, _values, blocks, document_words, mix, powers

#: Bounds of the sample that the model is fitted on, and the bytes of it that are taken apart at a time.
FIT_ROWS, FIT_BYTES, FIT_BLOCK = 4000, 18 << 20, 1 << 18
SIZES, BUCKET_BITS, DIM, WINDOW, ROUNDS = (3, 4, 5, 6), 17, 8, 4, 12


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(word numbers, buckets) of the n-grams of each size; words are bounded by blanks on both sides in ``data``."""
    clean = np.where(WHITE[data], np.uint8(32), LOWER[data])
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values[clean] * up[: len(data)], out=run[1:])
    lengths = ends - starts
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts - 1, lengths)
    room = np.repeat(ends + 1, lengths) - at
    for n in SIZES:
        ok = room >= n
        i = at[ok]
        yield word[ok], (mix((run[i + n] - run[i]) * down[i] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def windows(docs: np.ndarray, step: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each window, and its document; windows begin ``step`` words apart.

    The last window of a document ends with it; no words, no window.
    """
    n = np.diff(docs)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // step)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * step, np.maximum(n[doc] - WINDOW, 0))
    return docs[doc] + first, docs[doc] + np.minimum(first + WINDOW, n[doc]), doc


@dataclass
class Model:
    gain: np.ndarray  # what the softmax makes of each bucket's embedding, for class 1 less class 0
    bias: float
    prior: float | None = None  # the score of all documents, if the sample had no two classes

    def word_scores(self, data, starts, ends) -> np.ndarray:
        """A score for each word, in stretches of BLOCK bytes so that a long text takes no more memory than a short one."""
        out = np.zeros(len(starts))
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), BLOCK)), len(starts)))
        for lo, hi in pairwise(cuts.tolist()):
            base = starts[lo] - 1
            total, count = np.zeros(hi - lo), np.zeros(hi - lo)
            for word, bucket in ngrams(data[base : ends[hi - 1] + 1], starts[lo:hi] - base, ends[lo:hi] - base):
                total += np.bincount(word, self.gain[bucket], hi - lo)
                count += np.bincount(word, minlength=hi - lo)
            out[lo:hi] = total / np.maximum(count, 1)
        return out

    def score_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the documents of a block of bytes that begins with a blank."""
        n = len(offsets) - 1
        if self.prior is not None:
            return np.full(n, self.prior)
        w = document_words(data, offsets)
        run = np.concatenate([[0.0], np.cumsum(self.word_scores(data, w.starts, w.ends))])
        a, b, doc = windows(w.docs, 1)
        worst = np.full(n, self.bias)
        if len(doc):
            found, first = np.unique(doc, return_index=True)
            worst[found] += np.maximum.reduceat((run[b] - run[a]) / (b - a), first)
        return sigmoid(worst)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.array([32], np.uint8), data]), offsets + 1


def shared_odds(words: np.ndarray, docs: np.ndarray, y: np.ndarray, grams: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Of each word the mean log-odds of its n-grams, from the documents of label 1 and 0 that hold their words."""
    n, size, at = len(per), 1 << BUCKET_BITS, np.concatenate([[0], np.cumsum(per)])
    pair = np.unique(np.repeat(np.arange(len(y)), np.diff(docs)) * n + words)
    in_docs = [np.bincount(pair[y[pair // n] == c] % n, minlength=n) for c in (0, 1)]
    counts, out = np.full((2, size), 0.5), np.zeros(n)
    stretches = [(lo, min(n, lo + 20_000)) for lo in range(0, n, 20_000)]  # there are some 25 n-grams a word
    for lo, hi in stretches:
        for c in (0, 1):
            counts[c] += np.bincount(grams[at[lo] : at[hi]], np.repeat(in_docs[c][lo:hi], per[lo:hi]), size)
    odds = np.log(counts[1] / ((y == 1).sum() + 1)) - np.log(counts[0] / ((y == 0).sum() + 1))
    for lo, hi in stretches:
        own = np.repeat(np.arange(hi - lo), per[lo:hi])
        out[lo:hi] = np.bincount(own, odds[grams[at[lo] : at[hi]]], hi - lo) / np.maximum(per[lo:hi], 1)
    return out


def fit(texts: list[str], y: np.ndarray, seed: int = 7) -> Model:
    """A model of the texts; without both labels, the share of label 1 (0 without any)."""
    size = 1 << BUCKET_BITS
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    hashes, docs, vocabulary, grams, per, known = [], [0], {}, [], [], 0
    for _, data, offsets in blocks(pa.array(texts, pa.string()), FIT_BLOCK):
        data, offsets = padded(data, offsets)
        w = document_words(data, offsets)
        _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        fresh = np.array([vocabulary.setdefault(h, len(vocabulary)) for h in w.hashes[first].tolist()], np.int64)
        new = first[fresh >= known]
        found = list(ngrams(data, w.starts[new], w.ends[new]))
        owner = np.concatenate([x for x, _ in found])
        grams.append(np.concatenate([x for _, x in found]).astype(np.int32)[np.argsort(owner, kind="stable")])
        per.append(np.bincount(owner, minlength=len(new)).astype(np.int32))
        known = len(vocabulary)
        hashes.append(fresh[inverse].astype(np.int32))
        docs += (w.docs[1:] - w.docs[0] + docs[-1]).tolist()
    words, docs = np.concatenate(hashes), np.array(docs)
    grams, per = np.concatenate(grams), np.concatenate(per)
    at = np.concatenate([[0], np.cumsum(per)])
    a, b, doc = windows(docs)
    # Each word of a clean text is clean by itself, so that a text that repeats one is too.
    clean = np.flatnonzero(np.repeat(y == 0, np.diff(docs)))
    single = clean[np.unique(words[clean], return_index=True)[1]]
    a, b, doc = np.concatenate([a, single]), np.concatenate([b, single + 1]), np.concatenate([doc, len(y) + np.arange(len(single)) // 48])
    label = np.append(y, np.zeros(doc.max() + 1 - len(y), np.int64))[doc]

    odds = shared_odds(words, docs, y, grams, per)
    table = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    head, bias = rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    adam = Adam([table, head, bias], 0.02)
    by_doc = np.argsort(doc, kind="stable")
    for turn in range(ROUNDS):
        gain = table @ (head[:, 1] - head[:, 0])
        each = np.add.reduceat(gain[grams], at[:-1]) / np.maximum(per, 1)
        run = np.concatenate([[0.0], np.cumsum(each[words])])
        score = (run[b] - run[a]) / np.maximum(b - a, 1)
        if not turn:  # where the model knows nothing yet, windows of what toxic documents share
            run = np.concatenate([[0.0], np.cumsum(odds[words])])
            score = np.where(label == 1, (run[b] - run[a]) / np.maximum(b - a, 1), rng.random(len(label)))
        rank = np.lexsort((-score, doc))
        place = np.arange(len(doc)) - np.searchsorted(doc[by_doc], doc[rank])
        chosen = rank[place < np.where(label[rank] == 1, 1 if turn else 3, 3)]
        rng.shuffle(chosen)
        for batch in np.array_split(chosen, max(1, len(chosen) // 1024, min(24, len(chosen) // 32))):
            spans = b[batch] - a[batch]
            token = np.repeat(a[batch] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            window, word = np.repeat(np.arange(len(batch)), spans), words[token]
            n = per[word]
            gram = grams[np.repeat(at[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            into, weight = np.repeat(window, n), np.repeat((1 / (spans[window] * n)).astype(np.float32), n)
            mean = np.stack([np.bincount(into, weight * table[gram, d], len(batch)) for d in range(DIM)], 1).astype(np.float32)
            z = mean @ head + bias
            p = sigmoid(z[:, 1] - z[:, 0]) - label[batch]
            part = np.where(label[batch] == 1, 0.5 / max(1, (label[batch] == 1).sum()), 0.5 / max(1, (label[batch] == 0).sum()))
            d = (p * part).astype(np.float32)
            dz = np.stack([-d, d], 1)
            pull = dz @ head.T
            grad = np.stack([np.bincount(gram, weight * pull[into, k], size) for k in range(DIM)], 1).astype(np.float32)
            adam.step([grad, mean.T @ dz, dz.sum(0)])
    return Model((table @ (head[:, 1] - head[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probabilities of label 1 of whole texts; null is empty."""
    return np.concatenate([np.zeros(0), *[model.score_block(*padded(data, offsets)) for _, data, offsets in blocks(texts)]])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, kept columns, score): the probability of label 1 of every whole text; a text without words has the bias's.

    A null text is empty; repeated rows give a row each with equal scores; no documents give no rows; columns
    that are not in ``keep`` are dropped.
    """
    kind = docs.select(F.col(id_col).alias("_id"), *keep).schema
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shipped.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(model, batch.column(batch.num_columns - 1)), pa.float64())], [*batch.schema.names[:-1], "_score"])

    scored = docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).alias("_words")).mapInArrow(run, kind.add("_score", "double"))
    return scored.withColumnsRenamed({"_id": id_col, "_score": "score"})


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    return fit_in_task(labelled_sample(docs, labels, "toxic", FIT_ROWS, FIT_BYTES), fit)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose probability of being toxic is under ``least``, all columns kept, whatever their names.

    Repeated rows stay or go together; a text without words, null ones too, has the bias's probability; texts
    are judged whole, in stretches of bounded memory. Without both labels, or without documents, see ``fit``.
    """
    return keep_where(docs, "text", lambda m, t: scores(m, t) < least, fit_on(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, fit_on(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
