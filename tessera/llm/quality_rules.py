"""Quality rules by line labelling with a linear-chain conditional random field.

Each line with a word is a step of a chain with two states, boilerplate and content. A step's score comes
from features of the line (signs, capitals, repetition, length, ending), a pair's from a transition weight;
Viterbi decoding finds the best labelling, and the share of words in content lines decides retention. The
weights are fitted by the chain's likelihood on a bounded sample: the lines of documents labelled good are
taken as content, those of bad ones as boilerplate, which is noisy line by line but not in sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .fitting import Adam, fit_in_task, labelled_sample
from .textkernels import WHITE, blocks, document_words, window_hashes

FIT_ROWS, FIT_BYTES, SEGMENT, STEPS = 2000, 12 << 20, 48, 200
#: Share of a document's words that must stand in content lines.
CONTENT = 0.5
MIN_WORDS, RUN, MAX_REPEATED = 10, 5, 20

SYMBOL, UPPER, LETTER, DIGIT, SHOUT = (np.zeros(256, bool) for _ in range(5))
SYMBOL[list(b"#*$%&|<>")] = UPPER[65:91] = DIGIT[48:58] = SHOUT[list(b"!?")] = True
LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
FEATURES = 10


def _sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(table[data])])


@dataclass
class Lines:
    """The lines of a block that hold a word, and counts of its documents."""

    features: np.ndarray
    words: np.ndarray  # of each line
    docs: np.ndarray  # docs[i] .. docs[i + 1]: the lines of document i
    counts: np.ndarray  # documents x (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)


def repeated_words(hashes: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a run of ``width`` words that occurs twice or more in the document."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    runs = window_hashes(hashes, width)
    if len(runs) > 1:
        order = np.argsort(runs, kind="stable")
        same = runs[order][1:] == runs[order][:-1]
        at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + width, -1)
    return np.cumsum(covered)[:-1] > 0


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    w = document_words(data, offsets, lower=False)
    n = len(offsets) - 1
    counts = np.zeros((n, 5), np.int64)
    symbols = _sums(data, SYMBOL)
    counts[:, 0] = np.diff(w.docs)
    counts[:, 1] = np.diff(_sums(data, FIRST & ~WHITE)[offsets])
    counts[:, 2] = np.diff(symbols[offsets])
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.append(begin[1:], len(data)) - 1  # without the line's \n, or the blank between documents
    first = np.searchsorted(w.starts, begin)
    words = np.searchsorted(w.starts, end) - first
    full = words > 0
    begin, end, first, words = begin[full], end[full], first[full], words[full]
    docs = np.searchsorted(begin, offsets)
    raw, double = data.tobytes(), np.zeros(len(begin), bool)
    covered, beside = np.zeros(len(w.hashes), bool), np.zeros(len(w.hashes), bool)
    beside[1:] = w.hashes[1:] == w.hashes[:-1]
    for i in range(n):
        seen: set[bytes] = set()
        for k in range(docs[i], docs[i + 1]):
            line = raw[begin[k] : end[k]]
            if line in seen:
                double[k] = True
            else:
                seen.add(line)
        a, b = w.docs[i], w.docs[i + 1]
        covered[a:b] = repeated_words(w.hashes[a:b], RUN)
        counts[i, 4] = covered[a:b].sum()
    counts[:, 3] = np.diff(np.concatenate([[0], np.cumsum(double)])[docs])

    share = lambda sums, base: (sums[end] - sums[begin]) / np.maximum(base, 1)
    of_words = lambda flags: (lambda s: (s[first + words] - s[first]) / words)(np.concatenate([[0], np.cumsum(flags)]))
    size, letters = end - begin, _sums(data, LETTER)
    letters = letters[end] - letters[begin]
    last = data[w.ends[first + words - 1] - 1] if len(words) else np.zeros(0, np.uint8)
    features = np.stack(
        [np.ones(len(size)), np.minimum(1, 5 * share(symbols, size)), share(_sums(data, UPPER), letters), np.minimum(1, 5 * share(_sums(data, SHOUT), size)), share(_sums(data, DIGIT), size), of_words(covered), of_words(beside), double, words < 3, np.isin(last, list(b".!?"))],
        1,
    )
    return Lines(features, words, docs, counts)


@dataclass
class Crf:
    weights: np.ndarray  # features x 2 states
    turn: np.ndarray  # 2 x 2: from, to

    def labels(self, lines: Lines) -> np.ndarray:
        """Best states (1: content) of all lines, document by document."""
        score = (lines.features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.turn.tolist()
        out = np.zeros(len(score), np.int8)
        for a, b in zip(lines.docs[:-1].tolist(), lines.docs[1:].tolist(), strict=True):
            if a == b:
                continue
            zero, one = score[a]
            back = []
            for e0, e1 in score[a + 1 : b]:
                p0, p1 = zero + t00 < one + t10, zero + t01 < one + t11
                zero, one = (one + t10 if p0 else zero + t00) + e0, (one + t11 if p1 else zero + t01) + e1
                back.append((p0, p1))
            state = int(one >= zero)
            out[b - 1] = state
            for k in range(b - 2, a - 1, -1):
                state = int(back[k - a][state])
                out[k] = state
        return out

    def content(self, lines: Lines) -> np.ndarray:
        """Share of each document's words that stand in content lines; 0 without words."""
        run = np.concatenate([[0], np.cumsum(lines.words * self.labels(lines))])
        return (run[lines.docs[1:]] - run[lines.docs[:-1]]) / np.maximum(lines.counts[:, 0], 1)


def likelihood(weights: np.ndarray, turn: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of chains (chains x steps x features) and its gradients, by forward and backward sums."""
    n, t, _ = x.shape
    e = x @ weights
    one = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    ahead[:, 0] = e[:, 0]
    for k in range(1, t):
        step = np.stack([one(ahead[:, k - 1] + turn[:, s]) for s in (0, 1)], 1) + e[:, k]
        ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
    for k in range(t - 2, -1, -1):
        step = np.stack([one(turn[s] + e[:, k + 1] + behind[:, k + 1]) for s in (0, 1)], 1)
        behind[:, k] = np.where(mask[:, k + 1, None], step, 0)
    total = one(ahead[:, -1])
    truth = np.stack([1 - y, y], 2) * mask[..., None]
    p = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
    g_weights = np.einsum("n,nts,ntf->fs", each, truth - p, x)
    g_turn, value = np.zeros((2, 2)), (truth * e).sum((1, 2)) - total
    for k in range(1, t):
        pair = np.exp(ahead[:, k - 1, :, None] + turn + (e[:, k] + behind[:, k])[:, None, :] - total[:, None, None])
        g_turn += np.einsum("n,nij->ij", each * mask[:, k], truth[:, k - 1, :, None] * truth[:, k, None, :] - pair)
        value += (truth[:, k - 1, :, None] * truth[:, k, None, :] * turn).sum((1, 2)) * mask[:, k]
    return float((each * value).sum()), g_weights, g_turn


def fit(texts: list[str], y: np.ndarray) -> Crf:
    """A field fitted on documents labelled good (1) or bad (0); without both, one that calls every line content."""
    if len(set(y.tolist())) < 2:
        return Crf(np.stack([np.zeros(FEATURES), np.eye(FEATURES)[0]], 1), np.zeros((2, 2)))
    chains, labels, at = [], [], 0
    for _, data, offsets in blocks(pa.array(texts, pa.string()), 1 << 18):
        lines = lines_of(data, offsets)
        for i, (a, b) in enumerate(zip(lines.docs[:-1], lines.docs[1:], strict=True)):
            for k in range(a, b, SEGMENT):
                chains.append(lines.features[k : min(b, k + SEGMENT)])
                labels.append(y[at + i])
        at += len(offsets) - 1
    if not chains:
        return fit([], np.zeros(0, np.int64))
    x, mask = np.zeros((len(chains), SEGMENT, FEATURES)), np.zeros((len(chains), SEGMENT), bool)
    for i, c in enumerate(chains):
        x[i, : len(c)], mask[i, : len(c)] = c, True
    state = np.repeat(np.array(labels, float)[:, None], SEGMENT, 1)
    of_line = 0.5 / np.maximum(np.bincount(labels, mask.sum(1), 2), 1)
    each = of_line[np.array(labels)]
    weights, turn = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    adam = Adam([weights, turn], 0.1)
    for _ in range(STEPS):
        _, gw, gt = likelihood(weights, turn, x, mask, state, each)
        adam.step([-gw + 1e-4 * weights, -gt + 1e-3 * turn])
    return Crf(weights, turn)


def judge_documents(docs: DataFrame, field: Crf, id_col: str = "doc_id", text_col: str = "text", content: float = CONTENT) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept) of every whole text.

    A null or blank text has no words and fails. Repeated rows give a row each; other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        crf = shipped.value
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                lines = lines_of(data, offsets)
                c, share = lines.counts, crf.content(lines)
                failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEATED * c[:, 0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(c)), *[pa.array(c[:, k]) for k in range(5)], pa.array(failed), pa.array(share), pa.array(~failed & (share >= content))], ["id", *names, "base_failed", "content_share", "kept"])

    schema = f"id {kind}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, content_share double, kept boolean"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fit_on(docs: DataFrame, labels: DataFrame) -> Crf:
    return fit_in_task(labelled_sample(docs, labels, "quality", FIT_ROWS, FIT_BYTES), fit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge_documents(docs, fit_on(docs, labels)).drop("content_share")
