"""Quality by random indexing, pooling and a two-layer network with calibrated probabilities.

Tokens are runs of letters and digits, and runs of other signs, as written. Every token has a fixed sparse
random index vector, drawn from its hash; the vector of a word is the sum of the index vectors around it in
the sample, scaled to length one. Words of the vocabulary have their own vector; any other word has that of
its shape (case, kind and length). A document pools the mean over its tokens, the mean over its distinct
tokens, and a few counts; a network with one hidden layer makes a logit of that, and a temperature, fitted on
documents kept out of training, makes the logit a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fitting import Adam, fit_in_task, fold, keep_where, labelled_sample, sigmoid
from .textkernels import BLOCK, WHITE, _values, blocks, mix, powers

#: Bounds of the sample, of the vocabulary, and the sizes of vectors and hidden layer.
FIT_ROWS, FIT_BYTES, VOCABULARY, DIM, ONES, WINDOW, HIDDEN = 3000, 16 << 20, 16_384, 48, 4, 2, 32

KIND = np.full(256, 2, np.uint8)  # 0 blank, 1 letter or digit, 2 other sign
KIND[WHITE] = 0
for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    KIND[lo:hi] = 1
UPPER, DIGIT = (np.zeros(257, np.int64) for _ in range(2))
UPPER[65:91] = DIGIT[48:58] = 1
SHAPES = 256


def _stretch(data: np.ndarray) -> tuple[np.ndarray, ...]:
    kind = KIND[data]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    starts, ends = change[:-1], change[1:]
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values[data] * up[: len(data)], out=run[1:])
    hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    size = ends - starts
    big, digit = (np.concatenate([[0], np.cumsum(t[data])]) for t in (UPPER, DIGIT))
    big, digit = big[ends] - big[starts], digit[ends] - digit[starts]
    case = np.where(big == 0, 0, np.where(big == size, 2, 1))
    form = np.where(kind[starts] == 2, 4, np.where(digit > 0, 3, case))
    return starts, hashes, form * 16 + np.minimum(size, 15)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, shapes and document bounds of the tokens; stretches of BLOCK bytes end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            gap = np.flatnonzero(WHITE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(len(data), end + BLOCK)
        s, h, f = _stretch(data[at:end])
        parts.append((s + at, h, f))
        at = end
    starts, hashes, shapes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, shapes, np.searchsorted(starts, offsets)


def index_places(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ONES places and signs (+1, -1) of each token's random index vector, drawn from its hash."""
    drawn = [mix(hashes + np.uint64(k + 1)) for k in range(ONES)]
    return [((h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)) for h in drawn]


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the vocabulary
    vectors: np.ndarray  # of the vocabulary, then of the shapes
    center: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    prior: float | None = None

    def entries(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == hashes, at, len(self.known) + shapes) if len(self.known) else shapes

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, shapes, docs = tokens(data, offsets)
        entry = self.entries(hashes, shapes)
        out = np.zeros((len(offsets) - 1, 2 * DIM + 4), np.float32)
        for i, (a, b) in enumerate(zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)):
            if b > a:
                used, n = np.unique(entry[a:b], return_counts=True)
                v = self.vectors[used]
                words = len(np.unique(hashes[a:b]))
                out[i, :DIM], out[i, DIM : 2 * DIM] = n.astype(np.float32) @ v / (b - a), v.mean(0)
                out[i, 2 * DIM :] = np.log1p(b - a), np.log(words / (b - a)), (shapes[a:b] >= 64).mean(), (shapes[a:b] // 16 == 2).mean()
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return _forward((pooled - self.center) / self.spread, self.layers)[1]

    def score_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        return sigmoid(self.logits(self.pooled(data, offsets)) / self.temperature)


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.maximum(x @ w1 + b1, 0)
    return h, (h @ w2 + b2)[:, 0]


def word_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, vectors): the most frequent words of the sample, then a vector for each shape."""
    parts = [tokens(data, offsets) for _, data, offsets in blocks(pa.array(texts, pa.string()))]
    words, count = np.unique(np.concatenate([h for h, _, _ in parts] or [np.zeros(0, np.uint64)]), return_counts=True)
    known = np.sort(words[np.lexsort((words, -count))][:VOCABULARY])
    size = (len(known) + SHAPES) * DIM
    total = np.zeros(size)
    for hashes, shapes, docs in parts:
        if not len(hashes):
            continue
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        entry = np.where(known[at] == hashes, at, len(known) + shapes)
        doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
        places = index_places(np.where(entry < len(known), hashes, mix(shapes.astype(np.uint64))))
        for step in range(1, WINDOW + 1):
            together = np.flatnonzero(doc[step:] == doc[:-step])
            for one, other in ((together, together + step), (together + step, together)):
                for rows in (entry[one], len(known) + shapes[one]):
                    for place, sign in places:
                        total += np.bincount(rows * DIM + place[other], sign[other], size)
    total = total.reshape(-1, DIM)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return known, total.astype(np.float32)


def fit(texts: list[str], y: np.ndarray, seed: int = 11) -> Model:
    """A model of the texts; without both labels, the share of label 1 (0 without any).

    The temperature stays 1 where a class has but one document, as none can then be kept apart.
    """
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros((SHAPES, DIM), np.float32), np.zeros(1), np.ones(1), [], 1.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    known, vectors = word_vectors(texts)
    model = Model(known, vectors, np.zeros(1), np.ones(1), [], 1.0)
    x = np.concatenate([model.pooled(data, offsets) for _, data, offsets in blocks(pa.array(texts, pa.string()))])
    model.center, model.spread = x.mean(0), x.std(0) + 1e-3
    x = ((x - model.center) / model.spread).astype(np.float32)
    apart = np.zeros(len(y), bool)
    for c in (0, 1):  # of each class, so that both are on both sides; a class of one document is learned only
        mine = rng.permutation(np.flatnonzero(y == c))
        apart[mine[: -(-15 * (len(mine) - 1) // 100)]] = True
    inside = np.flatnonzero(~apart)
    n = x.shape[1]
    layers = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    adam, weight = Adam(layers, 0.003), 0.5 / np.maximum(np.bincount(y[inside], minlength=2), 1)
    for _ in range(60):
        rng.shuffle(inside)
        for batch in np.array_split(inside, max(1, len(inside) // 128)):
            h, z = _forward(x[batch], layers)
            d = ((sigmoid(z) - y[batch]) * weight[y[batch]] * len(inside) / len(batch))[:, None]
            back = d @ layers[2].T * (h > 0)
            adam.step([x[batch].T @ back + 1e-4 * layers[0], back.sum(0), h.T @ d + 1e-4 * layers[2], d.sum(0)])
    model.layers = [p.astype(np.float32) for p in layers]
    z, t = _forward(x[apart], layers)[1], y[apart]
    if len(set(t.tolist())) < 2:
        return model
    losses = []
    for temperature in np.geomspace(0.25, 16, 61):
        p = np.clip(sigmoid(z / temperature), 1e-9, 1 - 1e-9)
        losses.append((-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean(), temperature))
    model.temperature = min(losses)[1]
    return model


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probabilities of label 1 of whole texts; null is empty."""
    return np.concatenate([np.zeros(0), *[model.score_block(data, offsets) for _, data, offsets in blocks(texts)]])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, kept columns, score): the probability of label 1 of every whole text; an empty text pools to zeros.

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
    return fit_in_task(labelled_sample(docs, labels, "quality", FIT_ROWS, FIT_BYTES), fit)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose probability of good quality is ``least`` or more, all columns kept, whatever their names.

    Repeated rows stay or go together; a null text counts as empty and is judged like one; texts are judged
    whole, in stretches of bounded memory. Without both labels, or without documents, see ``fit``.
    """
    return keep_where(docs, "text", lambda m, t: scores(m, t) >= least, fit_on(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, fit_on(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
