"""Bounded samples of labelled documents, and what the numpy models share."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text, so it is in fold 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def chosen(size: np.ndarray, y: np.ndarray, max_bytes: int) -> np.ndarray:
    """Which of the texts, given in order, are taken: of each class as many as its share of ``max_bytes`` holds.

    A share is half, and what the other class leaves of its half. Texts over a sixteenth of a share come last,
    and each is taken only if it fits, so that none keeps others out.
    """
    taken, total = np.zeros(len(size), bool), np.array([size[y == c].sum() for c in (0, 1)])

    def fill(c: int, room: int) -> int:
        mine = np.flatnonzero(y == c)
        small = mine[size[mine] <= room // 16]
        small = small[np.cumsum(size[small]) <= room]
        taken[mine] = False
        taken[small] = True
        left = room - int(size[small].sum())
        for i in mine[size[mine] > room // 16]:
            if size[i] <= left:
                taken[i] = True
                left -= int(size[i])
        return room - left

    first = int(total[1] > total[0])  # the class with more bytes gets what the other leaves
    fill(first, max_bytes - fill(1 - first, max_bytes // 2))
    return taken


def _fitting(found: DataFrame, rows_per_class: int, max_bytes: int) -> DataFrame:
    """(_at, text, y): those of ``found`` (_at, _text, _y, _bytes) that ``chosen`` takes of the first ``rows_per_class`` distinct ones a class.

    Their repeats are kept if all fit into both bounds, else each counts once.
    """
    each = found.groupBy("_at", "_bytes", "_y").agg(F.count("*").alias("_n"))
    few = [each.where(each["_y"] == y).orderBy("_at").limit(rows_per_class) for y in (0, 1)]

    def run(batches):
        tables = list(batches)
        if not tables:
            return
        rows = pa.Table.from_batches(tables).sort_by("_at")
        size, n = rows["_bytes"].to_numpy().astype(np.int64), rows["_n"].to_numpy()
        taken = chosen(size, rows["_y"].to_numpy(), max_bytes)
        fits = n[taken].sum() <= 2 * rows_per_class and (n * size)[taken].sum() <= max_bytes
        yield pa.RecordBatch.from_pydict({"_at": pa.array(rows["_at"].to_numpy()[taken], pa.int64()), "_fits": pa.array(np.full(taken.sum(), fits))})

    room = cut(few[0].union(few[1]).repartition(1).mapInArrow(run, "_at bigint, _fits boolean"), "room")
    rows, head = found.join(F.broadcast(room), "_at", "left_semi"), room.first()
    if head and not head["_fits"]:
        rows = rows.dropDuplicates(["_at"])
    return cut(rows.select("_at", F.col("_text").alias("text"), F.col("_y").alias("y")), "fit")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, max_bytes: int, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y): whole texts and 0/1 labels of at most ``rows_per_class`` ids a class and ``max_bytes`` in all, fold 0 left out.

    The ids with the smallest hashes are taken, so the sample does not hang on the tables' layout; the bounds
    count rows that repeat an id and its text once. Null labels and null ids are left out; of differing labels of one id
    the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(fold(id_col, folds) != 0).groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64(F.lit(label), id_col)
    picked = [known.where(known["_y"] == y).orderBy(order, id_col).limit(rows_per_class) for y in (0, 1)]
    ids = F.broadcast(cut(picked[0].union(picked[1]), "picked").withColumnRenamed(id_col, "_id"))
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(ids, "_id")
    found = cut(found.select("_text", "_y", F.octet_length("_text").alias("_bytes"), F.xxhash64(F.lit(label), "_id", "_text").alias("_at")), "sample")
    return _fitting(found, rows_per_class, max_bytes)


def text_sample(docs: DataFrame, rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y = 0): at most ``rows`` distinct whole texts of at most ``max_bytes`` in all, those of the smallest id hashes."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id").limit(rows)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(cut(ids, "picked")), "_id")
    found = cut(found.select(F.xxhash64("_id", "_text").alias("_at"), "_text", F.octet_length("_text").alias("_bytes"), F.lit(0).alias("_y")), "sample")
    return _fitting(found, rows, max_bytes)


def fit_in_task(sample: DataFrame, fit: Callable) -> Any:
    """``fit(texts, labels)`` on a bounded sample (text, y), in one task, so that the driver needs no memory for it."""

    def run(batches):
        tables = list(batches)
        rows = pa.Table.from_batches(tables).sort_by("_at") if tables else pa.table({"text": [], "y": []})
        model = fit(rows["text"].to_pylist(), np.array(rows["y"].to_pylist(), np.int64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], np.zeros(0, np.int64))


def keep_where(docs: DataFrame, text_col: str, judge: Callable[[Any, pa.Array], np.ndarray], model: Any) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for whose texts ``judge(model, texts)`` is true."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(judge(shipped.value, batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, np.float64)))


class Adam:
    """Adam over a list of arrays, changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.turn = params, rate, 0
        self.first, self.second = ([np.zeros_like(p) for p in params] for _ in range(2))

    def step(self, grads: list[np.ndarray]) -> None:
        self.turn += 1
        for p, g, m, v in zip(self.params, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)
