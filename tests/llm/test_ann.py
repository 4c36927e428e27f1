"""Neighbours against brute force: recall, completeness, order, ties, norms, odd vectors, split cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def exact(rows, k, every=5, dim=16):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)}
    return {q: sorted(((-float((x * y).sum()), i) for i, y in ok.items() if i != q))[:k] for q, x in ok.items() if q % every == 0}


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + j, rows[3][1]) for j in range(30)]
    rows += [(1000, None), (1005, [0.0] * 16), (1010, [None] + [1.0] * 15), (1015, [float("nan")] * 16), (1020, [float("inf")] * 16), (1025, [1.0] * 3)]
    return rows


def found_of(table, every, k):
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % every == 0, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for found in got.values():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    return got


def recall(got, want):
    hits = 0
    for q, found in got.items():
        by_id = {i: s for _, i, s in found}
        hits += sum(i in by_id and abs(by_id[i] + s) < 1e-12 * (1 + abs(s)) for s, i in want[q])
    return hits / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("cell", [ann.CELL, 100])
def test_neighbours_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "QUERIES", 40)
    monkeypatch.setattr(ann, "HELD", 500)
    rows = data()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("cell", F.lit(2))
    got, want = found_of(table, 5, 10), exact(rows, 10)
    assert set(got) == set(want)
    assert all(len(f) == 10 for f in got.values())
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("kind", ["outlier", "lognormal"])
def test_uneven_norms(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "outlier":
        x[17] *= 1000
    else:
        x *= rng.lognormal(0, 0.7, (800, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20), exact(rows, 20, 20)
    assert all(len(f) == 20 for f in got.values()) and set(got) == set(want)
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("n", [2, 10, 21, 60])
def test_small_tables_are_complete(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
    got, want = found_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20), exact(rows, 20)
    assert {q: [i for _, i, _ in f] for q, f in got.items()} == {q: [i for _, i in w] for q, w in want.items()}


def test_the_exact_way_for_the_rest(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 10 == 0, 20, probes=1, functions=8, tables=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = exact(rows, 20, 10)
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()} == {q: [i for _, i in w] for q, w in want.items()}


def test_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.lit(True)).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(one, F.lit(True)).collect() == []


def test_lengths_as_frequent_and_tiny_numbers(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [1e-200, 1e-200])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(a, b) for a in (0, 1, 4) for b in (0, 1, 4) if a != b}


def test_probes_come_in_order_of_cost():
    rest = np.random.default_rng(2).random((4, 6))
    steps = ann.perturbations(rest, 50)
    cost = np.where(steps == -1, rest[:, None] ** 2, np.where(steps == 1, (1 - rest[:, None]) ** 2, 0)).sum(2)
    assert (np.diff(cost, axis=1) >= -1e-12).all() and (steps[:, 0] == 0).all()
    assert all(len({tuple(s) for s in one}) == 50 for one in steps)
