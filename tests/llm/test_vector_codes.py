"""Product codes against brute force and SQL: weights, ties, hot parts, padded, huge and odd vectors."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes as codes

SF = "/root/testdata/sf0.001"
MOST = (1 << 63) - 1


def brute(rows, parts, entries, rounds, scale=4096):
    """(id, label, code, error) sorted, and the codebooks, in plain integers."""
    fine = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return [], [[] for _ in range(parts)]
    length = max(parts, -(-max(len(v) for _, v, _ in fine) // parts) * parts)
    whole = [(i, tuple([max(-MOST - 1, min(MOST - 1023, math.floor(scale * x))) for x in v] + [0] * (length - len(v))), y) for i, v, y in fine]
    ids = {}
    for i, v, _ in whole:
        ids[i] = min(v, ids.get(i, v))
    first = [ids[i] for i in sorted(ids, key=lambda i: (i is None, i or 0))[:entries]]
    d = length // parts
    books = [[list(v[p * d : p * d + d]) for v in first] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * d : p * d + d], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            at = [near(p, v)[1] for _, v, _ in whole]
            for k in set(at):
                mine = [v[p * d : p * d + d] for (_, v, _), a in zip(whole, at, strict=True) if a == k]
                new[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        books = new
    out = []
    for i, v, y in whole:
        found = [near(p, v) for p in range(parts)]
        out.append((i, y, "".join(f"{k:02x}" for _, k in found), min(MOST, sum(min(MOST, e) for e, _ in found))))
    return sorted(map(repr, out)), books


def rows_of(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=12).round(3).tolist(), int(i) % 3) for i in rng.permutation(200)]
    rows += [(5, [0.25] * 12, None)] * 60 + [(900, None, 1), (901, [None] + [1.0] * 11, 1), (902, [math.nan] * 12, 1), (903, [math.inf] * 12, 1), (None, [1.0] * 12, 7), (904, [0.5] * 5, 7), (905, [], 7)]
    return rows


@pytest.mark.parametrize(("parts", "entries", "hot"), [(4, 8, 1000), (5, 16, 10), (4, 256, 2)])
def test_equals_brute_force(spark, monkeypatch, parts, entries, hot):
    monkeypatch.setattr(codes, "HOT", hot)
    rows = rows_of()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("x")).withColumn("row", F.lit(1))
    got, books = codes.compress(table, parts, entries, 3)
    want, wanted = brute(rows, parts, entries, 3)
    assert books == wanted
    assert sorted(repr((r.id, r.label, r.code, r.error)) for r in got.collect()) == want


def test_huge_vectors_are_exact(spark):
    rows = [(k, [float(3 * k) * 1e9, -1e7 * k, 1e300 * (k % 2), -1e14 - k], k % 2) for k in range(20)]
    got, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 2, 3, 2)
    want, wanted = brute(rows, 2, 3, 2)
    assert books == wanted and sorted(repr((r.id, r.label, r.code, r.error)) for r in got.collect()) == want


def test_tables_of_any_shape(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    got, books = codes.compress(empty)
    assert got.collect() == [] and books == [[]] * 8
    one, _ = codes.compress(spark.createDataFrame([(None, [1.5], "a")] * 3, "vec_id long, embedding array<float>, label string"))
    assert [(r.id, r.code, r.error, r.label) for r in one.collect()] == [(None, "00" * 8, 0, "a")] * 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cols = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = codes.query(spark, SF).select(*cols).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({codes.oracle_sql()})").fetchall()))
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    _, books = brute(rows, 8, 16, 6)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
