"""Importance resampling against brute force: n-grams of several lengths, ties, odd rows; SQL on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import resampling

SF = "/root/testdata/sf0.001"


def grams(text, low, high):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + k]) for k in range(low, high + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, low, high, buckets, seed, min_words, percent):
    hashed = lambda gs: Counter(zlib.crc32(g.encode()) % buckets for g in gs)
    each = [(i, n, hashed(g)) for i, t in docs for n, g in [grams(t, low, high)]]
    s = sum((c for *_, c in each), Counter())
    t = sum((hashed(grams(x, low, high)[1]) for x in target), Counter())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for i, n, c in each:
        weight = sum(gain(b) * k for b, k in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1:]))
    rest = [r for r in rows if r[1] < min_words]
    most = len(able) * percent // 100
    return sorted(repr((r[0], *r[2:], k + 1 if k < most else None)) for k, r in [*enumerate(able), *((most, r) for r in rest)])


DOCS = [(k, " ".join(f"w{(k * k + j * j) % 37}" for j in range(k % 60))) for k in range(300)]
DOCS += [(7, "Straße ÉCOLE z9 日本 a.b\x00c " * 8)] * 5 + [(None, None), (None, "x " * 30), (500, ""), (501, "... !!!"), (502, "é" * 100_000 + " b" * 50)]


@pytest.mark.parametrize(("low", "high", "percent"), [(1, 1, 10), (1, 3, 50), (2, 2, 100)])
def test_equals_brute_force(spark, monkeypatch, low, high, percent):
    monkeypatch.setattr(resampling, "SLICE", 1000)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("bucket", F.lit(1))
    target = ["w1 w2 w3 w4", "W1 straße école", None]
    got = resampling.resample(docs, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), low, high, 64, 5, 20, percent)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(DOCS, target, low, high, 64, 5, 20, percent)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS[:50], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs, none).count() == 50
    assert resampling.resample(docs.limit(0), none).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(repr(tuple(r)) for r in resampling.query(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == sorted(map(repr, con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.ORACLE_SQL})").fetchall()))
