"""Rendezvous shards: balance, weights, few moves, gapless slots, odd rows; SQL of the same draw."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import ranks, sharding


def test_balance_weights_and_growth(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    got = sharding.rendezvous(rows, "k", [1.0] * 8 + [2.0], "shard", grown=1.0).collect()
    n = Counter(r.shard for r in got)
    assert all(abs(n[s] - 2000) < 250 for s in range(8)) and abs(n[8] - 4000) < 350
    assert all(r.grown_shard in (r.shard, 9) for r in got)
    assert 1500 < sum(r.grown_shard == 9 for r in got) < 2200
    again = sharding.rendezvous(rows, "k", [1.0] * 8 + [2.0, 1.0]).collect()
    assert {r.k: r.shard for r in again} == {r.k: r.grown_shard for r in got}


def test_documents_of_any_shape(spark):
    rows = [(None, None, 1)] * 40 + [(5, "é", 2)] * 60 + [(k, "t" * k, 3) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").withColumn("shard", F.lit("x"))
    got = sharding.shard_documents(docs, 7).collect()
    assert len(got) == 200
    for s in range(7):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(16, 0)}
    assert {r.size for r in got if r.doc_id == 5} == {18, 21}
    assert sharding.shard_documents(docs.limit(0), 7).collect() == []


def test_clashing_names_long_texts_and_ties(spark):
    rows = [(k % 3, f"a{k}", k) for k in range(9)]
    table = spark.createDataFrame(rows, "_x1 long, _X2 string, _best long")
    got = sharding.rendezvous(table, "_x1", [1.0, 2.0], "shard", grown=1.0).collect()
    assert sorted((r["_x1"], r["_X2"], r["_best"]) for r in got) == sorted(rows)
    assert all(len({r.shard for r in got if r["_x1"] == k}) == 1 for k in range(3))
    long = "ab" * 3_000_000
    (one,) = sharding.shard_documents(spark.createDataFrame([(1, long)], "doc_id long, text string"), 3).collect()
    assert (one.size, one.text_crc32, one.slot) == (len(long) + 16, zlib.crc32(long.encode()), 0)


def test_slots_with_more_parts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PART_ROWS", 2)
    docs = spark.createDataFrame([(k, "t") for k in range(400)], "doc_id long, text string")
    for s in range(3):
        slots = sorted(r.slot for r in sharding.shard_documents(docs, 3).collect() if r.shard == s)
        assert slots == list(range(len(slots)))
