"""Rules of the functions and operators by themselves: matrices, scans, codes, bytes, folds, streams."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import codes, tables
from tessera.operators import blocks, modes, neighbours, states, transforms
from tessera.sources import streams
from tessera.streaming import signals


@pytest.mark.parametrize("n", [4, 8, 16, 32, 64])
def test_cosine_matrix_is_nearly_orthogonal_and_follows_its_rule(n):
    m = tables.dct2(n)
    for k in range(n):
        for j in range(k + 1):
            got = sum(a * b for a, b in zip(m[k], m[j], strict=True)) / (64 * 64 * n)
            assert abs(got - (k == j)) < 0.02
        scale = 64 if k == 0 else 64 * math.sqrt(2)
        assert all(abs(v - scale * math.cos((2 * i + 1) * k * math.pi / (2 * n))) < 1.8 for i, v in enumerate(m[k]))


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_sine_matrices_are_nearly_orthogonal(n):
    for m in (tables.dst7(n), tables.dct8(n)):
        for k in range(n):
            for j in range(k + 1):
                assert abs(sum(a * b for a, b in zip(m[k], m[j], strict=True)) / (64 * 64 * n) - (k == j)) < 0.03


def test_scans_visit_every_place_once():
    for w, h in ((4, 4), (8, 16), (32, 8)):
        order = tables.scan(w, h)
        assert sorted(order) == [(x, y) for x in range(w) for y in range(h)] and order[0] == (0, 0) and order[-1] == (w - 1, h - 1)
    assert tables.scan(4, 4)[:4] == [(0, 0), (0, 1), (1, 0), (0, 2)]
    assert len(tables.scan(64, 64)) == 1024


def test_codes_have_their_known_values(spark):
    r = spark.createDataFrame([(0,), (1,), (3,), (7,)], "v long").select(codes.unsigned_exp_golomb(F.col("v")).alias("u"), codes.signed_exp_golomb(-F.col("v")).alias("s")).collect()
    assert [x.u for x in r] == ["1", "010", "00100", "0001000"] and [x.s for x in r] == ["1", "011", "00111", "0001111"]
    for q in (codes.truncated_binary(F.col("id"), 61), codes.rice(F.col("id"), F.lit(2))):
        found = [x.c for x in spark.range(61).select(q.alias("c")).collect()]
        assert len(set(found)) == 61
        assert not any(a != b and b.startswith(a) for a in found for b in found)


def test_protection_hides_start_codes_and_comes_off(spark):
    raw = ["000000", "00000001", "0000030000020000", "000003", "FF0000", "", "00000000000000"]
    r = spark.createDataFrame([(x,) for x in raw], "raw string").withColumn("p", codes.protect(F.col("raw"))).withColumn("back", codes.unprotect(F.col("p"))).collect()
    for x in r:
        assert x.back == x.raw
        pairs = [x.p[i : i + 2] for i in range(0, len(x.p), 2)]
        assert not any(pairs[i : i + 2] == ["00", "00"] and pairs[i + 2] in ("00", "01", "02") for i in range(len(pairs) - 2))


def test_units_and_boxes_of_broken_streams(spark):
    r = spark.createDataFrame([(1, ""), (2, "ABCD"), (3, "0000000100"), (4, "000001007980"), (5, None)], "id long, s string")
    assert [(x.id, x.seq, x.type, x.payload) for x in streams.units(r, "id", F.col("s")).collect()] == [(4, 0, 15, "80")]
    b = spark.createDataFrame([(1, ""), (2, "00000008"), (3, "000000086674797000"), (4, "FFFFFFFF66747970"), (5, "0000000766747970")], "id long, s string")
    assert [(x.id, x.name, x.payload) for x in streams.boxes(b, "id", F.col("s")).collect()] == [(3, "ftyp", "")]


def test_transforms_give_back_what_they_took(spark):
    rows = spark.createDataFrame([(y, [(x * 7 + y * 13) % 256 for x in range(64)]) for y in range(32)], "y long, row array<long>")
    for w, h in ((4, 4), (8, 8), (16, 4), (32, 32)):
        back = transforms.inverse(transforms.forward(rows, w, h), w, h).collect()
        assert len(back) == 64 * 32
        assert max(abs(r.r - ((r.bcol * w + r.i) * 7 + (r.brow * h + r.j) * 13) % 256) for r in back) <= 2
    errors = [transforms.round_trip(rows, 8, qp).agg(F.sum("ssd")).first()[0] for qp in (4, 22, 40)]
    assert errors == sorted(errors) and errors[0] < 32 * 64


def test_lossless_skip_quantization(spark):
    r = spark.range(-255, 256).select(F.col("id"), transforms.dequantize_skip(transforms.quantize_skip(F.col("id"), 4), 4).alias("back")).collect()
    assert all(x.id == x.back for x in r)


def test_flat_blocks(spark):
    flat = spark.range(64 * 64).select(F.expr("id div 64").alias("y"), (F.col("id") % 64).alias("x"), F.lit(100).cast("bigint").alias("v"))
    assert {r["var"] for r in blocks.variance(flat, 8).collect()} == {0}
    rows = spark.range(64).select(F.col("id").alias("y"), F.array_repeat(F.lit(100).cast("bigint"), 64).alias("row"))
    assert [(r.x, r.y, r["size"]) for r in blocks.quadtree(rows, 28).collect()] == [(0, 0, 64)]
    assert {(r.gx, r.gy) for r in blocks.gradients(rows, 8).collect()} == {(0, 0)}
    assert {r.satd for r in blocks.satd(rows, 8).collect()} == {6400}


def test_differences_and_filling(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 3, 9, 9, 0])], "k long, i long, v long")
    back = neighbours.running_sums(neighbours.differences(s, "k", "i"), "k", "i").collect()
    assert all(r.v == r.r for r in back)
    filled = neighbours.substituted(s, "k", "i", F.col("v") == 9, 128).orderBy("i").collect()
    assert [r.s for r in filled] == [9, 9, 9, 9, 9]
    assert {r.s for r in neighbours.substituted(s, "k", "i", F.lit(False), 128).collect()} == {128}


def test_mode_lists_hold_six_different_modes(spark):
    g = spark.range(67 * 67).select(modes.likely_modes(F.expr("id div 67"), F.col("id") % 67).alias("m")).collect()
    assert all(len(set(r.m)) == 6 and all(0 <= v <= 66 for v in r.m) for r in g)


def test_quantizer_states(spark):
    r = spark.createDataFrame([([1, 1, 0, -3, 2],)], "l array<int>").select(states.walk(F.col("l")).alias("s")).first()
    table = [[0, 2], [2, 0], [1, 3], [3, 1]]
    want, state = [], 0
    for v in [1, 1, 0, -3, 2]:
        want.append(state)
        state = table[state][v & 1]
    assert r.s == want


def test_stream_of_windowed_variance(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "a", float(v)) for h in (0, 1) for v in (2, 4, 6)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = signals.windowed_variance(events).writeStream.format("memory").queryName("variances").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r["var"] for r in spark.table("variances").collect()] == [56 // 3 - 16] * 2
