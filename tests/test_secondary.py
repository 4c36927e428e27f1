"""The secondary transform: kernels of unit rows, positions, sets, and the way back."""

import random

from pyspark.sql import functions as F

from tessera.operators import secondary


def test_bases_are_orthonormal_and_positions_fixed():
    for side, rows in ((8, 16), (4, 8)):
        for candidate in (1, 2):
            for k in secondary.bases(side, rows, candidate):
                for i, a in enumerate(k):
                    for j, b in enumerate(k):
                        assert abs(sum(x * y for x, y in zip(a, b, strict=True)) / 16384 - (i == j)) < 0.06
    assert len(secondary.positions(8)) == 48 and len(secondary.positions(4)) == 16 and secondary.places(8)[:4] == [(0, 0), (0, 1), (1, 0), (0, 2)]


def test_sets_by_mode(spark):
    angles = [*range(-14, 0), *range(81)]
    got = spark.createDataFrame([(a,) for a in angles], "a long").select("a", secondary.lookup(F.col("a")).alias("p")).select("a", "p", secondary.set_of(F.col("p")).alias("s"), secondary.turned(F.col("p")).alias("t")).collect()
    table = [0] * 2 + [1] * 11 + [2] * 11 + [3] * 21 + [2] * 11 + [1] * 39
    for r in got:
        assert r.p == (r.a + 81 if r.a < 0 else r.a + 14 if r.a >= 67 else r.a) and r.s == table[r.p] and r.t == (r.p >= 81 or 34 < r.p < 67)


def test_forward_and_back_against_sums_on_lists(spark):
    rng = random.Random(3)
    for w, h in ((4, 4), (8, 8), (16, 8), (4, 16)):
        side, rows = secondary.shape(w, h)
        kernels, at, to = secondary.bases(side, rows, 2), secondary.positions(side), secondary.places(side)[:rows]
        data = [(p, [rng.randrange(-900, 900) for _ in range(w * h)]) for p in (0, 5, 20, 30, 40, 60, 85)]
        table = spark.createDataFrame(data, "p long, b array<long>")
        table = table.withColumn("f", secondary.forward(F.col("b"), F.col("p"), w, h, kernels)).withColumn("r", secondary.inverse(F.col("f"), F.col("p"), w, h, kernels))
        for row in table.collect():
            set_ = 0 if row.p <= 1 else 3 if 24 <= row.p <= 44 else 2 if 13 <= row.p <= 55 else 1
            swap = row.p >= 81 or 34 < row.p < 67
            place = [(y, x) if swap else (x, y) for x, y in at]
            out = [(sum(a * row.b[y * w + x] for a, (x, y) in zip(k, place, strict=True)) + 64) >> 7 for k in kernels[set_]]
            want = [0] * (w * h)
            for v, (x, y) in zip(out, to, strict=True):
                want[y * w + x] = v
            back = [0] * (w * h)
            for i, (x, y) in enumerate(place):
                back[y * w + x] = max(-32768, min(32767, (sum(k[i] * v for k, v in zip(kernels[set_], out, strict=True)) + 64) >> 7))
            assert list(row.f) == want and list(row.r) == back
        # what the kept rows span comes back, but for rounding
        span = [0] * (w * h)
        for i, (x, y) in enumerate(at):
            span[y * w + x] = round(sum(k[i] * 40 for k in kernels[0]) / 16)
        one = spark.createDataFrame([(0, span)], "p long, b array<long>").withColumn("f", secondary.forward(F.col("b"), F.col("p"), w, h, kernels))
        (r,) = one.select(secondary.inverse(F.col("f"), F.col("p"), w, h, kernels).alias("r")).collect()
        assert max(abs(a - b) for a, b in zip(r.r, span, strict=True)) <= max(3, max(map(abs, span)) // 12)


def test_sums_are_made_once_a_block(spark):
    table = spark.createDataFrame([(5, [1] * 64)], "p long, b array<long>")
    kernels = secondary.bases(8, 8, 1)
    for f in (secondary.forward, secondary.inverse):
        plan = table.select(f(F.col("b"), F.col("p"), 8, 8, kernels).alias("r"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("zip_with(") == 1 and "THEN element_at(lambda" in plan and "THEN element_at(transform" not in plan
