"""Coding tree, prediction, readers, padding and rate quantization by themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import codes
from tessera.operators import partition, prediction, rates
from tessera.plans import catalogue, rules  # noqa: F401, the second adds its queries to the first
from tessera.sources import planes, streams

STATE = ("x", "y", "w", "h", "qt_depth", "mt_depth", "bt_depth", "implicit", "part")


def node(spark, **more):
    row = dict.fromkeys(STATE, 0) | {"w": 32, "h": 32, "last": "quad"} | more
    table = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'last' else 'long'}" for k in row))
    return table, {k: F.col(k) for k in row}


@pytest.mark.parametrize("split", partition.SPLITS)
def test_children_cover_their_node_once(spark, split):
    table, n = node(spark, x=64, y=32, w=32, h=16)
    parts = table.select(F.explode(partition.children(n, F.lit(split), F.lit(False))).alias("c")).select("c.*").collect()
    cells = [(x, y) for p in parts for x in range(p.x, p.x + p.w) for y in range(p.y, p.y + p.h)]
    assert sorted(cells) == [(x, y) for x in range(64, 96) for y in range(32, 48)]
    assert [p.part for p in parts] == list(range(len(parts)))


def test_splits_at_the_edge_and_in_the_middle_of_thirds(spark):
    for more, want in (({}, "none"), ({"x": 496}, "bin_v"), ({"y": 240}, "bin_h"), ({"x": 496, "y": 240}, "quad"), ({"x": 448, "w": 128, "h": 128}, "quad")):
        table, n = node(spark, **more)
        assert table.select(partition.forced_split(n, 512, 256).alias("s")).first().s == want
    table, n = node(spark, w=16, h=16, last="tri_v", part=1, mt_depth=1)
    may = table.select(*[c.alias(k) for k, c in partition.allowed_splits(n, F.lit("none")).items()]).first().asDict()
    assert may == {"none": True, "quad": False, "bin_h": True, "bin_v": False, "tri_h": True, "tri_v": True}


def test_flat_references_predict_flat_blocks(spark):
    refs = spark.createDataFrame([(1, [77] * 17, [77] * 17)], "id long, top array<long>, left array<long>")
    got = prediction.luma(refs, 8).groupBy("mode").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n")).collect()
    assert len(got) == 67 and all((r.a, r.b, r.n) == (77, 77, 64) for r in got)


def test_codes_that_are_cut_off(spark):
    rows = spark.createDataFrame([("00101",), ("001",), ("000",), ("",), ("1",)], "b string")
    got = rows.select(codes.read_unsigned(F.col("b"), F.lit(0)).alias("r"), codes.read_bits(F.col("b"), F.lit(1), F.lit(3)).alias("n")).collect()
    assert [(r.r.value, r.r.used, r.n) for r in got] == [(4, 5, 2), (None, None, None), (None, None, None), (None, None, None), (0, 1, None)]


def test_boxes_without_a_bound(spark):
    data = "".join(f"{8 + 1:08X}" + "66726565" + f"{k % 256:02X}" for k in range(150))
    got = streams.boxes(spark.createDataFrame([(1, data)], "id long, d string"), "id", F.col("d")).orderBy("seq").collect()
    assert len(got) == 150 and got[149].payload == f"{149:02X}"


def test_padding_of_any_height(spark):
    for height in (1, 7, 8, 9):
        rows = spark.createDataFrame([(y, [y] * 64) for y in range(height)], "y long, row array<long>")
        got = sorted((r.y, r.row[0]) for r in planes.padded(rows, 8).collect())
        assert got == [(y, min(y, height - 1)) for y in range(-(-height // 8) * 8)]
    assert planes.padded(spark.createDataFrame([], "y long, row array<long>"), 8).collect() == []


def test_rate_quantization_keeps_signs_and_drops_lone_small_levels(spark):
    rows = [(0, 0, u, v, 0) for u in range(8) for v in range(8)] + [(0, 1, u, v, {(0, 0): -900, (7, 7): 110}.get((u, v), 0)) for u in range(8) for v in range(8)]
    got = {(r.bcol, r.u, r.v): r.level for r in rates.by_rate(spark.createDataFrame(rows, "brow long, bcol long, u long, v long, c long"), 8, 8, 28, 0.015625).collect()}
    assert len(got) == 128 and got[1, 0, 0] < 0 and got[1, 7, 7] == 0
    assert not any(v for (b, _, _), v in got.items() if b == 0)


@pytest.mark.parametrize("n", [4, 8])
def test_taps_predict_as_the_formulas_do(spark, n):
    rng = random.Random(n)
    corner = [rng.randrange(256) for _ in range(6)]
    data = [(k, [c, *(rng.choice((0, 255, rng.randrange(256))) for _ in range(16))], [c, *(rng.randrange(256) for _ in range(16))]) for k, c in enumerate(corner)]
    refs = spark.createDataFrame(data, "id long, top array<long>, left array<long>")
    line = refs.select("id", F.array_repeat(F.lit(0).cast("bigint"), n * n).alias("own"), prediction.reference_line(F.col("top"), F.col("left"), n).alias("line"))
    got = {r.id: r.r for r in line.select("id", prediction.residuals("own", "line", range(67), prediction.luma_taps, n).alias("r")).collect()}
    rows = prediction.luma(refs, n).collect()
    assert len(rows) == 6 * 67 * n * n and all(r.p == -got[r.id][r.mode][r.y * n + r.x] for r in rows)
    plain = {r.id: r.r for r in line.select("id", prediction.residuals("own", "line", range(2, 67), prediction.angular_taps, n).alias("r")).collect()}
    count = lambda c, k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k).cast("bigint"))).alias(c)
    spots = refs.select("*", count("mode", 64)).withColumn("mode", F.col("mode") + 2).select("*", count("y", n - 1)).select("*", count("x", n - 1))
    angles = spots.select("id", "mode", "y", "x", prediction.angular(F.col("top"), F.col("left"), F.col("x"), F.col("y"), F.col("mode"), n).alias("p"))
    assert all(r.p == -plain[r.id][r.mode - 2][r.y * n + r.x] for r in angles.collect())


def test_best_modes_stay_in_their_row(spark, tmp_path):
    spark.createDataFrame([(7, [k / 64 for k in range(64)], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("mode_top4_open", "mode_search"):
        found = catalogue.QUERIES[name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and plan.count("Exchange") == 1 and plan.count("sort_array") == 1
        assert [(r.id, r["rank"]) for r in found.orderBy("rank").collect()] == [(7, k) for k in range(1, 5)]
