"""Quantization by rate and distortion: each level against the one below and zero, then the best last position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import scan
from .transforms import dequantize, literal, quantize


def cost_of_bits(qp: int) -> float:
    """How much squared error a bit is worth at a quantizer."""
    return 0.57 * 2.0 ** ((qp - 12) / 3)


def level_bits(level: Column) -> Column:
    """About how many bits a level of 0 or more takes: flags for 0, 1 and 3, then a remainder."""
    rest = 2 * F.floor(F.log2(F.greatest(level - 3, F.lit(1)).cast("double"))) + 6
    return F.when(level <= 0, 0).when(level == 1, 3).when(level <= 3, 5).otherwise(rest).cast("double")


def place_bits(c: Column) -> Column:
    """About how many bits one coordinate of the last position takes: its group, and a suffix in larger groups."""
    top = F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")))
    group = F.when(c < 4, c).otherwise(2 * top + F.floor(c / F.pow(F.lit(2.0), top - 1)) % 2)
    return (group + F.when(group > 3, F.floor((group - 2) / 2)).otherwise(0)).cast("double")


def by_rate(coefficients: DataFrame, w: int, h: int, qp: int, scale: float) -> DataFrame:
    """(brow, bcol, u, v, level) of (brow, bcol, u, v, c): the levels of least error plus bits.

    ``scale``: what a squared error of a coefficient costs in squared samples. A level gives way to the one below
    or to zero where that costs less; then everything after the last position that costs least is zero, all of
    the block if that is cheapest. Sums run over the positions of a block, so one window holds w * h rows.
    """
    bit, c = cost_of_bits(qp), F.col("c")
    size = F.abs(c).cast("double")
    error = lambda level: F.pow(size - dequantize(level, w, h, qp), 2) * scale
    plain, below = F.col("_plain"), F.col("_plain") - 1
    tried = coefficients.withColumn("_plain", quantize(F.abs(c), w, h, qp)).withColumns({"_zero": size * size * scale, "_one": error(below), "_two": error(plain)})
    one, two = F.col("_one") + bit * level_bits(below), F.col("_two") + bit * level_bits(plain)
    cheaper = F.when(below > 0, F.least(F.col("_zero"), one)).otherwise(F.col("_zero"))
    kept = F.when((plain > 0) & (two < cheaper), plain).when((below > 0) & (one < F.col("_zero")), below).otherwise(0)
    place = {p: k for k, p in enumerate(scan(w, h))}
    pos = F.element_at(literal([place[(i % w, i // w)] for i in range(w * h)]), (F.col("v") * w + F.col("u") + 1).cast("int"))
    chosen = tried.withColumns({"_kept": kept, "_pos": pos})
    dist = F.when(F.col("_kept") == 0, F.col("_zero")).when(F.col("_kept") == plain, F.col("_two")).otherwise(F.col("_one"))
    block = Window.partitionBy("brow", "bcol")
    ahead, tail = block.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0), block.orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.sum(dist + bit * level_bits(F.col("_kept"))).over(ahead)
    rest = F.coalesce(F.sum("_zero").over(tail), F.lit(0.0))
    ended = chosen.withColumn("_cost", F.when(F.col("_kept") > 0, so_far + rest + bit * (place_bits(F.col("u")) + place_bits(F.col("v")))))
    best = F.min(F.when(F.col("_kept") > 0, F.struct(F.col("_cost").alias("cost"), F.col("_pos").alias("pos")))).over(block)
    none = F.sum("_zero").over(block)
    marked = ended.withColumns({"_best": best, "_none": none})
    inside = (F.col("_best.cost") < F.col("_none")) & (F.col("_pos") <= F.col("_best.pos"))
    return marked.select("brow", "bcol", "u", "v", F.when(inside, F.when(c < 0, -F.col("_kept")).otherwise(F.col("_kept"))).otherwise(0).cast("bigint").alias("level"))
