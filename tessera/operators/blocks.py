"""Reductions and decisions over blocks of samples (y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import clip
from ..sources import planes
from ..sources.planes import WIDTH
from .transforms import from_left, from_right, literal


def whole(a: Column, b: Column) -> Column:
    """Integer quotient, towards zero."""
    return F.floor(F.abs(a) / F.abs(b)).cast("bigint") * (F.when((a < 0) != (b < 0), -1).otherwise(1))


def block_keys(samples: DataFrame, size: int) -> DataFrame:
    return samples.withColumns({"brow": F.floor(F.col("y") / size).cast("bigint"), "bcol": F.floor(F.col("x") / size).cast("bigint")})


def variance(samples: DataFrame, size: int) -> DataFrame:
    """(brow, bcol, var): mean of squares less square of mean, both truncated, of the samples a block has."""
    s = block_keys(samples, size).groupBy("brow", "bcol").agg(F.sum("v").alias("a"), F.sum(F.col("v") * F.col("v")).alias("b"), F.count("*").alias("n"))
    mean = F.expr("a div n")
    return s.select("brow", "bcol", (F.expr("b div n") - mean * mean).alias("var"))


def adaptive_qp(samples: DataFrame, base: int, size: int = 32, reach: int = 6, low: int = 7, high: int = 51) -> DataFrame:
    """(brow, bcol, qp): flatter groups than the picture's mean get a smaller quantizer, busier ones a larger."""
    v = variance(samples, size)
    energy = v.withColumn("e", F.log2(1.0 + F.greatest(F.lit(0), F.col("var")).cast("double")))
    mean = energy.agg(F.avg("e").alias("m"))
    step = F.round(F.col("e") - F.col("m")).cast("bigint")
    return energy.join(F.broadcast(mean)).select("brow", "bcol", clip(base + clip(step, -reach, reach), min(low, base), high).cast("bigint").alias("qp"))


def row_changes(rows: DataFrame, w: int, h: int) -> DataFrame:
    """(brow, bcol, part, dx, dy): of each row's part in a w x h block the samples and the sums of absolute differences along and to the row below.

    Whole rows meet the row below once; sums are taken in the arrays, so a row gives a row for each block.
    """
    below = F.lead("row").over(Window.partitionBy("brow").orderBy("y"))
    pairs = rows.withColumn("brow", F.expr(f"y div {h}")).withColumn("below", below)
    at = pairs.select("brow", "row", "below", F.explode(F.sequence(F.lit(0), F.lit(WIDTH // w - 1))).alias("bcol"))
    part = lambda c, n=w, shift=0: F.slice(c, F.col("bcol") * w + 1 + shift, n)
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    dy = F.coalesce(total(part("row"), part("below")), F.lit(0))
    return at.select("brow", F.col("bcol").cast("bigint").alias("bcol"), part("row").alias("part"), total(part("row", w - 1), part("row", w - 1, 1)).alias("dx"), dy.alias("dy"))


def gradients(rows: DataFrame, size: int) -> DataFrame:
    """(brow, bcol, gx, gy): absolute differences of neighbours along and across, within each block of (y, row)."""
    return row_changes(rows, size, size).groupBy("brow", "bcol").agg(F.sum("dx").alias("gx"), F.sum("dy").alias("gy"))


def hadamard(n: int) -> list[list[int]]:
    return [[1 - 2 * ((i & k).bit_count() % 2) for i in range(n)] for k in range(n)]


def satd(rows: DataFrame, size: int) -> DataFrame:
    """(brow, bcol, satd): absolute Hadamard coefficients of the residual (y, row), summed over each 4 x 4 or 8 x 8 block; one shuffle."""
    signs = hadamard(size)
    both = from_left(signs, from_right(F.col("block"), signs))
    return planes.blocks(rows, size).select("brow", "bcol", F.aggregate(F.flatten(both), F.lit(0).cast("bigint"), lambda a, v: a + F.abs(v)).alias("satd"))


def quadtree(rows: DataFrame, qp: int, top: int = 64, least: int = 8) -> DataFrame:
    """(x, y, size): leaves of a quadtree of (y, row) that splits blocks of more variance than 64 + qp**2, down to ``least``.

    Each row gives a sum for every ``least`` samples, and these are dealt once, by the blocks of size ``top``. From
    there on all levels follow within the partitions: a level's sums, and the leaves below it, come from its parts.
    """
    threshold, n = 64 + qp * qp, WIDTH // least
    at = rows.select("y", "row", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bcol"))
    total = lambda f: F.aggregate(F.slice("row", F.col("bcol") * least + 1, least), F.lit(0).cast("bigint"), f)
    cells = at.select(
        F.expr(f"y div {top}").alias("trow"), F.expr(f"bcol * {least} div {top}").alias("tcol"), F.expr(f"y div {least}").alias("brow"), F.col("bcol").cast("bigint").alias("bcol"),
        total(lambda s, v: s + v).alias("a"), total(lambda s, v: s + v * v).alias("b"), F.lit(least).alias("n"),
    )
    sums = lambda *more: (F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"), *more)
    itself = lambda size: F.array(F.struct((F.col("bcol") * size).alias("x"), (F.col("brow") * size).alias("y"), F.lit(size).cast("bigint").alias("size")))
    blocks = cells.repartition("trow", "tcol").groupBy("trow", "tcol", "brow", "bcol").agg(*sums()).withColumn("leaves", itself(least))
    size, mean = least, F.expr("a div n")
    while size < top:
        size *= 2
        blocks = blocks.groupBy("trow", "tcol", F.expr("brow div 2").alias("brow"), F.expr("bcol div 2").alias("bcol")).agg(*sums(F.flatten(F.collect_list("leaves")).alias("below")))
        busy = F.expr("b div n") - mean * mean > threshold
        blocks = blocks.select("trow", "tcol", "brow", "bcol", "a", "b", "n", F.when(busy, F.col("below")).otherwise(itself(size)).alias("leaves"))
    return blocks.select(F.inline("leaves"))


def last_significant(levels: DataFrame, order: list[tuple[int, int]]) -> DataFrame:
    """(brow, bcol, last, cbf): the last scan position that is not 0 (-1: none) of levels (brow, bcol, u, v, c), and whether there is one."""
    place = {p: k for k, p in enumerate(order)}
    side = max(x for x, _ in order) + 1
    flat = [place.get((i % side, i // side), -1) for i in range(side * (max(y for _, y in order) + 1))]
    pos = F.element_at(literal(flat), (F.col("v") * side + F.col("u") + 1).cast("int"))
    last = F.max(F.when(F.col("c") != 0, pos).otherwise(-1))
    return levels.groupBy("brow", "bcol").agg(last.alias("last")).withColumn("cbf", F.col("last") >= 0)


def best_modes(blocks: DataFrame, keys: list[str], residuals: str, modes, size: int, keep: int) -> DataFrame:
    """(keys, mode, satd, rank): of each block the ``keep`` modes of least absolute Hadamard sum, ties to the smaller mode.

    ``residuals``: the column with an array of residuals by rows for each of ``modes``. A block is one row and stays it
    until the kept modes are dealt out, so nothing is shuffled or held for more than one block.
    """
    sums = "r"
    for bit in range((size * size).bit_length() - 1):  # the two-dimensional transform, bit by bit of the place; its order is of no matter
        both = ", ".join(f"h[{i}] + h[{i ^ 1 << bit}]" if not i >> bit & 1 else f"h[{i ^ 1 << bit}] - h[{i}]" for i in range(size * size))
        sums = f"transform(array({sums}), h -> array({both}))[0]"
    cost = f"aggregate({sums}, 0L, (s, v) -> s + abs(v))"
    each = F.expr(f"zip_with(array({', '.join(f'{m}L' for m in modes)}), {residuals}, (m, r) -> struct({cost} AS satd, m AS mode))")
    # Outer: for a plain one Spark may make the array again for a filter on its size.
    best = blocks.select(*keys, F.posexplode_outer(F.slice(F.sort_array(each), 1, keep)).alias("_k", "_b"))
    return best.select(*keys, "_b.mode", "_b.satd", (F.col("_k") + 1).cast("bigint").alias("rank"))


def oblong_split(rows: DataFrame, w: int, h: int, qp: int, least: int = 8) -> DataFrame:
    """(brow, bcol, split) of w x h blocks of (y, row), sides up to 64: none below a variance of 64 + qp**2, else the first that fits.

    Long blocks are split across their length; others across the direction of more change, from a ratio of 5 to 4 on,
    and evenly changing ones into quarters first. A split fits if no part's side falls below ``least``.
    """
    total = lambda f: F.sum(F.aggregate("part", F.lit(0).cast("bigint"), f))
    sums = row_changes(rows, w, h).groupBy("brow", "bcol").agg(total(lambda s, v: s + v).alias("a"), total(lambda s, v: s + v * v).alias("b"), F.sum(F.size("part")).alias("n"), F.sum("dx").alias("gx"), F.sum("dy").alias("gy"))
    fits = {"quad": min(w, h) // 2, "bin_v": w // 2, "bin_h": h // 2, "tri_v": w // 4, "tri_h": h // 4}
    first = lambda *order: F.lit(next((k for k in order if fits[k] >= least), "none"))
    across, down = first("bin_v", "tri_v", "quad", "bin_h", "tri_h"), first("bin_h", "tri_h", "quad", "bin_v", "tri_v")
    if max(w, h) >= 2 * min(w, h):
        busy = across if w > h else down
    else:
        busy = F.when(F.col("gx") * 4 > F.col("gy") * 5, across).when(F.col("gy") * 4 > F.col("gx") * 5, down).otherwise(first("quad", "bin_v", "bin_h", "tri_v", "tri_h"))
    mean = F.expr("a div n")
    return sums.select("brow", "bcol", F.when(F.expr("b div n") - mean * mean < 64 + qp * qp, "none").otherwise(busy).alias("split"))


def cells(leaves: DataFrame, side: int = 4) -> DataFrame:
    """(cx, cy, x, y, size): each ``side`` x ``side`` cell of a leaf (x, y, size) with the leaf that covers it."""
    span = lambda c: F.explode(F.sequence(F.expr(f"{c} div {side}"), F.expr(f"({c} + size) div {side} - 1")))
    return leaves.withColumn("cx", span("x")).withColumn("cy", span("y")).select("cx", "cy", "x", "y", "size")


def cell_neighbours(leaves: DataFrame, side: int = 4) -> DataFrame:
    """(x, y, size, left_size, above_size): of each leaf the sizes of those left of its lower and above its right corner; null outside."""
    at = cells(leaves, side).select("cx", "cy", F.col("size").alias("found"))
    near = lambda x, y, name: (at.select(F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("found").alias(name)), [F.floor(F.expr(x) / side).cast("bigint") == F.col("_x"), F.floor(F.expr(y) / side).cast("bigint") == F.col("_y")])
    left, on_left = near("x - 1", "y + size - 1", "left_size")
    above, on_above = near("x + size - 1", "y - 1", "above_size")
    return leaves.join(left, on_left, "left").drop("_x", "_y").join(above, on_above, "left").drop("_x", "_y")
