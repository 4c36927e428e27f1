"""Operators along a sequence of samples: differences, running sums, filling, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.planes import WIDTH


def differences(samples: DataFrame, key: str, order: str, value: str = "v") -> DataFrame:
    """``samples`` with ``d``: each value less the one before it in its sequence; the first is itself."""
    w = Window.partitionBy(key).orderBy(order)
    return samples.withColumn("d", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def running_sums(samples: DataFrame, key: str, order: str, value: str = "d") -> DataFrame:
    """``samples`` with ``r``: the sum of the differences so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("r", F.sum(value).over(w))


def substituted(samples: DataFrame, key: str, order: str, available: Column, middle: int, value: str = "v") -> DataFrame:
    """``samples`` with ``s``: missing values from the last one before, else the first one after, else the middle."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(available, F.col(value))
    return samples.withColumn("s", F.coalesce(F.last(seen, True).over(before), F.first(seen, True).over(after), F.lit(middle)))


def smoothed(samples: DataFrame, key: str, order: str, value: str = "v") -> DataFrame:
    """``samples`` with ``f``: (before + 2 * own + after + 2) / 4, the ends kept."""
    w = Window.partitionBy(key).orderBy(order)
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return samples.withColumn("f", F.when(before.isNull() | after.isNull(), own).otherwise(F.shiftright(before + 2 * own + after + 2, 2)))


def coding_order(brow: Column, bcol: Column, per_tree: int = 8, trees_across: int = 1) -> Column:
    """The place of a block in coding order: trees of per_tree x per_tree blocks row by row, each along its Z curve."""
    tree = F.floor(brow / per_tree) * trees_across + F.floor(bcol / per_tree)
    z = F.lit(0)
    for e in range(per_tree.bit_length() - 1):
        bit = lambda c, e=e: F.floor(c / (1 << e)) % 2
        z = z + bit(bcol) * (1 << (2 * e)) + bit(brow) * (1 << (2 * e + 1))
    return (tree * per_tree * per_tree + z).cast("bigint")


def gathered(rows: DataFrame, size: int) -> DataFrame:
    """(brow, bcol, side, k, v): the reference samples of every block of (y, row), null where none is there yet.

    ``top`` begins with the corner (k = 0) and runs 2 * size to the right, ``left`` from k = 1 as far down. A
    sample is there if it lies in the plane, in a block that comes earlier in coding order. Every plane row
    is fetched once for each block row above and beside it, not once a sample.
    """
    across = WIDTH // size
    edge = rows.where((F.col("y") + 1) % size == 0).select((F.expr(f"(y + 1) div {size}")).alias("brow"), "y", "row")
    last = F.broadcast(rows.agg((F.floor((F.max("y") + 1) / size) * size).alias("height")))
    column = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    tops = edge.withColumn("bcol", column(across - 1)).withColumn("k", column(2 * size)).select("brow", "bcol", F.lit("top").alias("side"), "k", "y", (F.col("bcol") * size - 1 + F.col("k")).alias("x"), "row")
    # A row is beside the blocks of its own block row and below and beside those of the one before.
    sides = rows.withColumn("_up", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.expr(f"y div {size}") - F.col("_up")).alias("brow"), "y", "row").where("brow >= 0")
    lefts = sides.withColumn("bcol", column(across - 1)).select("brow", "bcol", F.lit("left").alias("side"), (F.col("y") - F.col("brow") * size + 1).cast("int").alias("k"), "y", (F.col("bcol") * size - 1).alias("x"), "row")
    found = tops.union(lefts).join(last).where(F.col("brow") * size < F.col("height"))
    earlier = coding_order(F.expr(f"y div {size}"), F.floor(F.col("x") / size)) < coding_order(F.col("brow"), F.col("bcol"))
    there = F.col("x").between(0, WIDTH - 1) & earlier
    have = found.select("brow", "bcol", "side", "k", F.when(there, F.element_at("row", (F.greatest(F.col("x"), F.lit(0)) % WIDTH + 1).cast("int"))).alias("v"))
    # Places above the first or below the last row have no row to come from.
    grid = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"height div {size} - 1"))).alias("brow"), "height")
    top_gap = grid.where("brow = 0").select("brow", column(across - 1).alias("bcol"), F.lit("top").alias("side")).withColumn("k", column(2 * size))
    return have.union(top_gap.withColumn("v", F.lit(None).cast("bigint"))).union(_below(rows, grid, size, across))


def _below(rows: DataFrame, grid: DataFrame, size: int, across: int) -> DataFrame:
    """The places of the left reference of the last block rows that lie under the plane."""
    end = F.broadcast(rows.agg((F.max("y") + 1).alias("rows")))
    at = grid.where(f"(brow + 2) * {size} > height").join(end).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2 * size)))).where(f"brow * {size} + k - 1 >= rows")
    return at.withColumn("bcol", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select("brow", "bcol", F.lit("left").alias("side"), "k", F.lit(None).cast("bigint").alias("v"))


def predicted_qp(groups: DataFrame, across: int, per_tree: int, base: int) -> DataFrame:
    """(grow, gcol, predicted): the quantizer expected of each group (grow, gcol, qp), all groups being coded.

    Within a tree from the groups above and to the left, else from the one coded before; a group that is not
    there counts as ``base``. Neighbours come by their place, so no sequence is walked.
    """
    order = coding_order(F.col("grow"), F.col("gcol"), per_tree, across // per_tree)
    at = groups.withColumn("_seq", order)
    side = lambda name, row, col: at.select((F.col("grow") + row).alias("grow"), (F.col("gcol") + col).alias("gcol"), F.col("qp").alias(name))
    before = at.select((F.col("_seq") + 1).alias("_seq"), F.col("qp").alias("_before"))
    all_ = at.join(before, "_seq", "left").join(side("_above", 1, 0), ["grow", "gcol"], "left").join(side("_left", 0, 1), ["grow", "gcol"], "left")
    or_base = lambda c: F.coalesce(F.col(c), F.lit(base))
    up, beside = (F.when(F.col(g) % per_tree != 0, or_base(c)).otherwise(or_base("_before")) for g, c in (("grow", "_above"), ("gcol", "_left")))
    first = (F.col("gcol") == 0) & (F.col("grow") % per_tree == 0) & (F.col("grow") > 0)
    return all_.select("grow", "gcol", F.when(first, or_base("_above")).otherwise(F.shiftright(up + beside + 1, 1)).cast("bigint").alias("predicted"))
