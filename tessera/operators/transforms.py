"""Separable integer transforms and quantization of blocks.

The row pass works within a row's array and needs no shuffle. The column pass is one aggregation per block
column with a sum for each output, so partial sums are combined before the shuffle, and samples are never
multiplied by the matrix's height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.samples import clip
from ..functions.tables import MATRICES, dequant_terms, kept, quant_terms
from ..sources.planes import WIDTH


def literal(row: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in row])


def shifted(v: Column, shift: int) -> Column:
    """``v`` / 2**shift, rounded half up."""
    return F.shiftright(v + (1 << (shift - 1)), shift) if shift > 0 else v


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, v: s + v)


def column_pass(rows: DataFrame, keys: list[str], place: Column, value: Column, matrix: list[list[int]], name: str) -> DataFrame:
    """For each group an array of the sums over its rows of ``value`` times a matrix entry, by ``place`` in the column."""
    sums = [F.sum(value * F.element_at(literal(r), (place + 1).cast("int"))).alias(f"_s{k}") for k, r in enumerate(matrix)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"_s{k}") for k in range(len(matrix))]).alias(name))


def forward(rows: DataFrame, w: int, h: int, across: str = "dct2", down: str = "dct2", depth: int = 8) -> DataFrame:
    """(brow, bcol, u, v, c): the coefficients of every w x h block of (y, row), zeros of dropped high frequencies included.

    ``rows`` must be padded to a multiple of ``h``; sides are powers of two.
    """
    first, second = w.bit_length() - 1 + depth - 9, h.bit_length() - 1 + 6
    basis = F.array(*[literal(r) for r in MATRICES[across](w)[: kept(across, w)]])
    at = rows.select("y", "row", F.explode(F.sequence(F.lit(0), F.lit(WIDTH // w - 1))).alias("bcol"))
    part = F.slice("row", F.col("bcol") * w + 1, w)
    passed = at.withColumn("bcol", F.col("bcol").cast("bigint")).select(F.floor(F.col("y") / h).cast("bigint").alias("brow"), "bcol", (F.col("y") % h).alias("j"), F.posexplode(F.transform(basis, lambda r: shifted(dot(r, part), first))).alias("u", "t"))
    sums = column_pass(passed, ["brow", "bcol", "u"], F.col("j"), F.col("t"), MATRICES[down](h)[: kept(down, h)], "sums")
    found = sums.select("brow", "bcol", F.col("u").cast("bigint").alias("u"), F.posexplode(F.transform("sums", lambda s: shifted(s, second))).alias("v", "c")).withColumn("v", F.col("v").cast("bigint"))
    if kept(across, w) == w and kept(down, h) == h:
        return found
    # The dropped frequencies of a block: those of its kept corner's partners, all zero.
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda u: F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda v: F.struct(u.cast("bigint").alias("u"), v.cast("bigint").alias("v")))))
    dropped = found.where("u = 0 AND v = 0").select("brow", "bcol", F.explode(F.filter(grid, lambda p: (p["u"] >= kept(across, w)) | (p["v"] >= kept(down, h)))).alias("p")).select("brow", "bcol", "p.u", "p.v", F.lit(0).cast("bigint").alias("c"))
    return found.union(dropped)


def inverse(coefficients: DataFrame, w: int, h: int, across: str = "dct2", down: str = "dct2", depth: int = 8) -> DataFrame:
    """(brow, bcol, j, i, r): the residual of (brow, bcol, u, v, c); columns first, with clipping to 16 bits between the passes."""
    live = coefficients.where((F.col("u") < kept(across, w)) & (F.col("v") < kept(down, h)))
    columns = [list(c) for c in zip(*MATRICES[down](h)[: kept(down, h)], strict=True)]
    tall = column_pass(live, ["brow", "bcol", "u"], F.col("v"), F.col("c"), columns, "sums").select("brow", "bcol", "u", F.posexplode(F.transform("sums", lambda s: clip(shifted(s, 7), -32768, 32767))).alias("j", "t"))
    rows = [list(c) for c in zip(*MATRICES[across](w)[: kept(across, w)], strict=True)]
    wide = column_pass(tall, ["brow", "bcol", "j"], F.col("u"), F.col("t"), rows, "sums")
    return wide.select("brow", "bcol", F.col("j").cast("bigint").alias("j"), F.posexplode(F.transform("sums", lambda s: shifted(s, 20 - depth))).alias("i", "r")).withColumn("i", F.col("i").cast("bigint"))


def quantize(c: Column, w: int, h: int, qp: int, depth: int = 8) -> Column:
    scale, offset, shift = quant_terms(w, h, qp, depth)
    level = F.shiftright(F.abs(c) * scale + offset, shift)
    return clip(F.when(c < 0, -level).otherwise(level), -32768, 32767)


def dequantize(level: Column, w: int, h: int, qp: int, depth: int = 8) -> Column:
    factor, offset, shift = dequant_terms(w, h, qp, depth)
    return clip(F.shiftright(level * factor + offset, shift), -32768, 32767)


def quantize_skip(r: Column, qp: int) -> Column:
    """Quantization of a residual that is not transformed; the shift knows neither size nor depth."""
    shift = 14 + qp // 6
    level = F.shiftright(F.abs(r) * quant_terms(4, 4, qp)[0] + (171 << (shift - 9)), shift)
    return clip(F.when(r < 0, -level).otherwise(level), -32768, 32767)


def dequantize_skip(level: Column, qp: int) -> Column:
    scale, right = dequant_terms(4, 4, qp % 6)[0] // 16, 6 - qp // 6
    v = level * scale
    return clip(shifted(v, right) if right > 0 else v * (1 << -right), -32768, 32767)


def from_left(matrix: list[list[int]], x: Column) -> Column:
    """The product of a matrix and an array of rows."""
    line = lambda r: F.aggregate(F.zip_with(literal(r), x, lambda c, row: F.transform(row, lambda v: v * c)), F.array_repeat(F.lit(0).cast("bigint"), F.size(x[0])), lambda s, row: F.zip_with(s, row, lambda p, q: p + q))
    return F.array(*[line(r) for r in matrix])


def from_right(x: Column, matrix: list[list[int]]) -> Column:
    """Every row of ``x`` times every row of a matrix."""
    return F.transform(x, lambda row: F.array(*[dot(literal(r), row) for r in matrix]))


def each(x: Column, f) -> Column:
    return F.transform(x, lambda row: F.transform(row, f))


def round_trip(rows: DataFrame, size: int, qp: int) -> DataFrame:
    """(brow, bcol, ssd): the squared error of every block after transform, quantization and back.

    Each block's row parts meet in one shuffle; all passes are then sums within the block.
    """
    at = rows.select("y", "row", F.explode(F.sequence(F.lit(0), F.lit(WIDTH // size - 1))).alias("bcol"))
    part = F.struct((F.col("y") % size).alias("j"), F.slice("row", F.col("bcol") * size + 1, size).alias("part"))
    block = at.groupBy(F.floor(F.col("y") / size).cast("bigint").alias("brow"), F.col("bcol").cast("bigint").alias("bcol")).agg(F.sort_array(F.collect_list(part)).alias("_b"))
    block = block.select("brow", "bcol", F.transform("_b", lambda b: b["part"]).alias("x"))
    basis = MATRICES["dct2"](size)[: kept("dct2", size)]
    columns, log = [list(c) for c in zip(*basis, strict=True)], size.bit_length() - 1
    first = block.withColumn("t", each(from_right(F.col("x"), basis), lambda v: shifted(v, log - 1)))
    level = lambda v: dequantize(quantize(shifted(v, log + 6), size, size, qp), size, size, qp)
    coded = first.withColumn("t", each(from_left(basis, F.col("t")), level))
    tall = coded.withColumn("t", each(from_left(columns, F.col("t")), lambda v: clip(shifted(v, 7), -32768, 32767)))
    back = tall.withColumn("t", each(from_right(F.col("t"), columns), lambda v: shifted(v, 12)))
    error = F.zip_with(F.flatten("x"), F.flatten("t"), lambda p, q: (p - q) * (p - q))
    return back.select("brow", "bcol", F.aggregate(error, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("ssd"))


def error_scale(spark, w: int, h: int, amplitude: int = 1024) -> DataFrame:
    """(scale): what a squared error of one coefficient costs in squared samples, as the mean over six impulses."""
    spots = [(0, 0), (w // 2, h // 2), (w - 1, 0), (0, h - 1), (w - 1, h - 1), (max(w // 4, 1), max(h // 4, 1))]
    impulses = spark.createDataFrame([(k, 0, u, v, amplitude) for k, (u, v) in enumerate(spots)], "brow bigint, bcol bigint, u bigint, v bigint, c bigint")
    r = inverse(impulses, w, h)
    return r.agg((F.sum(F.col("r") * F.col("r")).cast("double") / (amplitude * amplitude * len(spots))).alias("scale"))
