"""A secondary transform of a block's low frequencies: gathered by a position table, weighted by a kernel that the mode selects.

The kernels are a parameter (set, row, column): trained ones are thousands of numbers without a rule. ``bases`` makes
orthonormal ones by rule: cosines and sines of the second and fourth kind, backwards for the second candidate.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import diagonal
from .transforms import dot, literal

Kernels = list[list[list[int]]]


def shape(w: int, h: int) -> tuple[int, int]:
    """The side of the low corner that is taken, and how many coefficients come out."""
    return (8 if min(w, h) >= 8 else 4), (8 if w == h and w in (4, 8) else 16)


def positions(side: int) -> list[tuple[int, int]]:
    """(x, y) of the coefficients that go in: the corner by rows, without its last quarter."""
    return [(x, y) for y in range(side) for x in range(side if y < 4 else 4)]


def places(side: int) -> list[tuple[int, int]]:
    """(x, y) where the first outputs go: along the diagonals of the first group of 4 x 4."""
    return diagonal(4, 4)


def bases(side: int, rows: int, candidate: int) -> Kernels:
    """Four sets of ``rows`` orthonormal rows times 128, one number a position."""
    n = len(positions(side))
    unit = 128 * math.sqrt(2 / n)
    kinds = [
        lambda k, i: math.cos(math.pi / n * (i + 0.5) * k) * (math.sqrt(0.5) if k == 0 else 1), lambda k, i: math.sin(math.pi / n * (i + 0.5) * (k + 1)) * (math.sqrt(0.5) if k == n - 1 else 1),
        lambda k, i: math.cos(math.pi / n * (i + 0.5) * (k + 0.5)), lambda k, i: math.sin(math.pi / n * (i + 0.5) * (k + 0.5)),
    ]
    return [[[round(unit * f(k, n - 1 - i if candidate == 2 else i)) for i in range(n)] for k in range(rows)] for f in kinds]


def lookup(angle: Column) -> Column:
    """The place of a mode, wide angles included, in the table of sets."""
    return F.when(angle < 0, angle + 81).when(angle >= 67, angle + 14).otherwise(angle)


def set_of(place: Column) -> Column:
    """The set of kernels: planar and mean 0, near the diagonals 1, then 2, around the middle 3."""
    return F.when(place <= 1, 0).when(place.between(24, 44), 3).when(place.between(13, 55), 2).otherwise(1)


def turned(place: Column) -> Column:
    """Whether the corner is read by columns: for angles beyond the diagonal."""
    return (place >= 81) | ((place > 34) & (place < 67))


def _kernel(kernels: Kernels, place: Column, across: bool) -> Column:
    sets = [list(zip(*k, strict=True)) if across else k for k in kernels]
    # One literal that is parsed once: thousands of them would take Spark longer to plan than the sums to make.
    return F.element_at(F.from_json(F.lit(json.dumps(sets)), "array<array<array<bigint>>>"), set_of(place) + 1)


def _gathered(block: Column, w: int, at: list[tuple[int, int]]) -> Column:
    return F.transform(literal([y * w + x for x, y in at]), lambda p: F.element_at(block, (p + 1).cast("int")))


def _once(c: Column, f) -> Column:
    """``f`` of a column that is evaluated once: within a lambda an expression is evaluated at each call."""
    return F.transform(F.array(c), f)[0]


def _scattered(out: Column, w: int, h: int, at: list[tuple[int, int]]) -> Column:
    """A block with ``out`` at the places of ``at``, zero elsewhere."""
    where = {(x, y): k for k, (x, y) in enumerate(at)}
    return F.transform(literal([where.get((i % w, i // w), -1) for i in range(w * h)]), lambda k: F.when(k >= 0, F.element_at(out, (k + 1).cast("int"))).otherwise(0).cast("bigint"))


def forward(block: Column, place: Column, w: int, h: int, kernels: Kernels) -> Column:
    """A block's coefficients by rows, after the secondary transform; ``place`` is that of ``lookup``."""
    side, rows = shape(w, h)
    at = positions(side)
    taken = F.when(turned(place), _gathered(block, w, [(y, x) for x, y in at])).otherwise(_gathered(block, w, at))
    out = _once(taken, lambda v: F.transform(_kernel([k[:rows] for k in kernels], place, False), lambda r: F.shiftright(dot(r, v) + 64, 7)))
    return _once(out, lambda o: _scattered(o, w, h, places(side)[:rows]))


def inverse(block: Column, place: Column, w: int, h: int, kernels: Kernels, digits: int = 15) -> Column:
    """The coefficients that ``forward`` came from, as far as its outputs tell, within ``digits`` digits and a sign."""
    side, rows = shape(w, h)
    at = positions(side)
    most = 1 << digits
    taken = _gathered(block, w, places(side)[:rows])
    out = _once(taken, lambda v: F.transform(_kernel([k[:rows] for k in kernels], place, True), lambda r: F.least(F.lit(most - 1), F.greatest(F.lit(-most), F.shiftright(dot(r, v) + 64, 7)))))
    return _once(out, lambda o: F.when(turned(place), _scattered(o, w, h, [(y, x) for x, y in at])).otherwise(_scattered(o, w, h, at)))


def by_rows(coefficients: DataFrame, w: int) -> DataFrame:
    """(brow, bcol, block): the coefficients (brow, bcol, u, v, c) of each block by rows; one shuffle."""
    found = coefficients.groupBy("brow", "bcol").agg(F.sort_array(F.collect_list(F.struct((F.col("v") * w + F.col("u")).alias("at"), "c"))).alias("s"))
    return found.select("brow", "bcol", F.transform("s", lambda x: x["c"]).alias("block"))
