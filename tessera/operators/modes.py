"""Rules on intra modes: 0 planar, 1 DC, 2 to 66 angles (18 horizontal, 50 vertical)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLANAR, DC, HORIZONTAL, DIAGONAL, VERTICAL, LAST = 0, 1, 18, 34, 50, 66
# Fixed value: how many angles a block of that ratio (log2) exchanges.
EXCHANGED = (0, 6, 10, 12, 14, 15)


def turned(m: Column) -> Column:
    """An angle in the circle of 64, from 2 on."""
    return m % 64 + 2


def likely_modes(left: Column, above: Column) -> Column:
    """The six modes to try first, from the modes to the left and above (null: planar)."""
    a, b = F.coalesce(left, F.lit(PLANAR)), F.coalesce(above, F.lit(PLANAR))
    low, high, gap = F.least(a, b), F.greatest(a, b), F.abs(a - b)
    under = lambda m: turned(m + 61)
    over = lambda m: turned(m - 1)
    under2, over2 = lambda m: turned(m + 60), lambda m: turned(m)
    entry = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v])
    one = entry(PLANAR, high, under(high), over(high), under2(high), over2(high))
    pair = lambda *v: entry(PLANAR, a, b, *v)
    two = (
        F.when(gap == 1, pair(under(low), over(high), under2(low)))
        .when(gap >= 62, pair(over(low), under(high), over2(low)))
        .when(gap == 2, pair(over(low), under(low), over(high)))
        .otherwise(pair(under(low), over(low), under(high)))
    )
    plain = entry(PLANAR, DC, VERTICAL, HORIZONTAL, VERTICAL - 4, VERTICAL + 4)
    return F.when((a == b) & (a > DC), one).when((a != b) & (low > DC), two).when((a != b) & (high > DC), one).otherwise(plain)


def chroma_modes(luma: Column) -> Column:
    """The four fixed chroma modes; the one that equals the luma mode becomes the last angle."""
    fixed = F.array(*map(F.lit, (PLANAR, VERTICAL, HORIZONTAL, DC)))
    return F.transform(fixed, lambda m: F.when(m == luma, LAST).otherwise(m))


def wide_angle(w: Column, h: Column, mode: Column, back: int = LAST - 1) -> Column:
    """The angle that an oblong block uses for a mode; ``back`` is 67 where the secondary transform's set is chosen."""
    ratio = F.abs(F.log2(w.cast("double")).cast("int") - F.log2(h.cast("double")).cast("int"))
    swap = F.element_at(F.array(*map(F.lit, EXCHANGED)), ratio + 1)
    angular = (mode > DC) & (mode <= LAST)
    return F.when(angular & (w > h) & (mode < 2 + swap), mode + LAST - 1).when(angular & (h > w) & (mode > LAST - swap), mode - back).otherwise(mode)


def binary_log(v: Column) -> Column:
    """Position of the highest bit of a positive number."""
    return F.length(F.bin(v)) - 1
