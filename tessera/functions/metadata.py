"""Colour codes, orientation and their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Assigned codes of the colour description; any other counts as 2, unspecified.
PRIMARIES = (1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 22)
TRANSFERS = (1, *range(4, 19))
MATRICES = (0, 1, *range(4, 18))
# Quarter turns to the left and mirror axis (0: left-right, 1: top-bottom) of the orientations 1 to 8.
TURNS = (0, 0, 2, 0, 3, 3, 1, 1)
MIRRORS = (None, 0, None, 1, 0, None, 0, None)


def known(code: Column, codes: tuple[int, ...]) -> Column:
    return F.when(code.isin(*codes), code).otherwise(2)


def orientation(exif: Column) -> Column:
    return F.when(exif.between(1, 8), exif).otherwise(1)


def turns(o: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TURNS)), o.cast("int"))


def mirror(o: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MIRRORS)), o.cast("int"))


def from_parts(turn: Column, axis: Column) -> Column:
    """The orientation of a turn and a mirror axis (null: none); 1 for what no orientation has."""
    out = F.lit(1)
    for k in range(8, 0, -1):
        out = F.when((turn % 4 == TURNS[k - 1]) & axis.eqNullSafe(F.lit(MIRRORS[k - 1]).cast("int")), k).otherwise(out)
    return out


def hex_of(v: Column, digits: int) -> Column:
    return F.lpad(F.hex(v), digits, "0")


def nclx(primaries: Column, transfer: Column, matrix: Column, full: Column) -> Column:
    """Upper-case hex of the colour box's payload."""
    return F.concat(F.lit("6E636C78"), *[hex_of(c, 4) for c in (primaries, transfer, matrix)], F.when(full, "80").otherwise("00"))


def parse_nclx(payload: Column) -> Column:
    """Struct of the payload's codes, unknown ones unspecified; null if it is short or of another kind."""
    number = lambda at, n: F.conv(F.substring(payload, at, n), 16, 10).cast("int")
    found = F.struct(known(number(9, 4), PRIMARIES).alias("primaries"), known(number(13, 4), TRANSFERS).alias("transfer"), known(number(17, 4), MATRICES).alias("matrix"), (number(21, 2) >= 128).alias("full"))
    return F.when((F.length(payload) >= 22) & payload.startswith("6E636C78"), found)


# Fixed value: the colour description of a picture that brings none.
DEFAULT = {"primaries": 1, "transfer": 13, "matrix": 6}


def effective(given: Column) -> Column:
    """Struct of the codes that are written: the given ones (a struct or null), else the default."""
    return F.struct(*[F.coalesce(given[k], F.lit(v)).alias(k) for k, v in DEFAULT.items()])


def light_level(most: Column, mean: Column) -> Column:
    """Upper-case hex of the light level box's payload: largest level, then largest picture mean."""
    return F.concat(hex_of(most, 4), hex_of(mean, 4))


def parse_light_level(payload: Column) -> Column:
    number = lambda at: F.conv(F.substring(payload, at, 4), 16, 10).cast("bigint")
    return F.when(F.length(payload) >= 8, F.struct(number(1).alias("most"), number(5).alias("mean")))
