"""Rules of the coding tree: forced and allowed splits, children and their state, contexts of the split flags.

A node is a dict of columns: x, y, w, h, qt_depth, mt_depth, bt_depth, implicit, last (the split it came from) and part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ("none", "quad", "bin_h", "bin_v", "tri_h", "tri_v")
# Least side after quarters, depth of halves and thirds, largest side of halves, of thirds, and of a transform; least side.
MIN_QT, MAX_DEPTH, MAX_BT, MAX_TT, MAX_TB, MIN_SIDE = 16, 2, 32, 32, 64, 4


class Limits(NamedTuple):
    """What one tree of a picture allows."""

    min_qt: int = MIN_QT
    depth: int = MAX_DEPTH
    max_bt: int = MAX_BT
    max_tt: int = MAX_TT


LUMA = Limits()
#: The chroma tree beside a luma tree of its own: whole blocks of 64, split at the picture's edges only.
CHROMA = Limits(64, 0, 64, 64)


def forced_split(n: dict[str, Column], width: int, height: int | Column, limits: Limits = LUMA) -> Column:
    """The split that a block across the picture's lower or right edge must take; none inside."""
    low = n["y"] + n["h"] > height
    right = n["x"] + n["w"] > width
    low, right = low | (n["x"] >= width), right | (n["y"] >= height)
    halves = (F.greatest(n["w"], n["h"]) <= limits.max_bt) & (n["mt_depth"] < n["implicit"] + limits.depth)
    quarters = (F.least(n["w"], n["h"]) > limits.min_qt) & (n["bt_depth"] == 0)
    return (
        F.when(~low & ~right, "none")
        .when(low & right & quarters, "quad")
        .when(low & halves & (n["w"] <= MAX_TB), "bin_h")
        .when(right & halves & (n["h"] <= MAX_TB), "bin_v")
        .otherwise("quad")
    )


def allowed_splits(n: dict[str, Column], forced: Column, limits: Limits = LUMA) -> dict[str, Column]:
    """Whether each of SPLITS may be taken."""
    w, h, last = n["w"], n["h"], n["last"]
    longest, inside = F.greatest(w, h), forced == "none"
    quad = last.isin("none", "quad") & (w > limits.min_qt)
    deeper = (n["mt_depth"] < n["implicit"] + limits.depth) & (longest > MIN_SIDE) & (longest <= max(limits.max_bt, limits.max_tt))
    halves, thirds = inside & deeper & (longest <= limits.max_bt), inside & deeper & (longest <= min(limits.max_tt, MAX_TB))
    middle = n["part"] == 1  # of thirds: not halved the same way again
    return {
        "none": inside,
        "quad": quad | (~inside & ~forced.isin("bin_h", "bin_v")),
        "bin_h": (forced == "bin_h") | (halves & (h > MIN_SIDE) & ~((last == "tri_h") & middle)),
        "bin_v": (forced == "bin_v") | (halves & (w > MIN_SIDE) & ~((last == "tri_v") & middle)),
        "tri_h": thirds & (h > 2 * MIN_SIDE),
        "tri_v": thirds & (w > 2 * MIN_SIDE),
    }


def children(n: dict[str, Column], split: Column, implied: Column) -> Column:
    """An array of the parts of a node, with their place, state and number; a node that is not split is its own only part.

    Halves and thirds deepen the tree by one and its halves by one or two; a forced half is also counted in ``implicit``.
    """
    x, y, w, h = (n[c] for c in "xywh")
    half, third = split.isin("bin_h", "bin_v"), split.isin("tri_h", "tri_v")
    quad, down = split == "quad", split.isin("bin_h", "tri_h")

    def part(k: int, left: Column, top: Column, wide: Column, high: Column) -> Column:
        state = {
            "qt_depth": n["qt_depth"] + F.when(quad, 1).otherwise(0),
            "mt_depth": F.when(quad, 0).otherwise(n["mt_depth"] + F.when(half | third, 1).otherwise(0)),
            "bt_depth": F.when(quad, 0).otherwise(n["bt_depth"] + F.when(half, 1).when(third, 2).otherwise(0)),
            "implicit": n["implicit"] + F.when(half & implied, 1).otherwise(0),
        }
        place = {"x": x + left, "y": y + top, "w": wide, "h": high} | state
        return F.struct(F.lit(k).cast("bigint").alias("part"), *[c.cast("bigint").alias(name) for name, c in place.items()], split.alias("last"))

    zero = F.lit(0)
    cut = lambda v, n: F.floor(v / n).cast("bigint")
    quarters = F.array(*[part(2 * j + i, cut(w, 2) * i, cut(h, 2) * j, cut(w, 2), cut(h, 2)) for j in (0, 1) for i in (0, 1)])
    halves = F.array(*[part(k, F.when(down, 0).otherwise(cut(w, 2) * k), F.when(down, cut(h, 2) * k).otherwise(0), F.when(down, w).otherwise(cut(w, 2)), F.when(down, cut(h, 2)).otherwise(h)) for k in (0, 1)])
    edge = ((0, 1), (1, 2), (3, 1))  # where a third begins and how long it is, in quarters
    thirds = F.array(*[part(k, F.when(down, 0).otherwise(cut(w, 4) * a), F.when(down, cut(h, 4) * a).otherwise(0), F.when(down, w).otherwise(cut(w, 4) * b), F.when(down, cut(h, 4) * b).otherwise(h)) for k, (a, b) in enumerate(edge)])
    return F.when(quad, quarters).when(half, halves).when(third, thirds).otherwise(F.array(part(0, zero, zero, w, h)))


def split_contexts(n: dict[str, Column], may: dict[str, Column], left_h: Column, left_depth: Column, above_w: Column, above_depth: Column) -> dict[str, Column]:
    """The contexts of the flags of a split, from the blocks left and above (null where there is none)."""
    one = lambda c: F.when(c, 1).otherwise(0)
    choices = 2 * one(may["quad"]) + sum(one(may[s]) for s in SPLITS[2:])
    across, down = one(may["bin_v"]) + one(may["tri_v"]), one(may["bin_h"]) + one(may["tri_h"])
    wider, taller = F.floor(n["w"] / above_w), F.floor(n["h"] / left_h)
    even = F.when(left_h.isNull() | above_w.isNull() | (wider == taller), 0).when(wider < taller, 1).otherwise(2)
    shallow = n["mt_depth"] <= 1
    return {
        "ctx_split": one(left_h < n["h"]) + one(above_w < n["w"]) + 3 * F.floor(F.greatest(choices - 1, F.lit(0)) / 2).cast("int"),
        "ctx_quad": one(left_depth > n["qt_depth"]) + one(above_depth > n["qt_depth"]) + 3 * one(n["qt_depth"] >= 2),
        "ctx_vertical": F.when(across == down, even).when(across < down, 3).otherwise(4),
        "ctx_half_h": one(shallow),
        "ctx_half_v": 2 + one(shallow),
    }


def header_fields(limits: Limits) -> dict[str, Column]:
    """What a header says of these limits, columns or numbers, each as a difference of logarithms."""
    log = lambda v: F.length(F.bin(v if isinstance(v, Column) else F.lit(v))) - 1
    return {"min_qt": log(limits.min_qt) - log(MIN_SIDE), "depth": limits.depth if isinstance(limits.depth, Column) else F.lit(limits.depth), "max_bt": log(limits.max_bt) - log(limits.min_qt), "max_tt": log(limits.max_tt) - log(limits.min_qt)}
