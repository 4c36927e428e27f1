"""Prediction of blocks from reference arrays: ``top`` and ``left``, each from the corner on (index 0)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import RECIPROCAL
from .modes import HORIZONTAL, VERTICAL, binary_log

# Fixed value: slopes of the angles in 32nds of a sample, by distance from straight up or straight left.
SLOPES = (0, 1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 18, 20, 23, 26, 29, 32, 35, 39, 45, 51, 57, 64, 73, 86, 102, 128, 171, 256, 341, 512, 1024)


def ref(a: Column, i) -> Column:
    return F.element_at(a, (i if isinstance(i, Column) else F.lit(i)).cast("int") + 1)


def planar(top: Column, left: Column, x: Column, y: Column, size: int) -> Column:
    """Mean of the two linear blends towards the top right and the bottom left."""
    log = size.bit_length() - 1
    across = (size - 1 - x) * ref(left, y + 1) + (x + 1) * ref(top, size + 1 - 1)
    down = (size - 1 - y) * ref(top, x + 1) + (y + 1) * ref(left, size)
    return F.shiftright((across + down) * size + size * size, 1 + 2 * log)


def mean(top: Column, left: Column, w: int, h: int) -> Column:
    """Rounded mean of the references; only of the longer side of an oblong block."""
    total = lambda a, n: F.aggregate(F.slice(a, 2, n), F.lit(0).cast("bigint"), lambda s, v: s + v)
    s = (total(top, w) if w >= h else F.lit(0)) + (total(left, h) if w <= h else F.lit(0))
    n = 2 * w if w == h else max(w, h)
    return F.shiftright(s + n // 2, n.bit_length() - 1)


def position_blend(pred: Column, top: Column, left: Column, x: Column, y: Column, w: int, h: int) -> Column:
    """A planar or mean prediction drawn towards its references, the more the nearer they are."""
    scale = (w.bit_length() + h.bit_length() - 4) >> 2
    weight = lambda p: F.floor(F.lit(32) / F.pow(F.lit(2.0), F.least(F.lit(31), F.shiftright(2 * p, scale)))).cast("bigint")
    return pred + F.shiftright(weight(x) * (ref(left, y + 1) - pred) + weight(y) * (ref(top, x + 1) - pred) + 32, 6)


def line_fit(luma: Column, chroma: Column) -> dict[str, Column]:
    """(a, b, shift) of chroma = (a * luma >> shift) + b through the means of the two lower and two higher of four points.

    The pairs are found by the four comparisons of a fixed network, so ties fall as that network has them.
    """
    l = lambda k: F.element_at(luma, k + 1)  # noqa: E731, E741
    point = lambda k: F.struct(l(k).alias("l"), F.element_at(chroma, k + 1).alias("c"))
    low, high = F.when(l(0) > l(2), F.array(point(2), point(0))).otherwise(F.array(point(0), point(2))), F.when(l(1) > l(3), F.array(point(3), point(1))).otherwise(F.array(point(1), point(3)))
    crossed = low[0]["l"] > high[1]["l"]
    low, high = F.when(crossed, high).otherwise(low), F.when(crossed, low).otherwise(high)
    mixed = low[1]["l"] > high[0]["l"]
    low, high = F.when(mixed, F.array(low[0], high[0])).otherwise(low), F.when(mixed, F.array(low[1], high[1])).otherwise(high)
    middle = lambda pair, f: F.shiftright(pair[0][f] + pair[1][f] + 1, 1)
    return {"min_l": middle(low, "l"), "min_c": middle(low, "c"), "max_l": middle(high, "l"), "max_c": middle(high, "c")}


def line_terms(min_l: Column, min_c: Column, max_l: Column, max_c: Column) -> Column:
    """The fit's struct (a, b, shift) from its two mean points, by a table of reciprocals."""
    diff, rise = max_l - min_l, max_c - min_c
    safe = F.greatest(diff, F.lit(1))
    x0 = binary_log(safe)
    part = F.floor(safe * 16 / F.pow(F.lit(2.0), x0)).cast("bigint") % 16
    v = F.element_at(F.array(*map(F.lit, RECIPROCAL)), (part + 1).cast("int")).bitwiseOR(F.lit(8))
    x = x0 + F.when(part != 0, 1).otherwise(0)
    y = binary_log(F.greatest(F.abs(rise), F.lit(1))) + 1
    power = F.pow(F.lit(2.0), y).cast("bigint")
    a0 = F.floor((rise * v + F.floor(power / 2)) / power).cast("bigint")
    steep = 3 + x - y < 1
    a = F.when(steep, F.signum(a0.cast("double")).cast("bigint") * 15).otherwise(a0)
    shift = F.when(steep, 1).otherwise(3 + x - y)
    b = min_c - F.floor(a * min_l / F.pow(F.lit(2.0), shift)).cast("bigint")
    flat = diff <= 0
    pick = lambda c, other: F.when(flat, other).otherwise(c).cast("bigint")
    return F.struct(pick(a, F.lit(0)).alias("a"), pick(b, min_c).alias("b"), pick(shift, F.lit(0)).alias("shift"))


def angular(top: Column, left: Column, x: Column, y: Column, mode: Column, size: int) -> Column:
    """Prediction of a square block along an angle (modes 2 to 66), linear between two references, as for chroma.

    Modes from the diagonal on run from the top, others from the left with the sides exchanged. A slope away
    from the main side continues it with references of the other, projected by the inverse slope.
    """
    upright = mode >= 34
    main, side = F.when(upright, top).otherwise(left), F.when(upright, left).otherwise(top)
    along, across = F.when(upright, x).otherwise(y), F.when(upright, y).otherwise(x)
    turn = F.when(upright, mode - VERTICAL).otherwise(HORIZONTAL - mode)
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.abs(turn) + 1).cast("int"))
    back = F.element_at(F.array(*[F.lit(round(16384 / a) if a else 0) for a in SLOPES]), (F.abs(turn) + 1).cast("int"))
    moved = F.when(turn < 0, -slope).otherwise(slope) * (across + 1)
    whole, part = F.shiftright(moved, 5), moved - F.shiftright(moved, 5) * 32

    def at(i: Column) -> Column:
        return F.when(i >= 0, ref(main, F.greatest(F.lit(0), F.least(i, F.lit(2 * size))))).otherwise(ref(side, F.greatest(F.lit(0), F.least(F.lit(size), F.shiftright(-i * back + 256, 9)))))

    one, two = at(whole + along + 1), at(whole + along + 2)
    return one + F.shiftright(part * (two - one) + 16, 5)


def from_luma(luma: Column, a: Column, b: Column, shift: Column, most: int = 255) -> Column:
    """Chroma predicted from luma by a fitted line, clipped to 0 .. ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor(a * luma / F.pow(F.lit(2.0), shift)).cast("bigint") + b))


# Taps in 64ths of the cubic interpolation by 32nds of a sample, and the distance from straight modes beyond which references are smoothed.
CUBIC = (
    (0, 64, 0, 0), (-1, 63, 2, 0), (-2, 62, 4, 0), (-2, 60, 7, -1), (-2, 58, 10, -2), (-3, 57, 12, -2), (-4, 56, 14, -2), (-4, 55, 15, -2),
    (-4, 54, 16, -2), (-5, 53, 18, -2), (-6, 52, 20, -2), (-6, 49, 24, -3), (-6, 46, 28, -4), (-5, 44, 29, -4), (-4, 42, 30, -4), (-4, 39, 33, -4),
    (-4, 36, 36, -4), (-4, 33, 39, -4), (-4, 30, 42, -4), (-4, 29, 44, -5), (-4, 28, 46, -6), (-3, 24, 49, -6), (-2, 20, 52, -6), (-2, 18, 53, -5),
    (-2, 16, 54, -4), (-2, 15, 55, -4), (-2, 14, 56, -4), (-2, 12, 57, -3), (-2, 10, 58, -2), (-1, 7, 60, -2), (0, 4, 62, -2), (0, 2, 63, -1),
)
SMOOTHED_FROM = (24, 24, 24, 14, 2, 0, 0, 0)


def pick(table, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in table]), (at + 1).cast("int"))


def slope_of(mode: Column) -> dict[str, Column]:
    """Of an angle: whether it runs from the top, its turn from straight, its slope without sign, and the inverse slope."""
    upright = mode >= 34
    turn = F.when(upright, mode - VERTICAL).otherwise(HORIZONTAL - mode)
    back = pick([round(16384 / a) if a else 0 for a in SLOPES], F.abs(turn))
    return {"upright": upright, "turn": turn, "slope": pick(SLOPES, F.abs(turn)), "back": back}


def parameters(mode: Column, angle: Column, w: Column, h: Column) -> dict[str, Column]:
    """How luma is predicted: smoothed references, smooth interpolation, blending by position and its scale.

    ``angle`` is the wide angle of ``mode`` for the block's shape.
    """
    a, angular = slope_of(angle), mode > 1
    side = F.when(a["upright"], h).otherwise(w)
    scale = F.least(F.lit(2), binary_log(side) - binary_log(F.greatest(3 * a["back"] - 2, F.lit(1))) + 8)
    far = F.least(F.abs(angle - HORIZONTAL), F.abs(angle - VERTICAL)) > pick(SMOOTHED_FROM, F.floor((binary_log(w) + binary_log(h)) / 2))
    whole = a["slope"] % 32 == 0
    return {
        "smooth_refs": F.when(mode == 0, w * h > 32).when(mode == 1, False).otherwise(far & whole),
        "smooth_taps": angular & far & ~whole,
        "blended": (F.least(w, h) >= 4) & (~angular | (a["turn"] == 0) | ((a["turn"] > 0) & (scale >= 0))),
        "scale": F.when(angular & (a["turn"] > 0), scale).otherwise(0),
    }


def smoothed_references(top: Column, left: Column, n: int) -> tuple[Column, Column]:
    """(1 2 1) / 4 along the references of 2 * n samples a side; the ends stay, the corner is shared."""
    corner = F.shiftright(2 * ref(top, 0) + ref(top, 1) + ref(left, 1) + 2, 2)
    inner = lambda a: F.transform(F.sequence(F.lit(1), F.lit(2 * n - 1)), lambda k: F.shiftright(ref(a, k - 1) + 2 * ref(a, k) + ref(a, k + 1) + 2, 2))
    return tuple(F.concat(F.array(corner), inner(a), F.array(ref(a, 2 * n))) for a in (top, left))


def luma(blocks: DataFrame, size: int, most: int = 255) -> DataFrame:
    """(columns of ``blocks``, mode, y, x, p): the luma prediction of every mode from 0 to 66 for square blocks (top, left, ...).

    References are smoothed once a block, and turned to the mode's main side once a block and mode, before
    the positions are dealt out.
    """
    n, log, own = size, size.bit_length() - 1, blocks.columns
    top, left = smoothed_references(F.col("top"), F.col("left"), n)
    count = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    modes = blocks.select(*own, top.alias("_ft"), left.alias("_fl")).withColumn("mode", count(67))
    p = parameters(F.col("mode"), F.col("mode"), F.lit(n).cast("bigint"), F.lit(n).cast("bigint"))
    modes = modes.select("*", *[v.alias(f"_{k}") for k, v in (p | slope_of(F.col("mode"))).items()])
    used = lambda plain, smooth: F.when(F.col("_smooth_refs"), F.col(smooth)).otherwise(F.col(plain))
    modes = modes.withColumns({"_t": used("top", "_ft"), "_l": used("left", "_fl")})
    swap = lambda one, two: F.when(F.col("_upright"), F.col(one)).otherwise(F.col(two))
    signed = F.when(F.col("_turn") < 0, -F.col("_slope")).otherwise(F.col("_slope"))
    modes = modes.withColumns({"_main": swap("_t", "_l"), "_side": swap("_l", "_t"), "_step": signed})
    rows = modes.select(*own, "mode", "_main", "_side", "_upright", "_turn", "_step", "_slope", "_back", "_blended", "_scale", "_smooth_taps", count(n * n).alias("_at"))
    rows = rows.withColumns({"y": F.expr(f"_at div {n}"), "x": F.col("_at") % n}).withColumns({"_along": swap("x", "y"), "_across": swap("y", "x")})
    rows = rows.withColumn("_moved", F.col("_step") * (F.col("_across") + 1)).withColumns({"_whole": F.shiftright("_moved", 5), "_part": F.col("_moved") - F.shiftright("_moved", 5) * 32})
    main, side, along, across = (F.col(c) for c in ("_main", "_side", "_along", "_across"))

    def at(k: int) -> Column:
        i = F.col("_whole") + along + k
        beyond = ref(side, F.greatest(F.lit(0), F.least(F.lit(n), F.shiftright(-i * F.col("_back") + 256, 9))))
        return F.when(i >= 0, ref(main, F.greatest(F.lit(0), F.least(i, F.lit(2 * n))))).otherwise(beyond)

    half = F.expr("_part div 2")
    even, cubic = F.array(16 - half, 32 - half, 16 + half, half), F.array(*[F.array(*[F.lit(v).cast("bigint") for v in taps]) for taps in CUBIC])
    rows = rows.withColumn("_taps", F.when(F.col("_smooth_taps"), even).otherwise(F.element_at(cubic, (F.col("_part") + 1).cast("int"))))
    between = F.least(F.lit(most), F.greatest(F.lit(0), F.shiftright(sum(ref(F.col("_taps"), k) * at(k) for k in range(4)) + 32, 6)))
    rows = rows.withColumn("_v", F.when(F.col("_slope") % 32 == 0, at(1)).otherwise(between))
    near = lambda scale: F.expr(f"shiftright(32, cast(least(31, shiftright(2 * _along, {scale})) as int))")
    within = lambda scale: F.col("_blended") & (along < F.expr(f"shiftleft(3, {scale})"))
    straight, steep = str((2 * log - 2) >> 2), "cast(greatest(0, _scale) as int)"
    down = F.least(F.lit(2 * n), across + 1 + F.shiftright(256 + (along + 1) * F.col("_back"), 9))
    v = F.col("_v")
    on_axis = F.least(F.lit(most), F.greatest(F.lit(0), v + F.shiftright(near(straight) * (ref(side, across + 1) - ref(main, 0)) + 32, 6)))
    tilted = v + F.shiftright(near(steep) * (ref(side, down) - v) + 32, 6)
    turned_ = F.when((F.col("_turn") == 0) & within(straight), on_axis).when((F.col("_turn") > 0) & within(steep), tilted).otherwise(v)
    # Planar and mean count as running from the left, so their main side is the left one.
    flat = F.when(F.col("mode") == 0, planar(side, main, F.col("x"), F.col("y"), n)).otherwise(mean(side, main, n, n))
    rows = rows.withColumn("_flat", F.when(F.col("mode") <= 1, flat))
    blend = position_blend(F.col("_flat"), side, main, F.col("x"), F.col("y"), n, n)
    return rows.select(*own, "mode", "y", "x", F.when(F.col("mode") > 1, turned_).when(F.col("_blended"), blend).otherwise(F.col("_flat")).cast("bigint").alias("p"))


@dataclass(frozen=True)
class Taps:
    """How a sample is predicted from references: four of them in 64ths, then drawn by 64ths towards two more and away from the first value."""

    places: tuple[int, ...]
    weights: tuple[int, ...]
    towards: tuple[int, int] = (0, 0)
    by: tuple[int, int] = (0, 0)
    away: int = 0

    def fields(self) -> dict[str, int]:
        pad = (0,) * (4 - len(self.places))
        return {f"p{k}": v for k, v in enumerate(self.places + pad)} | {f"w{k}": v for k, v in enumerate(self.weights + pad)} | {"t0": self.towards[0], "t1": self.towards[1], "b0": self.by[0], "b1": self.by[1], "away": self.away}


class Line:
    """Where the references of one side, up to 2 * n after the corner, stand in the array of ``reference_line``."""

    def __init__(self, n: int, side: str, smooth: bool = False):
        self.first = (2 * n + 1) * (("top", "left").index(side) + 2 * smooth)

    def __getitem__(self, i: int) -> int:
        return self.first + i


def reference_line(top: Column, left: Column, n: int) -> Column:
    """An array of the references of both sides, the same smoothed, and the mean, for blocks of n x n."""
    return F.concat(F.slice(top, 1, 2 * n + 1), F.slice(left, 1, 2 * n + 1), *smoothed_references(top, left, n), F.array(mean(top, left, n, n)))


def _flat_taps(top: Line, left: Line, x: int, y: int, mode: int, n: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The planar mode's or the mean's."""
    if mode == 1:
        return (4 * (2 * n + 1),), (64,)
    unit = 32 // n
    return (left[y + 1], top[n], top[x + 1], left[n]), ((n - 1 - x) * unit, (x + 1) * unit, (n - 1 - y) * unit, (y + 1) * unit)


def _turn(mode: int) -> tuple[int, int, int]:
    """A mode's turn from straight, its slope without sign, and the inverse slope."""
    turn = mode - VERTICAL if mode >= 34 else HORIZONTAL - mode
    slope = SLOPES[abs(turn)]
    return turn, slope, round(16384 / slope) if slope else 0


def _along_angle(main: Line, side: Line, along: int, across: int, mode: int, n: int) -> tuple[list[int], int]:
    """The four references around a sample's place along an angle, and its 32nds from the second to the third."""
    turn, slope, back = _turn(mode)
    moved = (-slope if turn < 0 else slope) * (across + 1)
    at = [(moved >> 5) + along + k for k in range(4)]
    return [main[min(i, 2 * n)] if i >= 0 else side[max(0, min(n, (-i * back + 256) >> 9))] for i in at], moved & 31


def angular_taps(mode: int, x: int, y: int, n: int) -> Taps:
    """Of ``planar``, ``mean`` and ``angular``, by mode."""
    top, left = Line(n, "top"), Line(n, "left")
    if mode <= 1:
        return Taps(*_flat_taps(top, left, x, y, mode, n))
    main, side, along, across = (top, left, x, y) if mode >= 34 else (left, top, y, x)
    at, part = _along_angle(main, side, along, across, mode, n)
    return Taps((at[1], at[2]), (64 - 2 * part, 2 * part))


def luma_taps(mode: int, x: int, y: int, n: int) -> Taps:
    """Of ``luma``: smoothed references and taps, and blending by position, as the mode and size have them."""
    log = n.bit_length() - 1
    turn, slope, back = _turn(mode)
    far = min(abs(mode - HORIZONTAL), abs(mode - VERTICAL)) > SMOOTHED_FROM[log]
    smooth = n * n > 32 if mode == 0 else mode > 1 and far and slope % 32 == 0
    top, left = Line(n, "top", smooth), Line(n, "left", smooth)
    straight = (2 * log - 2) >> 2
    near = lambda p, scale: 32 >> min(31, (2 * p) >> scale)
    if mode <= 1:
        taps = _flat_taps(top, left, x, y, mode, n)
        if n < 4:
            return Taps(*taps)
        by = near(x, straight), near(y, straight)
        return Taps(*taps, (left[y + 1], top[x + 1]), by, sum(by))
    main, side, along, across = (top, left, x, y) if mode >= 34 else (left, top, y, x)
    at, part = _along_angle(main, side, along, across, mode, n)
    half = part // 2
    taps = ((at[1],), (64,)) if slope % 32 == 0 else (tuple(at), (16 - half, 32 - half, 16 + half, half) if far else CUBIC[part])
    scale = min(2, log - (max(3 * back - 2, 1).bit_length() - 1) + 8)
    if n >= 4 and turn == 0 and along < 3 << straight:
        by = near(along, straight)
        return Taps(*taps, (side[across + 1], main[0]), (by, -by))
    if n >= 4 and turn > 0 and scale >= 0 and along < 3 << scale:
        by = near(along, scale)
        return Taps(*taps, (side[min(2 * n, across + 1 + ((256 + (along + 1) * back) >> 9))], 0), (by, 0), by)
    return Taps(*taps)


def residuals(own: str, line: str, modes, taps, n: int, most: int = 255) -> Column:
    """For each of ``modes`` an array by rows of the block's samples ``own`` less their prediction; columns' names.

    ``line`` is a ``reference_line``. The taps are one literal that is parsed once, so a block needs one row, no shuffle.
    """
    table = [[taps(m, i % n, i // n, n).fields() for i in range(n * n)] for m in modes]
    kind = f"array<array<struct<{', '.join(f'{k}: int' for k in table[0][0])}>>>"
    clipped = lambda v: f"least({most}, greatest(0, {v}))"
    value = clipped(f"shiftright({' + '.join(f't.w{k} * {line}[t.p{k}]' for k in range(4))} + 32, 6)")
    drawn = clipped(f"v + shiftright(t.b0 * {line}[t.t0] + t.b1 * {line}[t.t1] - t.away * v + 32, 6)")
    one = f"{own}[i] - if(t.b0 = 0 AND t.b1 = 0, {value}, transform(array({value}), v -> {drawn})[0])"
    return F.expr(f"transform(from_json('{json.dumps(table)}', '{kind}'), m -> transform(m, (t, i) -> {one}))")


def downsampled(rows: DataFrame, sub_w: int, sub_h: int) -> DataFrame:
    """(y, x, v): luma at the places of chroma, for the subsampling (1, 1), (2, 1) or (2, 2).

    (1 2 1) across, on both rows where they are halved; at the left edge the sample itself stands for the one before.
    """
    if (sub_w, sub_h) == (1, 1):
        return rows.select("y", F.posexplode("row").alias("x", "v")).withColumn("x", F.col("x").cast("bigint"))
    at = lambda row, i: F.element_at(row, i.cast("int") + 1)
    count = F.sequence(F.lit(0), F.floor(F.size(F.col("_rows")[0]) / 2).cast("int") - 1)
    across = lambda row, k: at(row, F.greatest(2 * k - 1, F.lit(0))) + 2 * at(row, 2 * k) + at(row, 2 * k + 1)
    pair = rows.groupBy(F.expr(f"y div {sub_h}").alias("y")).agg(F.sort_array(F.collect_list(F.struct(F.col("y").alias("_y"), "row"))).alias("_r")).where(F.size("_r") == sub_h)
    pair = pair.select("y", F.transform("_r", lambda r: r["row"]).alias("_rows"))
    total = lambda k: F.aggregate("_rows", F.lit(0).cast("bigint"), lambda s, row: s + across(row, k))
    v = F.transform(count, lambda k: F.shiftright(total(k) + 2 * sub_h, 1 + sub_h))
    return pair.select("y", F.posexplode(v).alias("x", "v")).withColumn("x", F.col("x").cast("bigint"))


def four_points(top_luma: Column, top_chroma: Column, left_luma: Column, left_chroma: Column, above: Column, beside: Column) -> Column:
    """Struct of four luma and four chroma samples for the line's fit; null if neither side is there.

    Two of each side, a quarter and three quarters along, if both are there, else four of the one, an eighth
    apart from its ends; the two of a side of only two samples stand twice, the second first.
    """

    def side(luma: Column, chroma: Column, there: Column, alone: Column) -> Column:
        n = F.size(luma)
        more = F.when(alone, 1).otherwise(0)
        start, step = F.floor(n / F.pow(F.lit(2.0), 2 + more)), F.greatest(F.floor(n / F.pow(F.lit(2.0), 1 + more)), F.lit(1))
        many = F.least(n, 2 + 2 * more)
        place = lambda k: (start + k * step + 1).cast("int")
        points = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.struct(F.element_at(luma, place(k)).alias("l"), F.element_at(chroma, place(k)).alias("c")))
        return F.when(there, points).otherwise(F.slice(points, 1, 0))

    found = F.concat(side(top_luma, top_chroma, above, ~beside), side(left_luma, left_chroma, beside, ~above))
    found = F.when(F.size(found) == 2, F.array(found[1], found[0], found[1], found[0])).otherwise(found)
    return F.when(above | beside, F.struct(F.transform(found, lambda p: p["l"]).alias("luma"), F.transform(found, lambda p: p["c"]).alias("chroma")))
