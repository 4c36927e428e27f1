"""The walk down the coding tree against recursion on lists: statistics, forced splits at the edges, both trees of a dual walk."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import partition, walk


def may(x, y, w, h, s, width, height, lim):
    low, right = y + h > height or x >= width, x + w > width or y >= height
    halves, quarters = max(w, h) <= lim.max_bt and s["mt"] < lim.depth + s["im"], min(w, h) > lim.min_qt and s["bt"] == 0
    if not low and not right:
        forced = "none"
    elif low and right and quarters:
        forced = "quad"
    elif low and halves and w <= 64:
        forced = "bin_h"
    elif right and halves and h <= 64:
        forced = "bin_v"
    else:
        forced = "quad"
    quad = s["last"] in ("none", "quad") and w > lim.min_qt
    if forced != "none":
        return forced, {k for k, v in {"bin_h": forced == "bin_h", "bin_v": forced == "bin_v", "quad": quad or forced == "quad"}.items() if v}
    out = {"none"} | ({"quad"} if quad else set())
    deeper = s["mt"] < lim.depth + s["im"] and max(w, h) > 4
    if deeper and max(w, h) <= lim.max_bt:
        out |= {k for k, v, t in (("bin_h", h, "tri_h"), ("bin_v", w, "tri_v")) if v > 4 and not (s["last"] == t and s["part"] == 1)}
    if deeper and max(w, h) <= min(lim.max_tt, 64):
        out |= {k for k, v in (("tri_h", h), ("tri_v", w)) if v > 8}
    return forced, out


def decide(plane, x, y, w, h, can, qp, least):
    block = [row[x : x + w] for row in plane[y : y + h]]
    flat = [v for r in block for v in r]
    n = len(flat)
    gx = sum(abs(b - a) for r in block for a, b in zip(r, r[1:], strict=False))
    gy = sum(abs(b - a) for r, t in zip(block, block[1:], strict=False) for a, b in zip(r, t, strict=True))
    stay = "none" in can and max(w, h) <= 64
    if stay and sum(v * v for v in flat) // n - (sum(flat) // n) ** 2 < 64 + qp * qp:
        return "none"
    ver, hor, even = ["bin_v", "tri_v", "quad", "bin_h", "tri_h"], ["bin_h", "tri_h", "quad", "bin_v", "tri_v"], ["quad", "bin_v", "bin_h", "tri_v", "tri_h"]
    order = ver if w >= 2 * h else hor if h >= 2 * w else ver if gx * 4 > gy * 5 else hor if gy * 4 > gx * 5 else even
    side = {"quad": min(w, h) // 2, "bin_v": w // 2, "bin_h": h // 2, "tri_v": w // 4, "tri_h": h // 4}
    for s in order:
        if s in can and side[s] >= least:
            return s
    return "none" if stay else next((s for s in even if s in can), "none")


def brute(plane, width, height, qp, least, lim=partition.LUMA, statistics=True, forced_to=None):
    out = []

    def go(x, y, w, h, s, path, unit):
        if x >= width or y >= height:
            return
        forced, can = may(x, y, w, h, s, width, height, lim)
        if forced_to and max(w, h) > forced_to:
            split = "quad"
        elif statistics:
            split = decide(plane, x, y, w, h, can, qp, least)
        else:
            split = next(k for k in partition.SPLITS if k in can)
        if split == "none":
            out.append((*unit, path, x, y, w, h, s["qt"], s["mt"]))
            return
        q, b, v = split == "quad", split.startswith("bin"), split.endswith("v")
        cuts = {"quad": [(i / 2, j / 2, 0.5, 0.5) for j in (0, 1) for i in (0, 1)], "bin": [(0, 0.5), (0.5, 0.5)], "tri": [(0, 0.25), (0.25, 0.5), (0.75, 0.25)]}[split[:3] if not q else "quad"]
        for k, c in enumerate(cuts):
            px, py, pw, ph = c if q else (c[0], 0, c[1], 1) if v else (0, c[0], 1, c[1])
            t = {"qt": s["qt"] + q, "mt": 0 if q else s["mt"] + 1, "bt": 0 if q else s["bt"] + (1 if b else 2), "im": s["im"] + (b and forced != "none"), "last": split, "part": k}
            go(int(x + px * w), int(y + py * h), int(pw * w), int(ph * h), t, path + str(k), unit)

    for y in range(0, height, 128):
        for x in range(0, width, 128):
            go(x, y, 128, 128, {"qt": 0, "mt": 0, "bt": 0, "im": 0, "last": "none", "part": 0}, "", (y // 128, x // 128))
    return sorted(out)


def picture(seed, width, height):
    rng = random.Random(seed)
    kinds = {(i, j): (rng.choice(["flat", "noise", "across", "down", "edge"]), rng.randrange(40, 200)) for i in range(-(-width // 16)) for j in range(-(-height // 16))}

    def value(x, y):
        kind, base = kinds[x // 16, y // 16]
        return {"flat": base, "noise": base + rng.randrange(-40, 40), "across": base + 30 * (x % 2), "down": base + 30 * (y % 2), "edge": base + 50 * (x % 16 > 11)}[kind]

    return [[value(x, y) for x in range(width)] for y in range(height)]


@pytest.mark.parametrize(("width", "height", "qp", "least"), [(200, 136, 2, 4), (64, 264, 10, 8)])
def test_equals_recursion(spark, width, height, qp, least):
    plane = picture(width, width, height)
    rows = spark.createDataFrame(list(enumerate(plane)), "y long, row array<long>")
    found, top = walk.cells(rows, width, 128), rows.agg(F.max("y") + 1)
    got = walk.in_order(walk.walked(found, width, top, qp, least)).collect()
    want = brute(plane, width, height, qp, least)
    assert sorted(tuple(r)[:-1] for r in got) == want
    assert {(w, h) for *_, w, h, _, _ in want} > {(8, 8), (8, 16)} and sum(w * h for *_, w, h, _, _ in want) == width * height
    first = sorted((r for r in got if r.trow == 0 and r.tcol == 0), key=lambda r: r.seq)
    assert [r.path for r in first] == sorted(r.path for r in first) and [r.seq for r in first] == list(range(len(first)))


def test_both_trees(spark):
    width, height = 200, 136
    plane = picture(3, width, height)
    rows = spark.createDataFrame(list(enumerate(plane)), "y long, row array<long>")
    got = walk.dual(walk.cells(rows, width, 128), width, rows.agg(F.max("y") + 1), 5).collect()
    for tree, want in (("luma", brute(plane, width, height, 5, 4, forced_to=64)), ("chroma", brute(plane, width, height, 5, 4, partition.CHROMA, False, 64))):
        assert sorted((r.trow, r.tcol, r.path, r.x, r.y, r.w, r.h, r.qt_depth, r.mt_depth) for r in got if r.tree == tree) == want
    unit = sorted((r for r in got if r.trow == 0 and r.tcol == 0), key=lambda r: r.seq)
    regions = [(r.path[:1], r.tree) for r in unit]
    assert [r for k, r in enumerate(regions) if k == 0 or regions[k - 1] != r] == [(str(k), t) for k in range(4) for t in ("luma", "chroma")]
