"""Deblocking against brute force on lists: weak, strong and long edges, both directions, odd leaves."""

import random

import pytest

from tessera.operators import deblock

TC = list(deblock.STRENGTH)


def filter_line(g, put, tc, mode, more_p, more_q, n_p, n_q):
    """One line: ``g(k)`` reads q_k for k >= 0 and p_(-k-1) below, ``put`` writes."""
    clip = lambda lo, hi, v: max(lo, min(hi, v))
    a = {k: g(k) for k in range(-8, 8)}
    p, q = [a[-k - 1] for k in range(8)], [a[k] for k in range(8)]
    if mode == "long":
        if n_p == n_q:
            mid = (2 * (p[0] + q[0]) + sum(p[1:7]) + sum(q[1:7]) + 8) >> 4
        else:
            lo, sh = (p, q) if n_p > n_q else (q, p)
            mid = (2 * (lo[0] + sh[0]) + sh[0] + 2 * (sh[1] + sh[2]) + lo[1] + sh[1] + sum(lo[2:7]) + 8) >> 4
        ref_p, ref_q = (p[n_p - 2] + p[n_p - 1] + 1) >> 1, (q[n_q - 1] + q[n_q] + 1) >> 1
        for ref, n, sign in ((ref_p, n_p, -1), (ref_q, n_q, 1)):
            for k in range(n):
                reach = tc * deblock.REACHES[n][k] >> 1
                w = deblock.WEIGHTS[n][k]
                a[sign * k] = clip(a[sign * k] - reach, a[sign * k] + reach, (mid * w + ref * (64 - w) + 32) >> 6)
    elif mode == "strong":
        new = {-1: (3, p[2] + 2 * p[1] + 2 * p[0] + 2 * q[0] + q[1] + 4 >> 3), 0: (3, p[1] + 2 * p[0] + 2 * q[0] + 2 * q[1] + q[2] + 4 >> 3), -2: (2, p[2] + p[1] + p[0] + q[0] + 2 >> 2), 1: (2, p[0] + q[0] + q[1] + q[2] + 2 >> 2)}
        new |= {-3: (1, 2 * p[3] + 3 * p[2] + p[1] + p[0] + q[0] + 4 >> 3), 2: (1, p[0] + q[0] + q[1] + 3 * q[2] + 2 * q[3] + 4 >> 3)}
        for k, (n, v) in new.items():
            a[k] = clip(a[k] - n * tc, a[k] + n * tc, v)
    else:
        delta = (9 * (q[0] - p[0]) - 3 * (q[1] - p[1]) + 8) >> 4
        if abs(delta) < 10 * tc:
            delta, h = clip(-tc, tc, delta), tc >> 1
            a[-1], a[0] = clip(0, 255, p[0] + delta), clip(0, 255, q[0] - delta)
            if more_p:
                a[-2] = clip(0, 255, p[1] + clip(-h, h, (((p[2] + p[0] + 1) >> 1) - p[1] + delta) >> 1))
            if more_q:
                a[1] = clip(0, 255, q[1] + clip(-h, h, (((q[2] + q[0] + 1) >> 1) - q[1] - delta) >> 1))
    for k, v in a.items():
        put(k, v)


def brute(plane, leaves, ctu, seen):
    height, width = len(plane), len(plane[0])
    at = {(x, y): leaf for leaf in leaves for y in range(leaf[1], leaf[1] + leaf[2], 4) for x in range(leaf[0], leaf[0] + leaf[2], 4)}
    for upright in (True, False):
        for y in range(0, height, 4):
            for x in range(0, width, 4):
                leaf, along = at[x, y], (x if upright else y)
                if along == 0 or leaf[0 if upright else 1] != along:
                    continue
                other = at[(x - 4, y) if upright else (x, y - 4)]
                qp, top = (leaf[3] + other[3] + 1) >> 1, not upright and y % ctu == 0
                tc, beta = (TC[max(0, min(65, qp + 2))] + 2) >> 2, deblock.threshold(max(0, min(63, qp)))
                lp, lq = other[2] >= 32 and not top, leaf[2] >= 32

                def g(line, k):
                    return plane[y + line][x + k] if upright else plane[y + k][x + line]

                def put(line, k, v):
                    if upright:
                        plane[y + line][x + k] = v
                    else:
                        plane[y + k][x + line] = v

                bend = lambda line, o, s: abs(g(line, o) - 2 * g(line, o + s) + g(line, o + 2 * s))

                def strong(line, d, lp, lq):
                    sp, sq = abs(g(line, -4) - g(line, -1)), abs(g(line, 3) - g(line, 0))
                    if lp:
                        sp = (sp + abs(g(line, -5) - g(line, -6) - g(line, -7) + g(line, -8)) + abs(g(line, -4) - g(line, -8)) + 1) >> 1
                    if lq:
                        sq = (sq + abs(g(line, 4) - g(line, 5) - g(line, 6) + g(line, 7)) + abs(g(line, 7) - g(line, 3)) + 1) >> 1
                    some = lp or lq
                    return sp + sq < (3 * beta >> 5 if some else beta >> 3) and d < (beta >> 4 if some else beta >> 2) and abs(g(line, -1) - g(line, 0)) < (5 * tc + 1) >> 1

                dp, dq = [bend(n, -1, -1) for n in (0, 3)], [bend(n, 0, 1) for n in (0, 3)]
                dpl = [(v + bend(n, -4, -1) + 1) >> 1 if lp else v for v, n in zip(dp, (0, 3), strict=True)]
                dql = [(v + bend(n, 3, 1) + 1) >> 1 if lq else v for v, n in zip(dq, (0, 3), strict=True)]
                mode = None
                if (lp or lq) and sum(dpl) + sum(dql) < beta and all(strong(n, 2 * (a + b), lp, lq) for n, a, b in zip((0, 3), dpl, dql, strict=True)):
                    mode = "long"
                elif sum(dp) + sum(dq) < beta:
                    mode = "strong" if all(strong(n, 2 * (a + b), False, False) for n, a, b in zip((0, 3), dp, dq, strict=True)) else "weak"
                seen.add((upright, mode, lp, lq, top))
                if mode:
                    side = (beta + (beta >> 1)) >> 3
                    for n in range(4):
                        filter_line(lambda k, n=n: g(n, k), lambda k, v, n=n: put(n, k, v), tc, mode, sum(dp) < side, sum(dq) < side, 7 if lp else 3, 7 if lq else 3)
    return plane


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = []

    def split(x, y, size):
        if size > 8 and (size == 128 or rng.random() < 0.55):
            for dy in (0, size // 2):
                for dx in (0, size // 2):
                    split(x + dx, y + dy, size // 2)
        else:
            leaves.append((x, y, size, rng.choice([20, 30, 37, 45, 51])))

    for y in range(0, 512, 128):
        split(0, y, 128)
    leaves = [leaf for leaf in leaves if leaf[1] < 400]  # the last ones reach below the picture
    level = {leaf: (rng.randrange(90, 150), rng.choice([0, 0, 1, 2, 12])) for leaf in leaves}
    plane = [[0] * 128 for _ in range(400)]
    for leaf, (base, noise) in level.items():
        for y in range(leaf[1], min(400, leaf[1] + leaf[2])):
            for x in range(leaf[0], leaf[0] + leaf[2]):
                plane[y][x] = min(255, max(0, (base + 120) // 2 + rng.randint(-noise, noise) + (x + y) // 32))
    rows = spark.createDataFrame(list(enumerate(plane)), "y long, row array<long>")
    tree = spark.createDataFrame(leaves, "x long, y long, size long, qp long")
    got = {r.y: list(r.row) for r in deblock.deblocked(rows, tree, 128).collect()}
    seen = set()
    before = [list(r) for r in plane]
    want = brute(plane, leaves, 128, seen)
    assert {m for _, m, *_ in seen} == {None, "weak", "strong", "long"} and {(a, b) for _, m, a, b, _ in seen if m == "long"} == {(True, True), (True, False), (False, True)}
    assert want != before and sorted(got) == list(range(400)) and all(got[y] == want[y] for y in range(400))


def chroma_brute(plane, leaves, ctu, seen):
    """4:2:0: ``leaves`` in luma, the plane at half its size."""
    height, width = len(plane), len(plane[0])
    at = {(x, y): leaf for leaf in leaves for y in range(leaf[1], leaf[1] + leaf[2], 4) for x in range(leaf[0], leaf[0] + leaf[2], 4)}
    clip = lambda lo, hi, v: max(lo, min(hi, v))
    for upright in (True, False):
        for y in range(0, height, 2 if upright else 8):
            for x in range(0, width, 8 if upright else 2):
                along = x if upright else y
                leaf = at[2 * x, 2 * y]
                if along == 0 or leaf[0 if upright else 1] != 2 * along:
                    continue
                other = at[(2 * x - 4, 2 * y) if upright else (2 * x, 2 * y - 4)]
                qp, ctb = (leaf[3] + other[3] + 1) >> 1, not upright and y % (ctu // 2) == 0
                tc, beta = (TC[clip(0, 65, qp + 2)] + 2) >> 2, deblock.threshold(clip(0, 63, qp))

                def g(n, k):
                    return plane[y + n][x + k] if upright else plane[y + k][x + n]

                strong = False
                if leaf[2] >= 16 and other[2] >= 16:
                    d = [(abs(g(n, -2) - g(n, -1)) if ctb else abs(g(n, -3) - 2 * g(n, -2) + g(n, -1))) + abs(g(n, 0) - 2 * g(n, 1) + g(n, 2)) for n in (0, 1)]
                    if sum(d) < beta:
                        strong = all(
                            abs((g(n, -2) if ctb else g(n, -4)) - g(n, -1)) + abs(g(n, 3) - g(n, 0)) < beta >> 3 and 2 * d[n] < beta >> 2 and abs(g(n, -1) - g(n, 0)) < (5 * tc + 1) >> 1 for n in (0, 1)
                        )
                seen.add((upright, strong, ctb))
                for n in (0, 1):
                    a = [g(n, k) for k in range(-4, 4)]
                    new = {}
                    if not strong:
                        delta = clip(-tc, tc, (4 * (a[4] - a[3]) + a[2] - a[5] + 4) >> 3)
                        new = {-1: clip(0, 255, a[3] + delta), 0: clip(0, 255, a[4] - delta)}
                    else:
                        taps = {-1: (0, 0, 3, 2, 1, 1, 1, 0), 0: (0, 0, 2, 1, 2, 1, 1, 1)} if ctb else {-3: (3, 2, 1, 1, 1, 0, 0, 0), -2: (2, 1, 2, 1, 1, 1, 0, 0), -1: (1, 1, 1, 2, 1, 1, 1, 0), 0: (0, 1, 1, 1, 2, 1, 1, 1)}
                        taps |= {1: (0, 0, 1, 1, 1, 2, 1, 2), 2: (0, 0, 0, 1, 1, 1, 2, 3)}
                        for k, t in taps.items():
                            new[k] = clip(a[k + 4] - tc, a[k + 4] + tc, (sum(u * v for u, v in zip(t, a, strict=True)) + 4) >> 3)
                    for k, v in new.items():
                        if upright:
                            plane[y + n][x + k] = v
                        else:
                            plane[y + k][x + n] = v
    return plane


def test_chroma_equals_brute_force(spark):
    rng = random.Random(8)
    leaves = []

    def split(x, y, size):
        if size > 8 and (size == 128 or rng.random() < 0.5):
            for dy in (0, size // 2):
                for dx in (0, size // 2):
                    split(x + dx, y + dy, size // 2)
        else:
            leaves.append((x, y, size, rng.choice([20, 33, 40, 51])))

    for y in range(0, 384, 128):
        split(0, y, 128)
    leaves = [leaf for leaf in leaves if leaf[1] < 296]
    plane = [[0] * 64 for _ in range(148)]
    for x0, y0, size, _ in leaves:
        base, noise = rng.randrange(100, 140), rng.choice([0, 0, 1, 9])
        for y in range(y0 // 2, min(148, (y0 + size) // 2)):
            for x in range(x0 // 2, (x0 + size) // 2):
                plane[y][x] = (base + 120) // 2 + rng.randint(-noise, noise)
    rows = spark.createDataFrame(list(enumerate(plane)), "y long, row array<long>")
    got = {r.y: list(r.row) for r in deblock.chroma_deblocked(rows, spark.createDataFrame(leaves, "x long, y long, size long, qp long"), 64).collect()}
    seen = set()
    want = chroma_brute([list(r) for r in plane], leaves, 128, seen)
    assert {(s, c) for _, s, c in seen} == {(True, True), (True, False), (False, True), (False, False)} and want != plane
    assert sorted(got) == list(range(148)) and all(got[y] == want[y] for y in range(148))
