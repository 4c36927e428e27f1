"""The search over levels against every combination of candidates on a few coefficients, and against plain rounding."""

import itertools
import random

from tessera.functions.tables import dequant_terms, quant_terms
from tessera.operators import states, trellis


def cost_of(cs, levels, w, h, qp, scale, bit):
    """Error and bits of levels in scan order, coded from the last on."""
    factor, _, shift = dequant_terms(w, h, qp + 1)
    s, total = 0, 0.0
    for c, v in zip(reversed(cs), reversed(levels), strict=True):
        level = abs(v)
        r = ((2 * level - s // 2 if level else 0) * factor + (1 << shift)) >> (shift + 1)
        b = 0 if level == 0 else 3 if level == 1 else 5 if level <= 3 else 6 + 2 * ((level - 3).bit_length() - 1)
        total += (abs(c) - r) ** 2 * scale + bit * b
        s = states.NEXT >> (4 * s + 2 * (level % 2)) & 3
    return total


def every(cs, w, h, qp):
    """All level sequences of zero and the two levels about each coefficient."""
    scale, _, shift = quant_terms(w, h, qp + 1)

    def go(k, s, tail):
        if k < 0:
            yield tail
            return
        low = (abs(cs[k]) * scale + (s // 2 << (shift - 1))) >> shift
        for level in {0, low, low + 1}:
            yield from go(k - 1, states.NEXT >> (4 * s + 2 * (level % 2)) & 3, [level, *tail])

    return list(go(len(cs) - 1, 0, []))


def test_no_combination_is_cheaper(spark):
    rng = random.Random(4)
    cases = [[rng.choice([0, rng.randrange(-3000, 3000), rng.randrange(-60, 60)]) for _ in range(6)] for _ in range(30)]
    cases += [[0] * 6, [32767, -32768, 0, 1, -1, 5], [100], []]
    table = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k long, c array<long>")
    for qp, bit in ((28, 5.0), (22, 80.0)):
        got = {r.k: list(r.levels) for r in table.select("k", trellis.chosen("c", 8, 8, qp, 0.015625, bit).alias("levels")).collect()}
        for k, cs in enumerate(cases):
            least = min(cost_of(cs, v, 8, 8, qp, 0.015625, bit) for v in every(cs, 8, 8, qp))
            assert abs(cost_of(cs, got[k], 8, 8, qp, 0.015625, bit) - least) <= 1e-9 * (1 + least)
            assert all(a == 0 or (a < 0) == (c < 0) for a, c in zip(got[k], cs, strict=True))
    assert any(len({abs(v) for v in combo}) > 1 for combo in itertools.islice(every(cases[0], 8, 8, 28), 50))
