"""Transform matrices and scales, built from their rules."""

from __future__ import annotations

# 64 * sqrt(2) * cos(j * pi / 128) as rounded by the standard; j odd, then 2, 4, 8 and 16 mod twice that.
ODD = (91, 90, 90, 90, 88, 87, 86, 84, 83, 81, 79, 77, 73, 71, 69, 65, 62, 59, 56, 52, 48, 44, 41, 37, 33, 28, 24, 20, 15, 11, 7, 2)
TWO = (90, 90, 88, 85, 82, 78, 73, 67, 61, 54, 46, 38, 31, 22, 13, 4)
FOUR = (90, 87, 80, 70, 57, 43, 25, 9)
EIGHT = (89, 75, 50, 18)
SIXTEEN = (83, 36)
# The first row of the sine transform of each size.
SINE = {
    4: (29, 55, 74, 84),
    8: (17, 32, 46, 60, 71, 78, 85, 86),
    16: (8, 17, 25, 33, 40, 48, 55, 62, 68, 73, 77, 81, 85, 87, 88, 88),
    32: (4, 9, 13, 17, 21, 26, 30, 34, 38, 42, 45, 50, 53, 56, 60, 63, 66, 68, 72, 74, 77, 78, 80, 82, 84, 85, 86, 87, 88, 89, 90, 90),
}
# Scales by the quantizer's remainder mod 6, for blocks of an even and an odd sum of log sides.
QUANT, DEQUANT = (26214, 23302, 20560, 18396, 16384, 14564), (40, 45, 51, 57, 64, 72)
QUANT_ODD, DEQUANT_ODD = (18396, 16384, 14564, 13107, 11651, 10280), (57, 64, 72, 80, 90, 102)
# Fixed value: reciprocals of the chroma line fit.
RECIPROCAL = (0, 7, 6, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1, 1, 1, 0)


def _cosines() -> list[int]:
    out = [64] * 65
    for first, values in ((1, ODD), (2, TWO), (4, FOUR), (8, EIGHT), (16, SIXTEEN)):
        for k, v in enumerate(values):
            out[first * (2 * k + 1)] = v
    out[32], out[64] = 64, 0
    return out


COSINE = _cosines()


def dct2(n: int) -> list[list[int]]:
    """Row k: the k-th cosine basis of ``n`` points."""

    def entry(k: int, i: int) -> int:
        j = (2 * i + 1) * k * (64 // n) % 256
        j = 256 - j if j > 128 else j
        return -COSINE[128 - j] if j > 64 else COSINE[j]

    return [[entry(k, i) for i in range(n)] for k in range(n)]


def dst7(n: int) -> list[list[int]]:
    """Row k: sin(pi (2k + 1)(i + 1) / (2n + 1)), scaled."""

    def entry(k: int, i: int) -> int:
        turn = 2 * n + 1
        j = (2 * k + 1) * (i + 1) % (2 * turn)
        sign, j = (-1, j - turn) if j > turn else (1, j)
        j = min(j, turn - j)
        return sign * SINE[n][j - 1] if j else 0

    return [[entry(k, i) for i in range(n)] for k in range(n)]


def dct8(n: int) -> list[list[int]]:
    """The sine transform's rows backwards, every second one negated."""
    return [[v if k % 2 == 0 else -v for v in reversed(row)] for k, row in enumerate(dst7(n))]


MATRICES = {"dct2": dct2, "dst7": dst7, "dct8": dct8}


def kept(kind: str, n: int) -> int:
    """Coefficients that are kept along a side: the upper half of the longest transforms is dropped."""
    return n // 2 if n == (64 if kind == "dct2" else 32) else n


def quant_terms(w: int, h: int, qp: int, depth: int = 8) -> tuple[int, int, int]:
    """(scale, offset, shift) of scalar quantization."""
    logs = w.bit_length() + h.bit_length() - 2
    shift = 14 + qp // 6 + 15 - depth - logs // 2 - logs % 2
    return (QUANT_ODD if logs % 2 else QUANT)[qp % 6], 171 << (shift - 9), shift


def dequant_terms(w: int, h: int, qp: int, depth: int = 8) -> tuple[int, int, int]:
    """(factor, offset, shift) of its inverse."""
    logs = w.bit_length() + h.bit_length() - 2
    shift = depth + logs // 2 - 5 + logs % 2
    return (DEQUANT_ODD if logs % 2 else DEQUANT)[qp % 6] * (1 << qp // 6) * 16, 1 << (shift - 1), shift


def diagonal(w: int, h: int) -> list[tuple[int, int]]:
    """(x, y) along the anti-diagonals, each from its lower left end."""
    return sorted(((x, y) for x in range(w) for y in range(h)), key=lambda p: (p[0] + p[1], p[0]))


def scan(w: int, h: int) -> list[tuple[int, int]]:
    """(x, y) of a block's positions: diagonally over groups of 4 x 4, and so within each; at most 32 a side."""
    inner = diagonal(4, 4)
    return [(4 * gx + x, 4 * gy + y) for gx, gy in diagonal(min(w, 32) // 4, min(h, 32) // 4) for x, y in inner]
