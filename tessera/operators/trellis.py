"""Dependent quantization by rate and distortion over whole blocks: a Viterbi search as a fold, then a fold back.

The quantizer of a coefficient hangs on the parities of all levels after it in scan order, so levels are chosen
together: four states, three levels tried in each, from the last position to the first. Of equal costs the
smaller state and the earlier of its levels counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dequant_terms, quant_terms, scan
from .rates import cost_of_bits
from .states import NEXT
from .transforms import literal


def bits(level: str) -> str:
    """About how many bits a level of 0 or more takes, as an expression of type double."""
    return f"CASE WHEN {level} <= 0 THEN 0D WHEN {level} = 1 THEN 3D WHEN {level} <= 3 THEN 5D ELSE 2D * floor(log2(cast(greatest({level} - 3, 1) AS double))) + 6D END"


def chosen(name: str, w: int, h: int, qp: int, scale: float, bit: float) -> Column:
    """The levels of the array column ``name``, which has a block's coefficients in scan order.

    ``scale``: what a squared error of a coefficient costs; ``bit``: what a bit costs. Each step keeps, for every
    state it may lead to, the cheapest way there and where it came from; a state that can't be reached is null.
    """
    q_scale, _, q_shift = quant_terms(w, h, qp + 1)
    factor, _, shift = dequant_terms(w, h, qp + 1)
    low = f"shiftright(abs(v) * {q_scale}L + (s div 2) * {1 << (q_shift - 1)}L, {q_shift})"
    rebuilt = f"shiftright(if(l = 0, 0L, 2 * l - s div 2) * {factor}L + {1 << shift}L, {shift + 1})"
    moves = ", ".join(str(NEXT >> 2 * k & 3) for k in range(8))
    way = f"struct(t.dp[s] + e * e * {scale!r}D + {bit!r}D * ({bits('l')}) AS cost, 3 * s + k AS at, s, l, array({moves})[cast(2 * s + l % 2 AS int)] AS to)"
    tried = f"transform(array(0L, lo, lo + 1), (l, k) -> transform(array(cast(abs(v) - {rebuilt} AS double)), e -> {way})[0])"
    ways = f"flatten(transform(filter(array(0, 1, 2, 3), s -> t.dp[s] IS NOT NULL), s -> transform(array({low}), lo -> {tried})[0]))"
    best = f"transform(array({ways}), ws -> transform(array(0, 1, 2, 3), g -> array_min(filter(ws, x -> x.to = g))))[0]"
    kept = "struct(transform(b, x -> x.cost) AS dp, concat(t.back, array(transform(b, x -> struct(x.s AS s, x.l AS l)))) AS back)"
    start = "struct(array(0D, cast(NULL AS double), cast(NULL AS double), cast(NULL AS double)) AS dp, cast(array() AS array<array<struct<s: int, l: bigint>>>) AS back)"
    end = "array_min(transform(filter(array(0, 1, 2, 3), s -> t.dp[s] IS NOT NULL), s -> struct(t.dp[s] AS cost, s))).s"
    back = f"aggregate(reverse(t.back), struct({end} AS s, cast(array() AS array<bigint>) AS out), (r, b) -> struct(b[r.s].s AS s, concat(r.out, array(b[r.s].l)) AS out), r -> r.out)"
    sizes = f"aggregate(reverse({name}), {start}, (t, v) -> transform(array({best}), b -> {kept})[0], t -> {back})"
    return F.expr(f"zip_with({name}, {sizes}, (c, l) -> if(c < 0, -l, l))")


def in_scan_order(coefficients: DataFrame, w: int, h: int) -> DataFrame:
    """(brow, bcol, scanned): the coefficients (brow, bcol, u, v, c) of each block in one array."""
    place = {p: k for k, p in enumerate(scan(w, h))}
    pos = F.element_at(literal([place[(i % w, i // w)] for i in range(w * h)]), (F.col("v") * w + F.col("u") + 1).cast("int"))
    found = coefficients.groupBy("brow", "bcol").agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), F.col("c").cast("bigint").alias("c")))).alias("s"))
    return found.select("brow", "bcol", F.transform("s", lambda x: x["c"]).alias("scanned"))


def quantized(coefficients: DataFrame, w: int, h: int, qp: int, scale: float) -> DataFrame:
    """(brow, bcol, pos, level) of coefficients (brow, bcol, u, v, c): the levels that cost least in error and bits together; one shuffle."""
    levels = in_scan_order(coefficients, w, h).select("brow", "bcol", chosen("scanned", w, h, qp, scale, cost_of_bits(qp)).alias("levels"))
    return levels.select("brow", "bcol", F.posexplode("levels").alias("pos", "level")).withColumn("pos", F.col("pos").cast("bigint"))
