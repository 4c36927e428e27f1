"""Queries on levels and contexts chosen along a block, with recursive DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modes, rates, secondary, states, transforms, trellis
from ..sources import planes
from .catalogue import QP, forward_sql, query, rows_of, scan_sql

#: What a squared error of an 8 x 8 coefficient costs in squared samples, and a bit at the quantizer.
SCALE, BIT = 0.015625, rates.cost_of_bits(QP)
_BITS = "CASE WHEN l <= 0 THEN 0 WHEN l = 1 THEN 3 WHEN l <= 3 THEN 5 ELSE 6 + 2 * floor(log2((l - 3)::DOUBLE)) END"


# The scales in the SQL are those of quantizer 29 and 8 x 8, written out: 14564 of 2**22, 72 * 2**4 * 16 of 2**7.
@query(
    "dq_trellis",
    f"""WITH RECURSIVE {forward_sql(8, 8)}, o AS ({scan_sql(8, 8)}), k AS MATERIALIZED (SELECT brow, bcol, pos, c FROM coef JOIN o ON o.x = u AND o.y = v),
    m(s, odd, nxt) AS (VALUES (0, 0, 0), (0, 1, 2), (1, 0, 2), (1, 1, 0), (2, 0, 1), (2, 1, 3), (3, 0, 3), (3, 1, 1)),
    t AS (SELECT DISTINCT brow, bcol, 64::BIGINT AS pos, 0 AS s, 0::DOUBLE AS cost, 0 AS from_s, 0::BIGINT AS l FROM k UNION ALL
      SELECT brow, bcol, pos, nxt AS s, best.cost, best.s AS from_s, best.l FROM (SELECT brow, bcol, pos, nxt, min(struct_pack(cost := cost, at := 3 * s + i, s := s, l := l)) AS best FROM (
        SELECT q.brow, q.bcol, q.pos, q.s, q.i, q.l, m.nxt, q.cost + q.e * q.e * {SCALE} + {BIT!r} * ({_BITS}) AS cost FROM (
          SELECT *, (abs(c) - (((CASE WHEN l = 0 THEN 0 ELSE 2 * l - s // 2 END) * 18432 + 64) >> 7))::DOUBLE AS e FROM (
            SELECT t.brow, t.bcol, k.pos, k.c, t.s, t.cost, i, CASE WHEN i = 0 THEN 0 ELSE ((abs(k.c) * 14564 + (t.s // 2) * 2097152) >> 22) + i - 1 END AS l FROM t JOIN k ON k.brow = t.brow AND k.bcol = t.bcol AND k.pos = t.pos - 1, (VALUES (0), (1), (2)) v(i))) q
        JOIN m ON m.s = q.s AND m.odd = q.l % 2) GROUP BY brow, bcol, pos, nxt)),
    b AS (SELECT brow, bcol, 0::BIGINT AS pos, w.from_s, w.l FROM (SELECT brow, bcol, min(struct_pack(cost := cost, s := s, from_s := from_s, l := l)) AS w FROM t WHERE pos = 0 GROUP BY brow, bcol) UNION ALL
      SELECT t.brow, t.bcol, t.pos, t.from_s, t.l FROM b JOIN t ON t.brow = b.brow AND t.bcol = b.bcol AND t.pos = b.pos + 1 AND t.s = b.from_s AND t.pos < 64)
    SELECT brow, bcol, pos, (CASE WHEN c < 0 THEN -l ELSE l END)::BIGINT AS level FROM b JOIN k USING (brow, bcol, pos)""",
)
def dq_trellis(spark, sf_dir):
    return trellis.quantized(transforms.forward(rows_of(spark, sf_dir, 8), 8, 8), 8, 8, QP, SCALE)


@query(
    "ctx_walk",
    f"""WITH RECURSIVE {planes.RAW_SQL}, b AS (SELECT y, x, v % 2 AS bin, coalesce(lag(v % 2, 1) OVER w, 0) + coalesce(lag(v % 2, 2) OVER w, 0) + 3 * ((v // 8) % 4) AS ctx FROM raw WINDOW w AS (PARTITION BY y ORDER BY x)),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY y, ctx ORDER BY x) AS k FROM b),
    i AS (SELECT c - 1 AS ctx, [25, 19, 28, 14, 25, 20, 29, 30, 19, 37, 30, 38][c] AS init, [12, 9, 9, 10, 9, 9, 9, 10, 8, 8, 8, 10][c] AS win FROM range(1, 13) r(c)),
    z AS (SELECT DISTINCT o.y, ctx, least(127, greatest(1, ((((init >> 3) - 4) * (o.y % 64 - 16)) >> 1) + (init & 7) * 18 + 1)) * 256 AS s, 2 + ((win >> 2) & 3) AS slow, 5 + ((win >> 2) & 3) + (win & 3) AS fast FROM o JOIN i USING (ctx)),
    t AS (SELECT y, ctx, 1::BIGINT AS k, (s & 32736)::BIGINT AS a, (s & 32766)::BIGINT AS b, slow, fast FROM z UNION ALL
      SELECT t.y, t.ctx, t.k + 1, a - ((a >> slow::INTEGER) & 32736) + CASE WHEN bin = 1 THEN (32767 >> slow::INTEGER) & 32736 ELSE 0 END, b - ((b >> fast::INTEGER) & 32766) + CASE WHEN bin = 1 THEN (32767 >> fast::INTEGER) & 32766 ELSE 0 END, slow, fast
      FROM t JOIN o ON o.y = t.y AND o.ctx = t.ctx AND o.k = t.k)
    SELECT y, x, ctx, bin, ((a + b) >> 8)::BIGINT AS prob FROM t JOIN o USING (y, ctx, k)""",
)
def ctx_walk(spark, sf_dir):
    """Parities of a row's samples coded in twelve contexts, chosen by the two bins before and the sample's height; the row gives the quantizer."""
    bins = F.expr("transform(row, (v, x) -> struct(cast(if(x > 0, row[x - 1] % 2, 0) + if(x > 1, row[x - 2] % 2, 0) + 3 * ((v div 8) % 4) AS int) AS ctx, cast(v % 2 AS int) AS bin))")
    start = states.contexts(states.SIGNIFICANT, states.SIGNIFICANT_WINDOWS, F.col("y") % 64)
    coded = planes.embedding_rows(spark, sf_dir).select("y", start.alias("start"), bins.alias("bins"))
    found = coded.select("y", F.posexplode(F.arrays_zip("bins", states.adapted_each("start", "bins").alias("prob"))).alias("x", "e"))
    return found.select("y", F.col("x").cast("bigint").alias("x"), *[F.col(f"e.{c}").cast("bigint").alias(c.split(".")[-1]) for c in ("bins.ctx", "bins.bin", "prob")])


_SHAPES = ((8, 8), (4, 4), (16, 8))
_SET = "CASE WHEN p <= 1 THEN 0 WHEN p BETWEEN 24 AND 44 THEN 3 WHEN p BETWEEN 13 AND 55 THEN 2 ELSE 1 END"


def secondary_sql(w: int, h: int) -> str:
    """(brow, bcol, u, v, c, back) of one shape: kernels from their formulas, positions from the shape of the corner."""
    side, rows, n = (4, 8, 16) if (w, h) == (4, 4) else (8, 8 if w == h else 16, 48)
    angle = "CASE WHEN m > 1 AND m < 8 THEN m + 65 ELSE m END" if w > h else "m"
    return f"""SELECT {w}::BIGINT AS w, {h}::BIGINT AS h, * FROM (WITH {forward_sql(w, h)},
      pl AS (SELECT brow, bcol, CASE WHEN g >= 67 THEN g + 14 ELSE g END AS p FROM (SELECT brow, bcol, {angle} AS g FROM (SELECT DISTINCT brow, bcol, (brow * 8 + bcol * 5) % 67 AS m FROM coef))),
      bl AS (SELECT brow, bcol, {_SET} AS st, p >= 81 OR (p > 34 AND p < 67) AS turn FROM pl),
      ps AS (SELECT row_number() OVER (ORDER BY y, x) - 1 AS i, x, y FROM range(0, {side}) a(x), range(0, {side}) b(y) WHERE y < 4 OR x < 4),
      dg AS (SELECT row_number() OVER (ORDER BY x + y, x) - 1 AS k, x, y FROM range(0, 4) a(x), range(0, 4) b(y) QUALIFY k < {rows}),
      kr AS (SELECT st, k, i, round(128 * sqrt(2.0::DOUBLE / {n}) * CASE st WHEN 0 THEN cos(pi() / {n} * (i + 0.5::DOUBLE) * k) * CASE WHEN k = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END WHEN 1 THEN sin(pi() / {n} * (i + 0.5::DOUBLE) * (k + 1)) * CASE WHEN k = {n - 1} THEN sqrt(0.5::DOUBLE) ELSE 1 END
        WHEN 2 THEN cos(pi() / {n} * (i + 0.5::DOUBLE) * (k + 0.5::DOUBLE)) ELSE sin(pi() / {n} * (i + 0.5::DOUBLE) * (k + 0.5::DOUBLE)) END)::BIGINT AS m FROM range(0, 4) a(st), range(0, {rows}) b(k), range(0, {n}) c(i)),
      iv AS (SELECT brow, bcol, st, turn, i, c FROM bl JOIN ps ON true JOIN coef USING (brow, bcol) WHERE u = CASE WHEN turn THEN y ELSE x END AND v = CASE WHEN turn THEN x ELSE y END),
      fw AS (SELECT brow, bcol, any_value(iv.st) AS st, any_value(turn) AS turn, k, (sum(c * m)::BIGINT + 64) >> 7 AS c FROM iv JOIN kr ON kr.st = iv.st AND kr.i = iv.i GROUP BY brow, bcol, k),
      bk AS (SELECT brow, bcol, any_value(turn) AS turn, i, least(32767, greatest(-32768, (sum(c * m)::BIGINT + 64) >> 7)) AS c FROM fw JOIN kr ON kr.st = fw.st AND kr.k = fw.k GROUP BY brow, bcol, i),
      f2 AS (SELECT brow, bcol, x AS u, y AS v, c FROM fw JOIN dg USING (k)), b2 AS (SELECT brow, bcol, CASE WHEN turn THEN y ELSE x END AS u, CASE WHEN turn THEN x ELSE y END AS v, c FROM bk JOIN ps USING (i))
    SELECT q.brow, q.bcol, q.u, q.v, coalesce(f2.c, 0)::BIGINT AS c, coalesce(b2.c, 0)::BIGINT AS back FROM coef q LEFT JOIN f2 ON f2.brow = q.brow AND f2.bcol = q.bcol AND f2.u = q.u AND f2.v = q.v LEFT JOIN b2 ON b2.brow = q.brow AND b2.bcol = q.bcol AND b2.u = q.u AND b2.v = q.v)"""


@query("secondary_transform", " UNION ALL ".join(secondary_sql(w, h) for w, h in _SHAPES))
def secondary_transform(spark, sf_dir):
    """Every block of three shapes, in a mode that its place draws, after the secondary transform, and what its inverse gives back."""
    out = None
    for w, h in _SHAPES:
        side, rows = secondary.shape(w, h)
        kernels = secondary.bases(side, rows, 1)
        found = secondary.by_rows(transforms.forward(rows_of(spark, sf_dir, h), w, h), w)
        mode = (F.col("brow") * 8 + F.col("bcol") * 5) % 67
        place = secondary.lookup(modes.wide_angle(F.lit(w), F.lit(h), mode, back=67).cast("bigint"))
        found = found.withColumn("place", place).withColumn("c", secondary.forward(F.col("block"), F.col("place"), w, h, kernels))
        found = found.withColumn("back", secondary.inverse(F.col("c"), F.col("place"), w, h, kernels))
        each = found.select("brow", "bcol", F.posexplode(F.arrays_zip("c", "back")).alias("at", "e"))
        one = each.select(F.lit(w).cast("bigint").alias("w"), F.lit(h).cast("bigint").alias("h"), "brow", "bcol", (F.col("at") % w).cast("bigint").alias("u"), F.expr(f"at div {w}").alias("v"), F.col("e.c").alias("c"), F.col("e.back").alias("back"))
        out = one if out is None else out.union(one)
    return out
