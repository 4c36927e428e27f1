"""Queries on deblocking, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, deblock
from ..sources import planes
from .catalogue import query, rows_of

#: A unit of the coding tree, and the quantizer whose threshold the leaves are split by.
CTU, LEAF_QP = 128, 2


def tempered(rows: DataFrame) -> DataFrame:
    """The plane with flat and busy areas side by side: distances from a grey of the area are shifted down by 0 to 5 digits, by area."""
    return rows.withColumn("row", F.expr("transform(row, (v, x) -> least(255L, 128L + 5 * ((y div 32 * 2 + x div 32) % 3) + shiftright(v - 128L, cast((y div 32 + x div 32 * 2) % 6 as int))))"))


def leaves(rows: DataFrame) -> DataFrame:
    """(x, y, size, qp): busier, so smaller leaves have the larger quantizer."""
    return blocks.quadtree(rows, LEAF_QP).withColumn("qp", F.expr("30 + 80 div size"))


AREAS = "area AS (SELECT y, x, least(255, 128 + 5 * ((y // 32 * 2 + x // 32) % 3) + ((v - 128) >> ((y // 32 + x // 32 * 2) % 6)::INTEGER)) AS v FROM plane)"
_BUSY = ", ".join(f"v{n} AS (SELECT y // {n} AS brow, x // {n} AS bcol, sum(v)::BIGINT AS a, sum(v * v)::BIGINT AS q, count(*)::BIGINT AS c FROM area GROUP BY ALL)" for n in (8, 16, 32, 64))
LEAVES = f"""{_BUSY}, s AS ({' UNION ALL '.join(f"SELECT {n} AS size, brow, bcol, q // c - (a // c) * (a // c) > {64 + LEAF_QP * LEAF_QP} AS busy FROM v{n}" for n in (8, 16, 32, 64))}),
    t AS (SELECT size, brow, bcol, busy FROM s WHERE size = 64 UNION ALL SELECT s.size, s.brow, s.bcol, s.busy FROM t JOIN s ON t.busy AND t.size > 8 AND s.size = t.size // 2 AND s.brow // 2 = t.brow AND s.bcol // 2 = t.bcol),
    leaf AS MATERIALIZED (SELECT bcol * size AS x, brow * size AS y, size::BIGINT AS size, 30 + 80 // size AS qp FROM t WHERE size = 8 OR NOT busy),
    cell AS MATERIALIZED (SELECT a.i AS cx, b.i AS cy, x, y, size, qp FROM leaf, unnest(range(x // 4, (x + size) // 4)) a(i), unnest(range(y // 4, (y + size) // 4)) b(i))"""

_TC = """[0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3, 4, 4, 4, 4, 5, 5, 5, 5, 7, 7, 8, 9, 10, 10, 11, 13, 14, 15, 17, 19, 21, 24, 25, 29, 33, 36, 41, 45, 51, 57, 64, 71, 80, 89, 100, 112, 125,
    141, 157, 177, 198, 222, 250, 280, 314, 352, 395]"""


def pass_sql(plane: str, out: str, tag: str, across: str, along: str) -> str:
    """Tables that end in ``out``(y, x, v): ``plane`` after the edges that lie between neighbours in ``across``."""
    side = lambda a, s, k: f"{a}[{8 - k if s == 'p' else 9 + k}]"
    bend = lambda a, s, k: f"abs({side(a, s, k + 2)} - 2 * {side(a, s, k + 1)} + {side(a, s, k)})"
    c_across, c_along = f"c{across}", f"c{along}"
    top = f"e % {CTU} = 0" if across == "y" else "false"

    def flat(a: str, s: str, large: str) -> str:
        near = f"abs({side(a, s, 3)} - {side(a, s, 0)})"
        return f"CASE WHEN {large} THEN ({near} + abs({side(a, s, 4)} - {side(a, s, 5)} - {side(a, s, 6)} + {side(a, s, 7)}) + abs({side(a, s, 3)} - {side(a, s, 7)}) + 1) >> 1 ELSE {near} END"

    def strong(a: str, d: str, lp: str, lq: str) -> str:
        return f"""({flat(a, 'p', lp)} + {flat(a, 'q', lq)} < CASE WHEN {lp} OR {lq} THEN (3 * beta) >> 5 ELSE beta >> 3 END AND 2 * ({d}) < CASE WHEN {lp} OR {lq} THEN beta >> 4 ELSE beta >> 2 END
            AND abs({side(a, 'p', 0)} - {side(a, 'q', 0)}) < (5 * tc + 1) >> 1)"""

    p, q = (lambda k: side("a", "p", k)), (lambda k: side("a", "q", k))
    near = lambda v, new, r: f"least(greatest({new}, {v} - {r}), {v} + {r})"
    cut = lambda v: f"least(255, greatest(0, {v}))"
    keep = lambda k: f"a[{k}]"
    weak, w_delta = [keep(k) for k in range(1, 17)], "least(tc, greatest(-tc, delta))"
    weak[7], weak[8] = cut(f"{p(0)} + {w_delta}"), cut(f"{q(0)} - {w_delta}")
    for at, a, b, c, sign, on in ((6, p(2), p(1), p(0), "+", "more_p"), (9, q(2), q(1), q(0), "-", "more_q")):
        weak[at] = f"CASE WHEN {on} THEN {cut(f'{b} + least(tc >> 1, greatest(-(tc >> 1), (((({a} + {c} + 1) >> 1) - {b} {sign} {w_delta}) >> 1)))')} ELSE {b} END"
    full = [keep(k) for k in range(1, 17)]
    for s, o, base, step in (("p", "q", 7, -1), ("q", "p", 8, 1)):
        a, b = (lambda k, s=s: side("a", s, k)), (lambda k, o=o: side("a", o, k))
        full[base] = near(a(0), f"(({a(2)} + 2 * {a(1)} + 2 * {a(0)} + 2 * {b(0)} + {b(1)} + 4) >> 3)", "3 * tc")
        full[base + step] = near(a(1), f"(({a(2)} + {a(1)} + {a(0)} + {b(0)} + 2) >> 2)", "2 * tc")
        full[base + 2 * step] = near(a(2), f"((2 * {a(3)} + 3 * {a(2)} + {a(1)} + {a(0)} + {b(0)} + 4) >> 3)", "tc")
    weight, reach = {3: [53, 32, 11], 7: [59, 50, 41, 32, 23, 14, 5]}, {3: [6, 4, 2], 7: [6, 5, 4, 3, 2, 1, 1]}

    def long(n_p: int, n_q: int) -> str:
        """Side p is counted from q0 on, as in the operator."""
        ref_p, ref_q = f"(({p(n_p - 2)} + {p(n_p - 1)} + 1) >> 1)", f"(({q(n_q - 1)} + {q(n_q)} + 1) >> 1)"
        drawn = lambda v, ref, n, k: near(v, f"((mid{n_p}{n_q} * {weight[n][k]} + {ref} * {64 - weight[n][k]} + 32) >> 6)", f"((tc * {reach[n][k]}) >> 1)")
        new = [keep(k) for k in range(1, 17)]
        for k in range(n_p):
            new[8 - k] = drawn(new[8 - k], ref_p, n_p, k)
        for k in range(n_q):
            new[8 + k] = drawn(new[8 + k], ref_q, n_q, k)
        return f"[{', '.join(new)}]"

    total = lambda weights: " + ".join(f"{w} * {s}" for s, w in weights)
    mids = {
        77: total([(f(k), 2 if k == 0 else 1) for k in range(7) for f in (p, q)]),
        73: total([(p(0), 2), (q(0), 3), (q(1), 3), (q(2), 2), *((p(k), 1) for k in range(1, 7))]),
        37: total([(q(0), 2), (p(0), 3), (p(1), 3), (p(2), 2), *((q(k), 1) for k in range(1, 7))]),
    }
    d_long = lambda a: " + ".join(f"CASE WHEN l{s} THEN ({bend(a, s, 0)} + {bend(a, s, 3)} + 1) >> 1 ELSE {bend(a, s, 0)} END" for s in "pq")
    d = lambda a: f"{bend(a, 'p', 0)} + {bend(a, 'q', 0)}"
    return f"""
    seg{tag} AS (SELECT q.{c_across} * 4 AS e, q.{c_along} AS g, p.size AS sp, q.size AS sq, (p.qp + q.qp + 1) >> 1 AS qp FROM cell q JOIN cell p ON p.{c_along} = q.{c_along} AND p.{c_across} = q.{c_across} - 1 WHERE q.{across} = q.{c_across} * 4),
    line{tag} AS MATERIALIZED (SELECT e, g, any_value(sp) AS sp, any_value(sq) AS sq, any_value(qp) AS qp, {along} AS k, list(v ORDER BY {across}) AS a FROM seg{tag} JOIN {plane} ON {along} // 4 = g AND {across} BETWEEN e - 8 AND e + 7 GROUP BY e, g, {along}),
    end{tag} AS (SELECT f.e, f.g, f.a AS f, t.a AS l, (({_TC})[least(65, greatest(0, f.qp + 2)) + 1] + 2) >> 2 AS tc, CASE WHEN f.qp < 16 THEN 0 WHEN f.qp <= 28 THEN f.qp - 10 ELSE 2 * f.qp - 38 END AS beta,
        f.sp >= 32 AND NOT ({top.replace('e %', 'f.e %')}) AS lp, f.sq >= 32 AS lq FROM line{tag} f JOIN line{tag} t ON f.e = t.e AND f.g = t.g AND f.k % 4 = 0 AND t.k % 4 = 3),
    dec{tag} AS (SELECT e, g, tc, lp, lq, CASE WHEN (lp OR lq) AND {d_long('f')} + {d_long('l')} < beta AND {strong('f', d_long('f'), 'lp', 'lq')} AND {strong('l', d_long('l'), 'lp', 'lq')} THEN 3 WHEN {d('f')} + {d('l')} >= beta THEN 0
        WHEN {strong('f', d('f'), 'false', 'false')} AND {strong('l', d('l'), 'false', 'false')} THEN 2 ELSE 1 END AS mode,
        {bend('f', 'p', 0)} + {bend('l', 'p', 0)} < (beta + (beta >> 1)) >> 3 AS more_p, {bend('f', 'q', 0)} + {bend('l', 'q', 0)} < (beta + (beta >> 1)) >> 3 AS more_q FROM end{tag}),
    mid{tag} AS (SELECT e, g, k, a, tc, lp, lq, mode, more_p, more_q, (9 * ({q(0)} - {p(0)}) - 3 * ({q(1)} - {p(1)}) + 8) >> 4 AS delta, {', '.join(f'({m} + 8) >> 4 AS mid{n}' for n, m in mids.items())} FROM line{tag} JOIN dec{tag} USING (e, g)),
    new{tag} AS (SELECT e, k, a, CASE WHEN mode = 1 AND abs(delta) < 10 * tc THEN [{', '.join(weak)}] WHEN mode = 2 THEN [{', '.join(full)}] WHEN mode = 3 AND lp AND lq THEN {long(7, 7)} WHEN mode = 3 AND lp THEN {long(7, 3)} WHEN mode = 3 THEN {long(3, 7)} ELSE a END AS n FROM mid{tag}),
    out{tag} AS (SELECT e - 9 + i AS {across}, k AS {along}, n[i] AS n FROM new{tag}, range(1, 17) r(i) WHERE n[i] <> a[i]),
    {out} AS MATERIALIZED (SELECT y, x, coalesce(n, v)::BIGINT AS v FROM {plane} LEFT JOIN out{tag} USING (y, x))"""


@query("deblock_luma", f"WITH RECURSIVE {planes.plane_sql(8)}, {AREAS}, {LEAVES}, {pass_sql('area', 'once', 'v', 'x', 'y')}, {pass_sql('once', 'twice', 'h', 'y', 'x')} SELECT y, x, v FROM twice")
def deblock_luma(spark, sf_dir):
    rows = tempered(rows_of(spark, sf_dir, 8))
    return planes.samples(deblock.deblocked(rows, leaves(rows), planes.WIDTH, CTU))


def chroma_pass_sql(plane: str, out: str, tag: str, across: str, along: str) -> str:
    """Tables that end in ``out``(y, x, v): the chroma ``plane`` after the edges between luma neighbours in ``across`` that lie on its grid of eight."""
    p, q = (lambda k, a="a": f"{a}[{4 - k}]"), (lambda k, a="a": f"{a}[{5 + k}]")
    ctb = f"e % {CTU // 2} = 0" if across == "y" else "false"
    bend = lambda a: f"CASE WHEN ctb THEN abs({p(0, a)} - {p(1, a)}) ELSE abs({p(2, a)} - 2 * {p(1, a)} + {p(0, a)}) END + abs({q(2, a)} - 2 * {q(1, a)} + {q(0, a)})"
    flat = lambda a: f"(CASE WHEN ctb THEN abs({p(1, a)} - {p(0, a)}) ELSE abs({p(3, a)} - {p(0, a)}) END + abs({q(3, a)} - {q(0, a)}) < beta >> 3 AND 2 * ({bend(a)}) < beta >> 2 AND abs({p(0, a)} - {q(0, a)}) < (5 * tc + 1) >> 1)"
    near = lambda v, new: f"least(greatest(({new} + 4) >> 3, {v} - tc), {v} + tc)"
    delta = f"least(tc, greatest(-tc, (4 * ({q(0)} - {p(0)}) + {p(1)} - {q(1)} + 4) >> 3))"
    weak = f"[{p(3)}, {p(2)}, {p(1)}, least(255, greatest(0, {p(0)} + {delta})), least(255, greatest(0, {q(0)} - {delta})), {q(1)}, {q(2)}, {q(3)}]"
    q1, q2 = near(q(1), f"{p(1)} + {p(0)} + {q(0)} + 2 * {q(1)} + {q(2)} + 2 * {q(3)}"), near(q(2), f"{p(0)} + {q(0)} + {q(1)} + 2 * {q(2)} + 3 * {q(3)}")
    low = f"[{p(3)}, {p(2)}, {p(1)}, {near(p(0), f'3 * {p(1)} + 2 * {p(0)} + {q(0)} + {q(1)} + {q(2)}')}, {near(q(0), f'2 * {p(1)} + {p(0)} + 2 * {q(0)} + {q(1)} + {q(2)} + {q(3)}')}, {q1}, {q2}, {q(3)}]"
    full = f"""[{p(3)}, {near(p(2), f'3 * {p(3)} + 2 * {p(2)} + {p(1)} + {p(0)} + {q(0)}')}, {near(p(1), f'2 * {p(3)} + {p(2)} + 2 * {p(1)} + {p(0)} + {q(0)} + {q(1)}')}, {near(p(0), f'{p(3)} + {p(2)} + {p(1)} + 2 * {p(0)} + {q(0)} + {q(1)} + {q(2)}')},
        {near(q(0), f'{p(2)} + {p(1)} + {p(0)} + 2 * {q(0)} + {q(1)} + {q(2)} + {q(3)}')}, {q1}, {q2}, {q(3)}]"""
    return f"""
    cs{tag} AS (SELECT q.c{across} * 2 AS e, q.c{along} AS g, p.size >= 16 AND q.size >= 16 AS large, (p.qp + q.qp + 1) >> 1 AS qp FROM cell q JOIN cell p ON p.c{along} = q.c{along} AND p.c{across} = q.c{across} - 1 WHERE q.{across} = q.c{across} * 4 AND q.c{across} % 4 = 0),
    cl{tag} AS MATERIALIZED (SELECT e, g, {ctb} AS ctb, any_value(large) AS large, any_value(qp) AS qp, {along} AS k, list(v ORDER BY {across}) AS a FROM cs{tag} JOIN {plane} ON {along} // 2 = g AND {across} BETWEEN e - 4 AND e + 3 GROUP BY e, g, {along}),
    ct{tag} AS (SELECT *, (({_TC})[least(65, greatest(0, qp + 2)) + 1] + 2) >> 2 AS tc, CASE WHEN qp < 16 THEN 0 WHEN qp <= 28 THEN qp - 10 ELSE 2 * qp - 38 END AS beta FROM cl{tag}),
    cd{tag} AS (SELECT e, g, large AND {bend('f')} + {bend('l')} < beta AND {flat('f')} AND {flat('l')} AS strong FROM (SELECT e, g, ctb, large, tc, beta, a AS f FROM ct{tag} WHERE k % 2 = 0) m JOIN (SELECT e, g, a AS l FROM ct{tag} WHERE k % 2 = 1) t USING (e, g)),
    cn{tag} AS (SELECT e, k, a, CASE WHEN NOT strong THEN {weak} WHEN ctb THEN {low} ELSE {full} END AS n FROM ct{tag} JOIN cd{tag} USING (e, g)),
    co{tag} AS (SELECT e - 5 + i AS {across}, k AS {along}, n[i] AS n FROM cn{tag}, range(1, 9) r(i) WHERE n[i] <> a[i]),
    {out} AS MATERIALIZED (SELECT y, x, coalesce(n, v)::BIGINT AS v FROM {plane} LEFT JOIN co{tag} USING (y, x))"""


@query(
    "deblock_chroma",
    f"WITH RECURSIVE {planes.plane_sql(8)}, {AREAS}, {LEAVES}, small AS (SELECT y // 2 AS y, x // 2 AS x, v FROM area WHERE y % 2 = 0 AND x % 2 = 0), {chroma_pass_sql('small', 'once', 'v', 'x', 'y')}, {chroma_pass_sql('once', 'twice', 'h', 'y', 'x')} SELECT y, x, v FROM twice",
)
def deblock_chroma(spark, sf_dir):
    """Every second sample of every second row as a chroma plane, with the leaves of the whole one."""
    rows = tempered(rows_of(spark, sf_dir, 8))
    small = rows.where("y % 2 = 0").select(F.expr("y div 2").alias("y"), F.expr("filter(row, (v, x) -> x % 2 = 0)").alias("row"))
    return planes.samples(deblock.chroma_deblocked(small, leaves(rows), planes.WIDTH // 2, CTU))
