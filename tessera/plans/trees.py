"""Queries that walk the coding tree, with recursive DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import walk
from ..sources import planes
from .catalogue import query, rows_of
from .filters import AREAS, LEAF_QP, tempered

#: Sums over all samples above and left of a place, as lists by place, and the height in the same row.
SUMS = f"""d AS (SELECT y, x, v, coalesce(abs(lead(v) OVER (PARTITION BY y ORDER BY x) - v), 0) AS gx, coalesce(abs(lead(v) OVER (PARTITION BY x ORDER BY y) - v), 0) AS gy FROM area),
    p AS (SELECT y, x, sum(v) OVER r AS a, sum(v * v) OVER r AS b, sum(gx) OVER r AS gx, sum(gy) OVER r AS gy FROM d WINDOW r AS (PARTITION BY y ORDER BY x)),
    i AS (SELECT y, x, sum(a) OVER c AS a, sum(b) OVER c AS b, sum(gx) OVER c AS gx, sum(gy) OVER c AS gy FROM p WINDOW c AS (PARTITION BY x ORDER BY y)),
    pic AS MATERIALIZED (SELECT {', '.join(f"list({c}::BIGINT ORDER BY y, x) AS sum_{c}" for c in ('a', 'b', 'gx', 'gy'))}, max(y) + 1 AS ph FROM i)"""
PARTS = """kids(split, k, ax, ay, aw, ah) AS (VALUES ('quad', 0, 0, 0, 2, 2), ('quad', 1, 2, 0, 2, 2), ('quad', 2, 0, 2, 2, 2), ('quad', 3, 2, 2, 2, 2), ('bin_h', 0, 0, 0, 4, 2), ('bin_h', 1, 0, 2, 4, 2), ('bin_v', 0, 0, 0, 2, 4), ('bin_v', 1, 2, 0, 2, 4),
    ('tri_h', 0, 0, 0, 4, 1), ('tri_h', 1, 0, 1, 4, 2), ('tri_h', 2, 0, 3, 4, 1), ('tri_v', 0, 0, 0, 1, 4), ('tri_v', 1, 1, 0, 2, 4), ('tri_v', 2, 3, 0, 1, 4))"""


def area(name: str, right: str, low: str) -> str:
    at = lambda y, x: f"CASE WHEN {y} = 0 OR {x} = 0 THEN 0 ELSE sum_{name}[({y} - 1) * {planes.WIDTH} + {x}] END"
    return f"({at(low, right)} - ({at('y', right)}) - ({at(low, 'x')}) + ({at('y', 'x')}))"


def decided(nodes: str, least: int, luma: bool, forced_to: int = 1024) -> str:
    """The rows of ``nodes`` with the split of each."""
    min_qt, depth, most = (16, 2, 32) if luma else (64, 0, 64)
    small = {"quad": f"least(w, h) < {2 * least}", "bin_v": f"w < {2 * least}", "bin_h": f"h < {2 * least}", "tri_v": f"w < {4 * least}", "tri_h": f"h < {4 * least}"}
    even = ("quad", "bin_v", "bin_h", "tri_v", "tri_h")
    first = lambda order: "coalesce(" + ", ".join(f"CASE WHEN {s} AND NOT ({small[s]}) THEN '{s}' END" for s in order.split()) + ")"
    across, down = first("bin_v tri_v quad bin_h tri_h"), first("bin_h tri_h quad bin_v tri_v")
    usable = f"CASE WHEN w >= 2 * h THEN {across} WHEN h >= 2 * w THEN {down} WHEN gx * 4 > gy * 5 THEN {across} WHEN gy * 4 > gx * 5 THEN {down} ELSE {first(' '.join(even))} END"
    legal = ", ".join(f"CASE WHEN {s} THEN '{s}' END" for s in even)
    if luma:
        choice = f"CASE WHEN stay AND b // n - (a // n) * (a // n) < {64 + LEAF_QP * LEAF_QP} THEN 'none' ELSE coalesce({usable}, CASE WHEN stay THEN 'none' END, {legal}, 'none') END"
    else:
        legal = ", ".join(f"CASE WHEN {s} THEN '{s}' END" for s in ("quad", "bin_h", "bin_v", "tri_h", "tri_v"))
        choice = f"CASE WHEN forced = 'none' THEN 'none' ELSE coalesce({legal}) END"
    return f"""SELECT x, y, w, h, qt, mt, bt, im, last, part, path, tid, forced, CASE WHEN greatest(w, h) > {forced_to} THEN 'quad' ELSE {choice} END AS split FROM (
      SELECT *, forced = 'none' AND greatest(w, h) <= 64 AS stay, (last IN ('none', 'quad') AND w > {min_qt}) OR forced = 'quad' AS quad,
        forced = 'bin_h' OR (forced = 'none' AND mt < {depth} + im AND greatest(w, h) BETWEEN 5 AND {most} AND h > 4 AND NOT (last = 'tri_h' AND part = 1)) AS bin_h,
        forced = 'bin_v' OR (forced = 'none' AND mt < {depth} + im AND greatest(w, h) BETWEEN 5 AND {most} AND w > 4 AND NOT (last = 'tri_v' AND part = 1)) AS bin_v,
        forced = 'none' AND mt < {depth} + im AND greatest(w, h) <= {most} AND h > 8 AS tri_h, forced = 'none' AND mt < {depth} + im AND greatest(w, h) <= {most} AND w > 8 AS tri_v,
        (xe - x) * (ye - y) AS n, {area('a', 'xe', 'ye')} AS a, {area('b', 'xe', 'ye')} AS b, {area('gx', '(xe - 1)', 'ye')} AS gx, {area('gy', 'xe', '(ye - 1)')} AS gy FROM (
      SELECT *, least(x + w, {planes.WIDTH}) AS xe, least(y + h, ph) AS ye, CASE WHEN y + h <= ph AND x + w <= {planes.WIDTH} THEN 'none' WHEN y + h > ph AND x + w > {planes.WIDTH} AND least(w, h) > {min_qt} AND bt = 0 THEN 'quad'
        WHEN y + h > ph AND greatest(w, h) <= {most} AND mt < {depth} + im THEN 'bin_h' WHEN x + w > {planes.WIDTH} AND greatest(w, h) <= {most} AND mt < {depth} + im THEN 'bin_v' ELSE 'quad' END AS forced FROM ({nodes}), pic))"""


def walk_sql(name: str, least: int, luma: bool, forced_to: int = 1024) -> str:
    root = f"SELECT (i % {-(-planes.WIDTH // 128)}) * 128 AS x, (i // {-(-planes.WIDTH // 128)}) * 128 AS y, 128::BIGINT AS w, 128::BIGINT AS h, 0 AS qt, 0 AS mt, 0 AS bt, 0 AS im, 'none' AS last, 0 AS part, '' AS path, i AS tid FROM (SELECT unnest(range(0, (ph + 127) // 128 * {-(-planes.WIDTH // 128)})) AS i FROM pic)"
    parts = f"""SELECT x + w * ax // 4 AS x, y + h * ay // 4 AS y, w * aw // 4 AS w, h * ah // 4 AS h, qt + (split = 'quad')::INTEGER AS qt, CASE WHEN split = 'quad' THEN 0 ELSE mt + 1 END AS mt,
        CASE WHEN split = 'quad' THEN 0 WHEN split LIKE 'bin%' THEN bt + 1 ELSE bt + 2 END AS bt, im + (split LIKE 'bin%' AND forced <> 'none')::INTEGER AS im, split AS last, k AS part, path || k AS path, tid FROM {name} JOIN kids USING (split)"""
    return f"{name} AS ({decided(root, least, luma, forced_to)} UNION ALL {decided(f'SELECT q.* FROM ({parts}) q, pic WHERE x < {planes.WIDTH} AND y < ph', least, luma, forced_to)})"


_LEAF = "x, y, w, h, qt::BIGINT AS qt_depth, mt::BIGINT AS mt_depth, path"


@query("split_walk", f"WITH RECURSIVE {planes.plane_sql(8)}, {AREAS}, {SUMS}, {PARTS}, {walk_sql('t', 8, True)} SELECT {_LEAF}, row_number() OVER (PARTITION BY tid ORDER BY path) - 1 AS seq FROM t WHERE split = 'none'")
def split_walk(spark, sf_dir):
    rows = tempered(rows_of(spark, sf_dir, 8))
    found = walk.walked(walk.cells(rows, planes.WIDTH, 128), planes.WIDTH, rows.agg(F.max("y") + 1), LEAF_QP)
    return walk.in_order(found).select("x", "y", "w", "h", "qt_depth", "mt_depth", "path", "seq")


@query(
    "split_walk_dual",
    f"""WITH RECURSIVE {planes.plane_sql(8)}, {AREAS}, {SUMS}, {PARTS}, {walk_sql('t', 4, True, 64)}, {walk_sql('u', 4, False, 64)},
    o AS (SELECT *, 'luma' AS tree FROM t UNION ALL SELECT *, 'chroma' AS tree FROM u)
    SELECT {_LEAF}, tree, row_number() OVER (PARTITION BY tid ORDER BY path[1], tree DESC, path) - 1 AS seq FROM o WHERE split = 'none'""",
)
def split_walk_dual(spark, sf_dir):
    rows = tempered(rows_of(spark, sf_dir, 8))
    found = walk.dual(walk.cells(rows, planes.WIDTH, 128), planes.WIDTH, rows.agg(F.max("y") + 1), LEAF_QP)
    return found.select("x", "y", "w", "h", "qt_depth", "mt_depth", "path", "tree", "seq")
