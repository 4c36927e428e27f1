"""Queries on the coding tree, luma prediction, references, readers, contexts, plane layouts and metadata, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, metadata
from ..functions import samples as s
from ..operators import neighbours, partition, prediction, rates, states, transforms
from ..sources import planes
from .catalogue import KEYS, QP, REFS, SHAPES, best_of, dequant_sql, forward_sql, quant_sql, query, references, rows_of, scan_sql, shapes

WIDTH, HEIGHT = 512, 256
NODES = """n AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 40) * (4 << (l_suppkey % 6)::INTEGER) AS x, ((l_linenumber * 7 + l_partkey) % 20) * (4 << (l_partkey % 6)::INTEGER) AS y, (4 << (l_suppkey % 6)::INTEGER)::BIGINT AS w, (4 << (l_partkey % 6)::INTEGER)::BIGINT AS h,
    l_orderkey % 4 AS qt_depth, l_partkey % 4 AS mt_depth, l_suppkey % 3 AS bt_depth, l_orderkey % 2 AS implicit, ['none', 'quad', 'bin_h', 'bin_v', 'tri_h', 'tri_v'][(l_orderkey % 6)::INTEGER + 1] AS last, (l_linenumber % 3)::BIGINT AS part FROM lineitem)"""
OUT = "low AS (SELECT *, x >= 512 OR y + h > 256 AS lo, y >= 256 OR x + w > 512 AS ri, w <= 32 AND h <= 32 AND mt_depth < 2 + implicit AS bt FROM n)"
FORCED = """f AS (SELECT *, CASE WHEN NOT lo AND NOT ri THEN 'none' WHEN lo AND ri AND w > 16 AND h > 16 AND bt_depth = 0 THEN 'quad' WHEN lo AND bt AND w <= 64 THEN 'bin_h' WHEN ri AND bt AND h <= 64 THEN 'bin_v' ELSE 'quad' END AS forced FROM low)"""
ALLOWED = """a AS (SELECT *, forced = 'none' AS may_none,
    CASE WHEN forced = 'none' THEN last IN ('none', 'quad') AND w > 16 ELSE (last IN ('none', 'quad') AND w > 16) OR forced = 'quad' END AS may_quad,
    CASE WHEN forced <> 'none' THEN forced = 'bin_h' ELSE mt_depth < 2 + implicit AND w <= 32 AND h <= 32 AND h > 4 AND NOT (last = 'tri_h' AND part = 1) END AS may_bin_h,
    CASE WHEN forced <> 'none' THEN forced = 'bin_v' ELSE mt_depth < 2 + implicit AND w <= 32 AND h <= 32 AND w > 4 AND NOT (last = 'tri_v' AND part = 1) END AS may_bin_v,
    forced = 'none' AND mt_depth < 2 + implicit AND w <= 32 AND h <= 32 AND h > 8 AS may_tri_h,
    forced = 'none' AND mt_depth < 2 + implicit AND w <= 32 AND h <= 32 AND w > 8 AS may_tri_v FROM f)"""
STATE = ("x", "y", "w", "h", "qt_depth", "mt_depth", "bt_depth", "implicit", "last", "part")


def nodes(spark, sf_dir) -> DataFrame:
    """Nodes of a coding tree drawn from the keys of ``lineitem``, many of them across the edge of a 512 x 256 picture."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda c: F.pow(F.lit(2.0), F.col(c) % 6 + 2).cast("bigint")
    last = F.element_at(F.array(*map(F.lit, partition.SPLITS)), (F.col("l_orderkey") % 6).cast("int") + 1)
    return t.select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 40 * side("l_suppkey")).alias("x"), ((F.col("l_linenumber") * 7 + F.col("l_partkey")) % 20 * side("l_partkey")).alias("y"), side("l_suppkey").alias("w"), side("l_partkey").alias("h"),
        (F.col("l_orderkey") % 4).alias("qt_depth"), (F.col("l_partkey") % 4).alias("mt_depth"), (F.col("l_suppkey") % 3).alias("bt_depth"), (F.col("l_orderkey") % 2).alias("implicit"), last.alias("last"), (F.col("l_linenumber") % 3).cast("bigint").alias("part"),
    )


def state() -> dict:
    return {c: F.col(c) for c in STATE}


@query("split_forced", f"WITH {NODES}, {OUT}, {FORCED} SELECT l_orderkey, l_linenumber, forced FROM f")
def split_forced(spark, sf_dir):
    return nodes(spark, sf_dir).select("l_orderkey", "l_linenumber", partition.forced_split(state(), WIDTH, HEIGHT).alias("forced"))


def with_allowed(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir).withColumn("forced", partition.forced_split(state(), WIDTH, HEIGHT))
    return n.withColumns({f"may_{k}": c for k, c in partition.allowed_splits(state(), F.col("forced")).items()})


_MAY = [f"may_{k}" for k in partition.SPLITS]


@query("split_allowed", f"WITH {NODES}, {OUT}, {FORCED}, {ALLOWED} SELECT l_orderkey, l_linenumber, {', '.join(_MAY)} FROM a")
def split_allowed(spark, sf_dir):
    return with_allowed(spark, sf_dir).select("l_orderkey", "l_linenumber", *_MAY)


@query(
    "split_children",
    f"""WITH {NODES}, {OUT}, {FORCED}, c AS (SELECT *, CASE WHEN forced <> 'none' THEN forced ELSE last END AS split FROM f),
    g(split, k, ax, ay, aw, ah) AS (VALUES ('none', 0, 0, 0, 4, 4), ('quad', 0, 0, 0, 2, 2), ('quad', 1, 2, 0, 2, 2), ('quad', 2, 0, 2, 2, 2), ('quad', 3, 2, 2, 2, 2), ('bin_h', 0, 0, 0, 4, 2), ('bin_h', 1, 0, 2, 4, 2), ('bin_v', 0, 0, 0, 2, 4), ('bin_v', 1, 2, 0, 2, 4),
        ('tri_h', 0, 0, 0, 4, 1), ('tri_h', 1, 0, 1, 4, 2), ('tri_h', 2, 0, 3, 4, 1), ('tri_v', 0, 0, 0, 1, 4), ('tri_v', 1, 1, 0, 2, 4), ('tri_v', 2, 3, 0, 1, 4))
    SELECT l_orderkey, l_linenumber, k::BIGINT AS part, (x + w * ax // 4)::BIGINT AS x, (y + h * ay // 4)::BIGINT AS y, (w * aw // 4)::BIGINT AS w, (h * ah // 4)::BIGINT AS h, split AS last,
        (qt_depth + (split = 'quad')::INTEGER)::BIGINT AS qt_depth, (CASE split WHEN 'quad' THEN 0 WHEN 'none' THEN mt_depth ELSE mt_depth + 1 END)::BIGINT AS mt_depth,
        (CASE WHEN split = 'quad' THEN 0 WHEN split LIKE 'bin%' THEN bt_depth + 1 WHEN split LIKE 'tri%' THEN bt_depth + 2 ELSE bt_depth END)::BIGINT AS bt_depth,
        (implicit + (forced LIKE 'bin%')::INTEGER)::BIGINT AS implicit FROM c JOIN g USING (split)""",
)
def split_children(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("forced", partition.forced_split(state(), WIDTH, HEIGHT))
    split = F.when(F.col("forced") != "none", F.col("forced")).otherwise(F.col("last"))
    parts = n.select("l_orderkey", "l_linenumber", F.explode(partition.children(state(), split, F.col("forced") != "none")).alias("c"))
    return parts.select("l_orderkey", "l_linenumber", "c.*")


@query(
    "split_contexts",
    f"""WITH {NODES}, {OUT}, {FORCED}, {ALLOWED}, b AS (SELECT *, CASE WHEN x > 0 THEN 4 << (l_linenumber % 6) END AS lh, CASE WHEN x > 0 THEN l_linenumber % 5 END AS ld, CASE WHEN y > 0 THEN 4 << (l_orderkey % 5)::INTEGER END AS aw, CASE WHEN y > 0 THEN l_orderkey % 5 END AS ad,
        2 * may_quad::INTEGER + may_bin_h::INTEGER + may_bin_v::INTEGER + may_tri_h::INTEGER + may_tri_v::INTEGER AS choices, may_bin_v::INTEGER + may_tri_v::INTEGER AS ver, may_bin_h::INTEGER + may_tri_h::INTEGER AS hor FROM a)
    SELECT l_orderkey, l_linenumber, (coalesce(lh < h, false)::INTEGER + coalesce(aw < w, false)::INTEGER + 3 * (greatest(choices - 1, 0) // 2))::INTEGER AS ctx_split,
        (coalesce(ld > qt_depth, false)::INTEGER + coalesce(ad > qt_depth, false)::INTEGER + CASE WHEN qt_depth >= 2 THEN 3 ELSE 0 END)::INTEGER AS ctx_quad,
        (CASE WHEN ver < hor THEN 3 WHEN ver > hor THEN 4 WHEN lh IS NULL OR aw IS NULL OR w // aw = h // lh THEN 0 WHEN w // aw < h // lh THEN 1 ELSE 2 END)::INTEGER AS ctx_vertical,
        (mt_depth <= 1)::INTEGER AS ctx_half_h, CASE WHEN mt_depth <= 1 THEN 3 ELSE 2 END AS ctx_half_v FROM b""",
)
def split_contexts(spark, sf_dir):
    n = with_allowed(spark, sf_dir)
    power = lambda e: F.pow(F.lit(2.0), e + 2).cast("bigint")
    left, above = (lambda c: F.when(F.col("x") > 0, c)), (lambda c: F.when(F.col("y") > 0, c))
    found = partition.split_contexts(state(), {k: F.col(f"may_{k}") for k in partition.SPLITS}, left(power(F.col("l_linenumber") % 6)), left(F.col("l_linenumber") % 5), above(power(F.col("l_orderkey") % 5)), above(F.col("l_orderkey") % 5))
    return n.select("l_orderkey", "l_linenumber", *[c.cast("int").alias(k) for k, c in found.items()])


@query(
    "tree_fields",
    "SELECT p_partkey, unnest(['min_qt', 'depth', 'max_bt', 'max_tt']) AS field, unnest([k + 1, p_size % 4, p_size % 3, k % 2])::BIGINT AS value FROM (SELECT *, p_partkey % 3 AS k FROM part)",
)
def tree_fields(spark, sf_dir):
    """Limits drawn from each part as sides, and what a header says of them."""
    power = lambda e: F.pow(F.lit(2.0), e).cast("bigint")
    k = F.col("p_partkey") % 3
    limits = partition.Limits(power(k + 3), F.col("p_size") % 4, power(k + 3 + F.col("p_size") % 3), power(k + 3 + k % 2))
    fields = partition.header_fields(limits)
    every = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("bigint").alias("value")) for n, c in fields.items()])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.inline(every))


_SLOPES, _CUBIC = list(prediction.SLOPES), [list(c) for c in prediction.CUBIC]
_INVERSE = "CASE WHEN sl = 0 THEN 0 ELSE round(16384 / sl)::BIGINT END"


@query(
    "intra_params",
    f"""WITH g AS ({SHAPES}),
    k AS (SELECT *, CASE WHEN m > 1 AND w > h AND m < 2 + e THEN m + 65 WHEN m > 1 AND h > w AND m > 66 - e THEN m - 65 ELSE m END AS r FROM g),
    t AS (SELECT *, CASE WHEN r >= 34 THEN r - 50 ELSE 18 - r END AS t, CASE WHEN r >= 34 THEN q ELSE p END AS side FROM k),
    u AS (SELECT *, {_SLOPES}[(abs(t) + 1)::INTEGER] AS sl FROM t), v AS (SELECT *, {_INVERSE} AS inv FROM u),
    x AS (SELECT *, least(2, side - (length(bin(greatest(1, 3 * inv - 2))) - 1) + 8) AS sc, least(abs(r - 18), abs(r - 50)) > [24, 24, 24, 14, 2, 0, 0, 0][((p + q) // 2 + 1)::INTEGER] AS far FROM v)
    SELECT l_orderkey, l_linenumber, w, h, m AS mode, CASE m WHEN 0 THEN w * h > 32 WHEN 1 THEN false ELSE far AND sl % 32 = 0 END AS smooth_refs, m > 1 AND far AND sl % 32 <> 0 AS smooth_taps,
        m <= 1 OR t = 0 OR (t > 0 AND sc >= 0) AS blended, (CASE WHEN m > 1 AND t > 0 THEN sc ELSE 0 END)::BIGINT AS scale FROM x""",
)
def intra_params(spark, sf_dir):
    """How a mode predicts a block, for shapes and modes drawn from ``lineitem``."""
    from ..operators import modes

    g = shapes(spark, sf_dir)
    angle = modes.wide_angle(F.col("w"), F.col("h"), F.col("mode")).cast("bigint")
    p = prediction.parameters(F.col("mode"), angle, F.col("w"), F.col("h"))
    return g.select(*KEYS, "w", "h", "mode", *[(c.cast("bigint") if k == "scale" else c).alias(k) for k, c in p.items()])


def luma_sql(n: int) -> str:
    """Tables that end in pr(id, m, j, i, line, p): the luma prediction of every mode for the n x n block of each row."""
    log = n.bit_length() - 1
    far, scale = prediction.SMOOTHED_FROM[log], (2 * log - 2) >> 2
    tap = f"CASE WHEN wh + al + {{0}} >= 0 THEN mn[least(wh + al + {{0}}, {2 * n}) + 1] ELSE sd[least({n}, ((-(wh + al + {{0}})) * inv + 256) >> 9) + 1] END"
    smooth = lambda a: f"[(2 * top[1] + top[2] + lft[2] + 2) >> 2] || list_transform(range(2, {2 * n + 1}), lambda k: ({a}[k - 1] + 2 * {a}[k] + {a}[k + 1] + 2) >> 2) || [{a}[{2 * n + 1}]]"
    near = lambda p, sc: f"(32 >> least(31, (2 * {p}) >> {sc}))"
    return f"""{REFS}, sm AS (SELECT y AS id, t AS line, top, lft, {smooth('top')} AS ft, {smooth('lft')} AS fl FROM refs),
    t0 AS (SELECT m, CASE WHEN m >= 34 THEN m - 50 ELSE 18 - m END AS t, least(abs(m - 18), abs(m - 50)) > {far} AS far FROM range(0, 67) r(m)),
    t1 AS (SELECT *, {_SLOPES}[(abs(t) + 1)::INTEGER] AS sl FROM t0), t2 AS (SELECT *, {_INVERSE} AS inv FROM t1),
    t3 AS (SELECT *, CASE m WHEN 0 THEN {str(n * n > 32).lower()} WHEN 1 THEN false ELSE far AND sl % 32 = 0 END AS sref, far AND sl % 32 <> 0 AS stap, least(2, {log + 8} - (length(bin(greatest(1, 3 * inv - 2))) - 1)) AS sc FROM t2),
    c AS (SELECT id, line, m, t, sl, inv, stap, sc, j, i, CASE WHEN sref THEN ft ELSE top END AS tp, CASE WHEN sref THEN fl ELSE lft END AS lf FROM sm, t3, range(0, {n}) a(j), range(0, {n}) b(i)),
    d AS (SELECT *, CASE WHEN m >= 34 THEN tp ELSE lf END AS mn, CASE WHEN m >= 34 THEN lf ELSE tp END AS sd, CASE WHEN m >= 34 THEN i ELSE j END AS al, CASE WHEN m >= 34 THEN j ELSE i END AS ac FROM c),
    e AS (SELECT *, (sign(t)::BIGINT * sl * (ac + 1)) >> 5 AS wh, (sign(t)::BIGINT * sl * (ac + 1)) & 31 AS fr FROM d),
    q AS (SELECT *, CASE WHEN stap THEN [16 - fr // 2, 32 - fr // 2, 16 + fr // 2, fr // 2] ELSE {_CUBIC}[(fr + 1)::INTEGER] END AS f, {', '.join(f'{tap.format(k)} AS p{k}' for k in range(4))} FROM e),
    v AS (SELECT *, CASE WHEN sl % 32 = 0 THEN p1 ELSE least(255, greatest(0, (f[1] * p0 + f[2] * p1 + f[3] * p2 + f[4] * p3 + 32) >> 6)) END AS v FROM q),
    w AS (SELECT *, CASE WHEN m = 0 THEN (({n - 1} - i) * lf[j + 2] + (i + 1) * tp[{n + 1}] + ({n - 1} - j) * tp[i + 2] + (j + 1) * lf[{n + 1}]) * {n} + {n * n} >> {1 + 2 * log} ELSE (list_sum(tp[2:{n + 1}])::BIGINT + list_sum(lf[2:{n + 1}])::BIGINT + {n}) >> {log + 1} END AS w FROM v),
    pr AS (SELECT id, m, j, i, line, (CASE WHEN m <= 1 THEN w + (({near('i', scale)} * (lf[j + 2] - w) + {near('j', scale)} * (tp[i + 2] - w) + 32) >> 6)
        WHEN t = 0 AND al < {3 << scale} THEN least(255, greatest(0, v + (({near('al', scale)} * (sd[ac + 2] - mn[1]) + 32) >> 6)))
        WHEN t > 0 AND sc >= 0 AND al < (3 << greatest(sc, 0)) THEN v + (({near('al', 'greatest(sc, 0)')} * (sd[least({2 * n}, ac + 1 + ((256 + (al + 1) * inv) >> 9)) + 1] - v) + 32) >> 6) ELSE v END)::BIGINT AS p FROM w)"""


@query("pred_luma", f"WITH {luma_sql(8)} SELECT id, m AS mode, sum(p)::BIGINT AS total, sum(p * (j * 8 + i + 1))::BIGINT AS weighted, min(p)::BIGINT AS least, max(p)::BIGINT AS most FROM pr GROUP BY ALL")
def pred_luma(spark, sf_dir):
    """Every luma mode of an 8 x 8 block out of each row; of its 64 samples two sums and the ends."""
    p = prediction.luma(references(spark, sf_dir).drop("row").repartition("id"), 8)  # blocks are dealt out before their samples, so no sum shuffles
    return p.groupBy("id", "mode").agg(F.sum("p").alias("total"), F.sum(F.col("p") * (F.col("y") * 8 + F.col("x") + 1)).alias("weighted"), F.min("p").alias("least"), F.max("p").alias("most"))


_SIGNS = ", ".join(f"({k}, {n}, {1 - 2 * (bin(k & n).count('1') % 2)})" for k in range(4) for n in range(4))


@query(
    "mode_search",
    f"""WITH {luma_sql(4)}, hm(k, n, s) AS (VALUES {_SIGNS}),
    r1 AS (SELECT id, pr.m AS mode, j, k AS u, sum((line[34 + j * 4 + i] - p) * s)::BIGINT AS t FROM pr JOIN hm ON n = i GROUP BY ALL),
    r2 AS (SELECT id, mode, u, k, sum(t * s)::BIGINT AS c FROM r1 JOIN hm ON n = j GROUP BY ALL), cost AS (SELECT id, mode, sum(abs(c))::BIGINT AS satd FROM r2 GROUP BY ALL)
    SELECT id, mode, satd, row_number() OVER (PARTITION BY id ORDER BY satd, mode) AS rank FROM cost QUALIFY rank <= 4""",
)
def mode_search(spark, sf_dir):
    """The four of all 67 luma modes with the least absolute Hadamard sum, for a 4 x 4 block out of each row."""
    return best_of(references(spark, sf_dir), range(67), prediction.luma_taps)


@query(
    "ref_gather",
    f"""WITH {planes.RAW_SQL}, h AS (SELECT max(y) + 1 AS n FROM raw), b AS (SELECT br, bc FROM h, unnest(range(0, n // 8)) r(br), range(0, 8) c(bc)),
    p AS (SELECT br, bc, side, k, CASE WHEN side = 'top' THEN br * 8 - 1 ELSE br * 8 - 1 + k END AS ny, CASE WHEN side = 'top' THEN bc * 8 - 1 + k ELSE bc * 8 - 1 END AS nx FROM b, (VALUES ('top'), ('left')) s(side), range(0, 17) q(k) WHERE side = 'top' OR k > 0),
    z AS (SELECT *, (br // 8) * 64 + list_sum([(((bc >> e) & 1) << (2 * e)) + (((br >> e) & 1) << (2 * e + 1)) FOR e IN [0, 1, 2]]) AS own,
        (ny // 8 // 8) * 64 + list_sum([((((nx // 8) >> e) & 1) << (2 * e)) + ((((ny // 8) >> e) & 1) << (2 * e + 1)) FOR e IN [0, 1, 2]]) AS other FROM p)
    SELECT br AS brow, bc AS bcol, side, k, CASE WHEN ny >= 0 AND nx BETWEEN 0 AND 63 AND other < own THEN v END AS v FROM z LEFT JOIN raw ON raw.y = ny AND raw.x = nx""",
)
def ref_gather(spark, sf_dir):
    return neighbours.gathered(planes.embedding_rows(spark, sf_dir), 8)


@query(
    "qp_predicted",
    """WITH g AS (SELECT (l_orderkey * 8 + l_linenumber) AS id, 20 + l_partkey % 20 AS qp FROM lineitem), m AS (SELECT id // 8 AS r, id % 8 AS c, max(qp) AS qp FROM g GROUP BY ALL),
    o AS (SELECT *, (r // 2) * 16 + (c // 2) * 4 + (r % 2) * 2 + c % 2 AS seq FROM m)
    SELECT o.r AS grow, o.c AS gcol, (CASE WHEN o.c = 0 AND o.r % 2 = 0 AND o.r > 0 THEN coalesce(a.qp, 30) ELSE (CASE WHEN o.r % 2 <> 0 THEN coalesce(a.qp, 30) ELSE coalesce(p.qp, 30) END + CASE WHEN o.c % 2 <> 0 THEN coalesce(l.qp, 30) ELSE coalesce(p.qp, 30) END + 1) >> 1 END)::BIGINT AS predicted
    FROM o LEFT JOIN o p ON p.seq = o.seq - 1 LEFT JOIN o a ON a.r = o.r - 1 AND a.c = o.c LEFT JOIN o l ON l.r = o.r AND l.c = o.c - 1""",
)
def qp_predicted(spark, sf_dir):
    """On a grid of 8 groups a row from the keys of ``lineitem``; a group that is not there counts as the picture's 30."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    grid = t.groupBy(F.floor(key / 8).alias("grow"), (key % 8).alias("gcol")).agg(F.max(20 + F.col("l_partkey") % 20).alias("qp"))
    return neighbours.predicted_qp(grid, 8, 2, 30)


@query(
    "bits_read",
    "SELECT c_custkey, c_custkey % 16 AS u, c_custkey AS ue, CASE WHEN c_custkey % 2 = 0 THEN -(c_custkey // 3) ELSE c_custkey // 3 END AS se, 4 + 2 * length(bin(c_custkey + 1)) - 1 + 2 * length(bin(2 * (c_custkey // 3) + CASE WHEN c_custkey % 2 <> 0 AND c_custkey > 2 THEN 0 ELSE 1 END)) - 1 AS used, true AS stopped FROM customer",
)
def bits_read(spark, sf_dir):
    """A fixed-width number, an unsigned and a signed code, written and read back one after the other."""
    k = F.col("c_custkey")
    signed = F.expr("c_custkey div 3") * F.when(k % 2 == 0, -1).otherwise(1)
    made = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(codes.bits(k % 16, F.lit(4)), codes.unsigned_exp_golomb(k), codes.signed_exp_golomb(signed), F.lit("1000")).alias("b"))
    at = made.withColumn("u", codes.read_bits(F.col("b"), F.lit(0), F.lit(4)))
    at = at.withColumn("ue", codes.read_unsigned(F.col("b"), F.lit(4))).withColumn("p", 4 + F.col("ue.used"))
    at = at.withColumn("se", codes.read_signed(F.col("b"), F.col("p"))).withColumn("used", (F.col("p") + F.col("se.used")).cast("bigint"))
    return at.select("c_custkey", "u", F.col("ue.value").alias("ue"), F.col("se.value").alias("se"), "used", codes.only_stop_bit(F.col("b"), F.col("used")).alias("stopped"))


@query(
    "ctx_update",
    f"""WITH RECURSIVE {planes.RAW_SQL}, l AS (SELECT y, list(v % 2 ORDER BY x) AS b FROM raw GROUP BY y),
    w AS (SELECT y, b, 0 AS k, 16384 AS s0, 16384 AS s1 FROM l UNION ALL SELECT y, b, k + 1, s0 - ((s0 >> 4) & 32736) + CASE WHEN b[k + 1] = 1 THEN (32767 >> 4) & 32736 ELSE 0 END, s1 - ((s1 >> 7) & 32766) + CASE WHEN b[k + 1] = 1 THEN (32767 >> 7) & 32766 ELSE 0 END FROM w WHERE k < 64)
    SELECT y, k AS x, ((s0 + s1) >> 8)::BIGINT AS prob, ((s0 + s1) >> 15)::BIGINT AS likely, ((((CASE WHEN ((s0 + s1) >> 8) >= 128 THEN 255 - ((s0 + s1) >> 8) ELSE (s0 + s1) >> 8 END) >> 2) * 12) >> 1)::BIGINT + 4 AS lps FROM w WHERE k < 64""",
)
def ctx_update(spark, sf_dir):
    """The probability a context has before each parity of a row of samples, and the part of a range of 400 left to the less likely."""
    rows = planes.embedding_rows(spark, sf_dir)
    walked = rows.select("y", F.posexplode(states.adapted(F.transform("row", lambda v: (v % 2).cast("int")), 16384, 4, 7)).alias("x", "prob"))
    return walked.select("y", F.col("x").cast("bigint").alias("x"), F.col("prob").cast("bigint").alias("prob"), F.floor(F.col("prob") / 128).cast("bigint").alias("likely"), states.less_likely(F.col("prob"), F.lit(400)).cast("bigint").alias("lps"))


@query(
    "coded_format",
    "SELECT p_partkey, (p_size * 37 + 7) // 8 * 8 AS cw, (p_retailprice::BIGINT + 7) // 8 * 8 AS ch, 8 + 2 * (p_partkey % 3) AS depth, p_partkey % 4 AS idc, 12 * (p_partkey % 3) AS qp_offset, CASE WHEN p_partkey % 3 = 2 THEN CASE WHEN p_partkey % 4 >= 2 THEN 34 ELSE 2 END WHEN p_partkey % 4 >= 2 THEN 33 ELSE 1 END AS profile, p_partkey % 256 << (2 * (p_partkey % 3)) AS widened FROM part",
)
def coded_format(spark, sf_dir):
    """Padded size, the quantizer's offset of a depth, the profile of a format, and an 8-bit sample at that depth."""
    k, depth, idc = F.col("p_partkey"), 8 + 2 * (F.col("p_partkey") % 3), F.col("p_partkey") % 4
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", s.to_multiple_of_8(F.col("p_size") * 37).alias("cw"), s.to_multiple_of_8(F.rint("p_retailprice")).alias("ch"), depth.alias("depth"), idc.alias("idc"), s.depth_offset(depth).alias("qp_offset"), s.profile(depth, idc).cast("int").alias("profile"), s.widened(k % 256, depth).alias("widened"))


@query(
    "decoder_guard",
    """WITH p AS (SELECT p_partkey, (p_size - 1) * 400 AS w, (p_retailprice * 10)::BIGINT AS h FROM part), c AS (SELECT *, (w + 7) // 8 * 8 AS cw, (h + 7) // 8 * 8 AS ch FROM p)
    SELECT p_partkey, CASE WHEN w = 0 OR h = 0 OR cw > 16888 OR ch > 16888 THEN 'decode error: image dimensions out of range' WHEN cw * ch > 35651584 THEN 'decode error: image too large to decode' END AS error FROM c""",
)
def decoder_guard(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ((F.col("p_size").cast("bigint") - 1) * 400).alias("w"), F.round(F.col("p_retailprice") * 10).cast("bigint").alias("h"))
    return p.select("p_partkey", s.decoder_error(F.col("w"), F.col("h")).alias("error"))


@query(
    "error_texts",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'invalid image dimensions: ' || l_partkey || 'x' || l_suppkey WHEN 1 THEN 'quality ' || l_partkey % 256 || ' out of range (expected 1..=100)'
        WHEN 2 THEN 'pixel buffer size mismatch: expected ' || l_partkey || ' bytes, found ' || l_suppkey ELSE 'sample ' || l_partkey || ' exceeds maximum ' || CASE l_suppkey % 3 WHEN 0 THEN '255 for 8' WHEN 1 THEN '1023 for 10' ELSE '4095 for 12' END || '-bit depth' END AS message FROM lineitem""",
)
def error_texts(spark, sf_dir):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("dimensions", "quality", "length", "range"))), F.col("l_linenumber") % 4 + 1)
    second = F.when(kind == "range", 8 + 2 * (b % 3)).otherwise(b)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", s.message(kind, F.when(kind == "quality", a % 256).otherwise(a), second).alias("message"))


@query(
    "chroma_resample",
    f"WITH {planes.RAW_SQL}, h AS (SELECT max(y) + 1 AS n FROM raw), g AS (SELECT y, x, n FROM h, unnest(range(0, 2 * n)) a(y), range(0, 128) b(x)) SELECT g.y, g.x, v FROM g JOIN raw ON raw.y = least(g.y // 2, n - 1) AND raw.x = least(g.x // 2, 63)",
)
def chroma_resample(spark, sf_dir):
    return planes.samples(planes.resampled(planes.embedding_rows(spark, sf_dir), (2, 2), (1, 1)))


@query(
    "wide_samples",
    "WITH b AS (SELECT p_partkey, regexp_extract_all(hex(encode(p_name)), '..') AS b FROM part) SELECT p_partkey, k AS i, (('0x' || b[2 * k + 2] || b[2 * k + 1])::BIGINT) AS v FROM b, unnest(range(0, len(b) // 2)) r(k)",
)
def wide_samples(spark, sf_dir):
    """Names taken as planes of little-endian pairs."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.posexplode(planes.pairs(F.hex(F.encode("p_name", "UTF-8")))).alias("i", "v")).select("p_partkey", F.col("i").cast("bigint").alias("i"), "v")


@query(
    "channel_select",
    "SELECT vec_id AS y, x, l[1] AS r, l[2] AS g, l[3] AS b, l[4] AS a, l[1] = l[2] AND l[2] = l[3] AS grey FROM (SELECT vec_id, x, [least(255, greatest(0, 128 + floor(embedding[4 * x + c]::DOUBLE * 256)::BIGINT)) // 16 FOR c IN [1, 2, 3, 4]] AS l FROM embeddings, range(0, 16) q(x))",
)
def channel_select(spark, sf_dir):
    rows = planes.embedding_rows(spark, sf_dir).select("y", F.transform("row", lambda v: F.floor(v / 16).cast("bigint")).alias("row"))
    return planes.channels(rows, "rgba").withColumn("grey", (F.col("r") == F.col("g")) & (F.col("g") == F.col("b")))


@query("block_extract", f"WITH {planes.plane_sql(8)} SELECT y // 8 AS brow, x // 8 AS bcol, y % 8 AS j, string_agg(v, ',' ORDER BY x) AS part FROM plane GROUP BY ALL")
def block_extract(spark, sf_dir):
    return planes.blocks(planes.padded(planes.embedding_rows(spark, sf_dir), 8), 8).select("brow", "bcol", F.posexplode("block").alias("j", "part")).select("brow", "bcol", F.col("j").cast("bigint").alias("j"), F.array_join("part", ",").alias("part"))


@query("block_place", f"WITH {planes.plane_sql(8)} SELECT y, x, v FROM plane")
def block_place(spark, sf_dir):
    return planes.placed(planes.blocks(planes.padded(planes.embedding_rows(spark, sf_dir), 8), 8), 8)


@query(
    "colour_effective",
    "SELECT c_custkey, coalesce(p, 1)::INTEGER AS primaries, coalesce(t, 13)::INTEGER AS transfer, coalesce(m, 6)::INTEGER AS matrix, p IS NOT NULL AND icc AS second_box FROM (SELECT c_custkey, c_nationkey % 2 = 0 AS icc, CASE WHEN c_custkey % 3 > 0 THEN 9 END AS p, CASE WHEN c_custkey % 3 > 0 THEN 16 END AS t, CASE WHEN c_custkey % 3 > 0 THEN 9 END AS m FROM customer)",
)
def colour_effective(spark, sf_dir):
    known = F.when(F.col("c_custkey") % 3 > 0, F.struct(F.lit(9).alias("primaries"), F.lit(16).alias("transfer"), F.lit(9).alias("matrix")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", known.alias("k"), (F.col("c_nationkey") % 2 == 0).alias("icc")).select("c_custkey", metadata.effective(F.col("k")).alias("e"), (F.col("k").isNotNull() & F.col("icc")).alias("second_box")).select("c_custkey", "e.*", "second_box")


@query("light_levels", "SELECT c_custkey, lpad(hex(c_custkey % 65536), 4, '0') || lpad(hex(c_nationkey), 4, '0') AS payload, c_custkey % 65536 AS most, c_nationkey::BIGINT AS mean FROM customer")
def light_levels(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", metadata.light_level(F.col("c_custkey") % 65536, F.col("c_nationkey").cast("bigint")).alias("payload"))
    return c.select("c_custkey", "payload", metadata.parse_light_level(F.col("payload")).alias("l")).select("c_custkey", "payload", "l.*")


def _down(sub_w: int, sub_h: int) -> str:
    rows = [f"j.y = y * {sub_h} + {k}" for k in range(sub_h)]
    taps = "sum(CASE WHEN j.x = 2 * g.x THEN 2 * j.v ELSE j.v END + CASE WHEN g.x = 0 AND j.x = 0 THEN j.v ELSE 0 END)::BIGINT"
    return f"SELECT {sub_w * 10 + sub_h} AS format, g.y, g.x, ({taps} + {2 * sub_h}) >> {1 + sub_h} AS v FROM (SELECT y, x FROM h, unnest(range(0, n // {sub_h})) a(y), range(0, 32) b(x)) g JOIN raw j ON ({' OR '.join(r.replace('= y', '= g.y') for r in rows)}) AND j.x BETWEEN 2 * g.x - 1 AND 2 * g.x + 1 GROUP BY g.y, g.x"


@query("cclm_downsample", f"WITH {planes.RAW_SQL}, h AS (SELECT max(y) + 1 AS n FROM raw) SELECT 11 AS format, y, x, v FROM raw UNION ALL {_down(2, 1)} UNION ALL {_down(2, 2)}")
def cclm_downsample(spark, sf_dir):
    rows, out = planes.embedding_rows(spark, sf_dir), None
    for w, h in ((1, 1), (2, 1), (2, 2)):
        one = prediction.downsampled(rows, w, h).select(F.lit(10 * w + h).alias("format"), "y", "x", "v")
        out = one if out is None else out.union(one)
    return out


@query(
    "cclm_points",
    f"""WITH {planes.RAW_SQL}, t AS (SELECT y, list(v ORDER BY x) AS t, y % 4 IN (0, 1) AS ab, y % 4 IN (0, 2) AS le, [2, 4, 8, 16][(y // 4 % 4 + 1)::INTEGER] AS n FROM raw GROUP BY y),
    k AS (SELECT y, t, ab, le, n, CASE WHEN ab AND le THEN [n // 4, n // 4 + greatest(1, n // 2), 100 + n // 4, 100 + n // 4 + greatest(1, n // 2)]
        WHEN n = 2 THEN CASE WHEN ab THEN [1, 0, 1, 0] ELSE [101, 100, 101, 100] END
        ELSE [b + n // 8 + m * greatest(1, n // 4) FOR m IN [0, 1, 2, 3]] END AS p FROM (SELECT *, CASE WHEN ab THEN 0 ELSE 100 END AS b FROM t) WHERE ab OR le)
    SELECT y, m AS point, t[(CASE WHEN p[m + 1] >= 100 THEN p[m + 1] - 100 + 17 ELSE p[m + 1] + 1 END)::INTEGER] AS luma, t[(CASE WHEN p[m + 1] >= 100 THEN p[m + 1] - 100 + 49 ELSE p[m + 1] + 33 END)::INTEGER] AS chroma FROM k, range(0, 4) r(m)""",
)
def cclm_points(spark, sf_dir):
    """Sides of 2 to 16 samples out of each row, both, one or none of them there."""
    rows = planes.embedding_rows(spark, sf_dir)
    n = F.pow(F.lit(2.0), 1 + F.floor(F.col("y") / 4) % 4).cast("int")
    part = lambda at: F.slice(F.col("row"), F.lit(at), n)
    found = rows.select("y", prediction.four_points(part(1), part(33), part(17), part(49), (F.col("y") % 4).isin(0, 1), (F.col("y") % 4).isin(0, 2)).alias("p")).where("p IS NOT NULL")
    points = found.select("y", F.posexplode(F.arrays_zip("p.luma", "p.chroma")).alias("point", "q"))
    return points.select("y", F.col("point").cast("bigint").alias("point"), F.col("q.luma").alias("luma"), F.col("q.chroma").alias("chroma"))


_LAMBDA, _SCALE = rates.cost_of_bits(QP), 0.015625
_BITS = "(CASE WHEN {0} <= 0 THEN 0 WHEN {0} = 1 THEN 3 WHEN {0} <= 3 THEN 5 ELSE 6 + 2 * floor(log2(({0} - 3)::DOUBLE)) END)"
_PLACE = "[0, 1, 2, 3, 5, 5, 6, 6][({0} + 1)::INTEGER]"


@query(
    "rdoq_levels",
    f"""WITH {forward_sql(8, 8)}, o AS ({scan_sql(8, 8)}), k AS (SELECT brow, bcol, u, v, c, pos, {quant_sql('abs(c)', 8, 8, QP)} AS l FROM coef JOIN o ON o.x = u AND o.y = v),
    d AS (SELECT *, (c * c)::DOUBLE * {_SCALE} AS z, ((abs(c) - {dequant_sql('(l - 1)', 8, 8, QP)}) ** 2)::DOUBLE * {_SCALE} AS e1, ((abs(c) - {dequant_sql('l', 8, 8, QP)}) ** 2)::DOUBLE * {_SCALE} AS e2 FROM k),
    t AS (SELECT *, e1 + {_LAMBDA} * {_BITS.format('(l - 1)')} AS c1, e2 + {_LAMBDA} * {_BITS.format('l')} AS c2 FROM d),
    q AS (SELECT *, CASE WHEN l > 0 AND c2 < z AND (l = 1 OR c2 < c1) THEN l WHEN l > 1 AND c1 < z THEN l - 1 ELSE 0 END AS b FROM t),
    r AS (SELECT *, CASE WHEN b = 0 THEN z WHEN b = l THEN c2 ELSE c1 END AS cost FROM q),
    s AS (SELECT *, sum(z) OVER w - sum(z) OVER a AS tail, sum(cost) OVER a AS so_far, sum(z) OVER w AS none FROM r WINDOW w AS (PARTITION BY brow, bcol), a AS (PARTITION BY brow, bcol ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT brow, bcol, min(none) AS none, min(so_far + tail + {_LAMBDA} * ({_PLACE.format('u')} + {_PLACE.format('v')})) FILTER (b > 0) AS best, arg_min(pos, so_far + tail + {_LAMBDA} * ({_PLACE.format('u')} + {_PLACE.format('v')})) FILTER (b > 0) AS last FROM s GROUP BY brow, bcol)
    SELECT s.brow, s.bcol, u, v, (CASE WHEN best < m.none AND pos <= last THEN CASE WHEN c < 0 THEN -b ELSE b END ELSE 0 END)::BIGINT AS level FROM s JOIN m ON m.brow = s.brow AND m.bcol = s.bcol""",
)
def rdoq_levels(spark, sf_dir):
    return rates.by_rate(transforms.forward(rows_of(spark, sf_dir, 8), 8, 8), 8, 8, QP, _SCALE)
