"""Every query of the library's own operators, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, metadata
from ..functions import samples as s
from ..functions.tables import DEQUANT, MATRICES, QUANT, RECIPROCAL, dequant_terms, kept, quant_terms, scan
from ..operators import blocks, modes, neighbours, prediction, states, transforms, trellis
from ..sources import planes, streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "tq_roundtrip_ssd"
QP = 28


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


#: Keys of ``lineitem``, which carry what is drawn from its numbers.
KEYS = ("l_orderkey", "l_linenumber")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def rows_of(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return planes.padded(planes.embedding_rows(spark, sf_dir), size)


def matrix_sql(name: str, kind: str, n: int) -> str:
    values = ", ".join(f"({k}, {i}, {v})" for k, row in enumerate(MATRICES[kind](n)[: kept(kind, n)]) for i, v in enumerate(row))
    return f"{name}(k, i, m) AS (VALUES {values})"


def sh(expr: str, shift: int) -> str:
    return f"(({expr} + {1 << (shift - 1)}) >> {shift})" if shift > 0 else f"({expr})"


def forward_sql(w: int, h: int, across: str = "dct2", down: str = "dct2") -> str:
    """Tables that end in coef(brow, bcol, u, v, c)."""
    first, second = w.bit_length() - 2, h.bit_length() + 5
    return f"""{planes.plane_sql(h)}, {matrix_sql('ma', across, w)}, {matrix_sql('md', down, h)},
     p1 AS (SELECT y // {h} AS brow, x // {w} AS bcol, y % {h} AS j, k AS u, {sh('sum(v * m)::BIGINT', first)} AS t FROM plane JOIN ma ON i = x % {w} GROUP BY ALL),
     live AS (SELECT brow, bcol, u, k AS v, {sh('sum(t * m)::BIGINT', second)} AS c FROM p1 JOIN md ON i = j GROUP BY ALL),
     coef AS (SELECT brow, bcol, u::BIGINT AS u, v::BIGINT AS v, c FROM live UNION ALL
              SELECT brow, bcol, a, b, 0 FROM (SELECT DISTINCT brow, bcol FROM live), range(0, {w}) p(a), range(0, {h}) q(b) WHERE a >= {kept(across, w)} OR b >= {kept(down, h)})"""


def quant_sql(c: str, w: int, h: int, qp: int) -> str:
    scale, offset, shift = quant_terms(w, h, qp)
    return f"least(32767, greatest(-32768, (CASE WHEN {c} < 0 THEN -1 ELSE 1 END) * ((abs({c}) * {scale} + {offset}) >> {shift})))"


def dequant_sql(level: str, w: int, h: int, qp: int) -> str:
    factor, offset, shift = dequant_terms(w, h, qp)
    return f"least(32767, greatest(-32768, ({level} * {factor} + {offset}) >> {shift}))"


def inverse_sql(w: int, h: int) -> str:
    """Tables from coef to residual(brow, bcol, j, i, r)."""
    return f"""i1 AS (SELECT brow, bcol, u, md.i AS j, least(32767, greatest(-32768, {sh('sum(c * m)::BIGINT', 7)})) AS t FROM coef JOIN md ON md.k = coef.v GROUP BY ALL),
     residual AS (SELECT brow, bcol, j, ma.i AS i, {sh('sum(t * m)::BIGINT', 12)} AS r FROM i1 JOIN ma ON ma.k = i1.u GROUP BY ALL)"""


QUANTIZED = f"coef AS (SELECT brow, bcol, u, v, {dequant_sql(quant_sql('c', 4, 4, QP), 4, 4, QP)} AS c FROM coef0)"


@query(
    FLAGSHIP,
    f"""WITH {forward_sql(4, 4).replace('coef AS', 'coef0 AS')}, {QUANTIZED}, {inverse_sql(4, 4)}
    SELECT brow, bcol, sum((v - r) * (v - r))::BIGINT AS ssd FROM residual JOIN plane ON plane.y = brow * 4 + j AND plane.x = bcol * 4 + residual.i GROUP BY ALL""",
)
def tq_roundtrip_ssd(spark, sf_dir):
    return transforms.round_trip(rows_of(spark, sf_dir, 4), 4, QP)


def _transform_query(name: str, w: int, h: int, across: str = "dct2", down: str = "dct2") -> None:
    sql = f"WITH {forward_sql(w, h, across, down)} SELECT brow, bcol, u, v, c FROM coef"
    QUERIES[name] = lambda spark, sf_dir: transforms.forward(rows_of(spark, sf_dir, h), w, h, across, down)
    ORACLE_SQL[name] = sql


for _n in (4, 8, 16, 32, 64):
    _transform_query(f"dct_{_n}", _n, _n)
_transform_query("dct_rect_16x4", 16, 4)
_transform_query("dct_rect_8x32", 8, 32)
_transform_query("mts_dst7_dst7_8", 8, 8, "dst7", "dst7")
_transform_query("mts_dct8_dst7_16", 16, 16, "dct8", "dst7")
_transform_query("mts_dst7_dct8_4", 4, 4, "dst7", "dct8")
_transform_query("mts_dst7_dst7_32", 32, 32, "dst7", "dst7")


def _round_trip(name: str, w: int, h: int, across: str = "dct2", down: str = "dct2") -> None:
    """The inverse transform of the forward one, sample by sample."""
    QUERIES[name] = lambda spark, sf_dir: transforms.inverse(transforms.forward(rows_of(spark, sf_dir, h), w, h, across, down), w, h, across, down)
    ORACLE_SQL[name] = f"WITH {forward_sql(w, h, across, down)}, {inverse_sql(w, h)} SELECT brow, bcol, j::BIGINT AS j, i::BIGINT AS i, r FROM residual"


_round_trip("inverse_dct_8", 8, 8)
_round_trip("inverse_dct_16x8", 16, 8)
_round_trip("inverse_mts_dct8_dst7_8", 8, 8, "dct8", "dst7")


def _scale_sql(w: int, h: int) -> str:
    spots = [(0, 0), (w // 2, h // 2), (w - 1, 0), (0, h - 1), (w - 1, h - 1), (max(w // 4, 1), max(h // 4, 1))]
    values = ", ".join(f"({k}, 0, {u}, {v}, 1024)" for k, (u, v) in enumerate(spots))
    return f"""SELECT {w}::BIGINT AS w, {h}::BIGINT AS h, scale FROM (WITH {matrix_sql('ma', 'dct2', w)}, {matrix_sql('md', 'dct2', h)}, coef(brow, bcol, u, v, c) AS (VALUES {values}), {inverse_sql(w, h)}
    SELECT sum(r * r)::DOUBLE / (1048576 * 6) AS scale FROM residual)"""


_SIZES = ((4, 4), (8, 8), (16, 16), (16, 8), (4, 8))


@query("error_scale", f"WITH e AS ({' UNION ALL '.join(_scale_sql(w, h) for w, h in _SIZES)}) SELECT p_partkey, w, h, scale FROM part JOIN e ON w = {list(w for w, _ in _SIZES)}[(p_partkey % 5 + 1)::INTEGER] AND h = {list(h for _, h in _SIZES)}[(p_partkey % 5 + 1)::INTEGER]")
def error_scale(spark, sf_dir):
    """What a squared error costs in the block that each part's key draws; the impulses' scales, a row a size, are broadcast."""
    side = lambda k: F.element_at(F.array(*[F.lit(size[k]).cast("bigint") for size in _SIZES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    drawn = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", side(0).alias("w"), side(1).alias("h"))
    scales = None
    for w, h in _SIZES:
        one = transforms.error_scale(spark, w, h).select(F.lit(w).cast("bigint").alias("w"), F.lit(h).cast("bigint").alias("h"), "scale")
        scales = one if scales is None else scales.union(one)
    return drawn.join(F.broadcast(scales), ["w", "h"])


@query("quant_scalar", f"WITH {forward_sql(8, 4)}, l AS (SELECT brow, bcol, u, v, {quant_sql('c', 8, 4, QP)} AS level FROM coef) SELECT brow, bcol, u, v, level, {dequant_sql('level', 8, 4, QP)} AS c FROM l")
def quant_scalar(spark, sf_dir):
    levels = transforms.forward(rows_of(spark, sf_dir, 4), 8, 4).withColumn("level", transforms.quantize(F.col("c"), 8, 4, QP))
    return levels.select("brow", "bcol", "u", "v", "level", transforms.dequantize(F.col("level"), 8, 4, QP).alias("c"))


@query(
    "quant_skip",
    f"""WITH {planes.RAW_SQL}, q AS (SELECT q::BIGINT AS q FROM (VALUES (4), (10), (28), (45)) v(q)),
    l AS (SELECT y, x, q, v - 128 AS r, CASE q % 6 WHEN 4 THEN {QUANT[4]} ELSE {QUANT[3]} END AS qs, CASE q % 6 WHEN 4 THEN {DEQUANT[4]} ELSE {DEQUANT[3]} END AS ds, 14 + q // 6 AS sh FROM raw, q),
    m AS (SELECT y, x, q, ds, (CASE WHEN r < 0 THEN -1 ELSE 1 END) * ((abs(r) * qs + (171 << (sh - 9))) >> sh) AS level FROM l)
    SELECT y, x, q AS qp, level::BIGINT AS level, (CASE WHEN q < 36 THEN (level * ds + (1 << (5 - q // 6))) >> (6 - q // 6) ELSE level * ds * (1 << (q // 6 - 6)) END)::BIGINT AS r FROM m""",
)
def quant_skip(spark, sf_dir):
    base = planes.samples(planes.embedding_rows(spark, sf_dir))
    out = None
    for qp in (4, 10, 28, 45):
        level = transforms.quantize_skip(F.col("v") - 128, qp)
        one = base.select("y", "x", F.lit(qp).cast("bigint").alias("qp"), level.alias("level")).withColumn("r", transforms.dequantize_skip(F.col("level"), qp))
        out = one if out is None else out.union(one)
    return out


_LEVEL = "least(255, greatest(0, 128 + floor(embedding[3 * x + {}]::DOUBLE * 256)::BIGINT))"
PIXELS = f"px AS (SELECT vec_id AS y, x, {_LEVEL.format(1)} AS r, {_LEVEL.format(2)} AS g, {_LEVEL.format(3)} AS b FROM embeddings, range(0, 21) p(x))"


def fixed_sql(weights: tuple[int, int, int]) -> str:
    return f"(({weights[0]} * r + {weights[1]} * g + {weights[2]} * b + 4095) >> 13)"


def _chroma_sql(sub_w: int, sub_h: int) -> str:
    n = "count(*)::BIGINT"
    mean = lambda c: f"((sum({c})::BIGINT + {n} // 2) // {n})"
    return f"""WITH {PIXELS}, m AS (SELECT y // {sub_h} AS y, x // {sub_w} AS x, {mean('r')} AS r, {mean('g')} AS g, {mean('b')} AS b FROM px GROUP BY y // {sub_h}, x // {sub_w})
    SELECT y, x, least(255, greatest(0, {fixed_sql(s.CB)} + 128)) AS cb, least(255, greatest(0, {fixed_sql(s.CR)} + 128)) AS cr FROM m"""


@query("rgb_to_luma", f"WITH {PIXELS} SELECT y, x, {fixed_sql(s.LUMA)} AS v FROM px")
def rgb_to_luma(spark, sf_dir):
    return planes.pixels(planes.embedding_rows(spark, sf_dir)).select("y", "x", s.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def chroma_plane(px: DataFrame, sub_w: int, sub_h: int) -> DataFrame:
    """(y, x, cb, cr): chroma of the rounded mean colour of each sub_w x sub_h pixels."""
    mean = lambda c: F.expr(f"(sum({c}) + count(*) div 2) div count(*)").alias(c)
    m = px.groupBy(F.expr(f"y div {sub_h}").alias("y"), F.expr(f"x div {sub_w}").alias("x")).agg(mean("r"), mean("g"), mean("b"))
    return m.select("y", "x", *[s.chroma(w, F.col("r"), F.col("g"), F.col("b")).alias(n) for n, w in (("cb", s.CB), ("cr", s.CR))])


for _name, _w, _h in (("444", 1, 1), ("422", 2, 1), ("420", 2, 2)):
    QUERIES[f"rgb_to_chroma_{_name}"] = lambda spark, sf_dir, w=_w, h=_h: chroma_plane(planes.pixels(planes.embedding_rows(spark, sf_dir)), w, h)
    ORACLE_SQL[f"rgb_to_chroma_{_name}"] = _chroma_sql(_w, _h)


@query(
    "ycbcr_to_rgb",
    f"""WITH {PIXELS}, t AS (SELECT y, x, {fixed_sql(s.LUMA)} AS l, least(255, greatest(0, {fixed_sql(s.CB)} + 128)) - 128 AS u, least(255, greatest(0, {fixed_sql(s.CR)} + 128)) - 128 AS w FROM px)
    SELECT y, x, least(255, greatest(0, l + ((11485 * w + 4096) >> 13))) AS r, least(255, greatest(0, l - ((2819 * u + 5850 * w + 4096) >> 13))) AS g, least(255, greatest(0, l + ((14516 * u + 4096) >> 13))) AS b FROM t""",
)
def ycbcr_to_rgb(spark, sf_dir):
    px = planes.pixels(planes.embedding_rows(spark, sf_dir))
    rgb = [F.col(c) for c in "rgb"]
    out = s.rgb_of(s.luma(*rgb), s.chroma(s.CB, *rgb), s.chroma(s.CR, *rgb))
    return px.select("y", "x", *[c.alias(n) for c, n in zip(out, "rgb", strict=True)])


@query("pad_to_8", f"WITH {planes.plane_sql(8)} SELECT y, x, v FROM plane")
def pad_to_8(spark, sf_dir):
    return planes.samples(rows_of(spark, sf_dir, 8))


@query("crop_display", f"WITH {planes.plane_sql(8)} SELECT y, x, v FROM plane WHERE x < 61 AND y < (SELECT h - 3 FROM h)")
def crop_display(spark, sf_dir):
    rows = planes.embedding_rows(spark, sf_dir)
    height = rows.agg((F.max("y") + 1 - 3).alias("h"))
    return planes.samples(planes.padded(rows, 8)).join(F.broadcast(height), F.col("y") < F.col("h")).where("x < 61").select("y", "x", "v")


@query(
    "dims_valid",
    """WITH p AS (SELECT p_partkey, p_size::BIGINT * 400 - 400 AS w, (p_retailprice * 10)::BIGINT AS h FROM part),
    c AS (SELECT *, (w + 7) // 8 * 8 AS cw, (h + 7) // 8 * 8 AS ch FROM p)
    SELECT p_partkey, w, h, w >= 1 AND h >= 1 AND cw <= 16888 AND ch <= 16888 AND cw * ch <= 35651584 AS valid FROM c""",
)
def dims_valid(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size").cast("bigint") * 400 - 400).alias("w"), F.round(F.col("p_retailprice") * 10).cast("bigint").alias("h"))
    return p.withColumn("valid", s.fits_level(F.col("w"), F.col("h")))


@query("quality_to_qp", "SELECT l_orderkey, l_linenumber, q, 51 - ((least(100, greatest(1, q)) - 1) * 47) // 99 AS qp FROM (SELECT *, l_quantity::BIGINT * 3 - 20 AS q FROM lineitem)")
def quality_to_qp(spark, sf_dir):
    q = F.rint("l_quantity").cast("bigint") * 3 - 20
    return lines(spark, sf_dir).select(*KEYS, q.alias("q"), s.quality_to_qp(q).alias("qp"))


@query(
    "chroma_promote",
    "SELECT l_orderkey, l_linenumber, idc, w, h, (CASE WHEN idc = 1 AND w % 2 <> 0 THEN 3 WHEN idc = 1 AND h % 2 <> 0 THEN 2 WHEN idc = 2 AND w % 2 <> 0 THEN 3 ELSE idc END)::INTEGER AS promoted FROM (SELECT *, (l_linenumber % 4)::INTEGER AS idc, l_partkey % 500 + 1 AS w, l_suppkey % 500 + 1 AS h FROM lineitem)",
)
def chroma_promote(spark, sf_dir):
    drawn = lines(spark, sf_dir).select(*KEYS, (F.col("l_linenumber") % 4).cast("int").alias("idc"), (F.col("l_partkey") % 500 + 1).alias("w"), (F.col("l_suppkey") % 500 + 1).alias("h"))
    return drawn.withColumn("promoted", s.chroma_for_size(F.col("idc"), F.col("w"), F.col("h")).cast("int"))


_FLAGS = ("lossless", "aq", "mtt", "cclm", "dual_tree", "deblock")


@query(
    "tool_gating",
    f"""WITH c AS (SELECT id, {', '.join(f'(id >> {k}) & 1 = 1 AS {n}' for k, n in enumerate(_FLAGS))}, ((id >> 6) & 3)::INTEGER AS idc, (8 + 2 * ((id >> 8) % 3))::INTEGER AS depth, l_orderkey, l_linenumber FROM (SELECT *, (l_partkey * 7 + l_orderkey) % 768 AS id FROM lineitem)),
    d AS (SELECT *, dual_tree AND NOT lossless AND idc IN (1, 2) AS dual_on FROM c)
    SELECT l_orderkey, l_linenumber, id, aq AND NOT lossless AS aq_on, mtt AND NOT lossless AS mtt_on, cclm AND NOT lossless AS cclm_on, dual_on, deblock AND depth = 8 AND NOT aq AND NOT dual_on AND NOT lossless AND NOT mtt AS deblock_on FROM d""",
)
def tool_gating(spark, sf_dir):
    bit = lambda k: F.shiftright("id", k).bitwiseAND(F.lit(1)) == 1
    asked = {n: bit(k) for k, n in enumerate(_FLAGS)} | {"idc": F.shiftright("id", 6).bitwiseAND(F.lit(3)), "depth": 8 + 2 * (F.shiftright("id", 8) % 3)}
    drawn = lines(spark, sf_dir).withColumn("id", (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 768)
    return drawn.select(*KEYS, "id", *[c.alias(n) for n, c in s.tools_in_effect(asked).items()])


@query(
    "picture_checks",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS w, l_suppkey % 30 AS h, (l_linenumber % 4)::BIGINT AS channels, (l_quantity * 20)::BIGINT AS length, (l_extendedprice / 64)::BIGINT AS largest, l_partkey % 37 + 4 AS stride, (l_discount * 1500)::BIGINT AS q, 8 + 2 * (l_linenumber % 3) AS depth FROM lineitem)
    SELECT l_orderkey, l_linenumber, q BETWEEN 1 AND 100 AS quality_ok, length = w * h * channels AS length_ok, largest BETWEEN 0 AND (1 << depth) - 1 AS range_ok,
      w = 0 OR h = 0 OR (stride >= w AND length >= (h - 1) * stride + w) AS stride_ok FROM p""",
)
def picture_checks(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    near = lambda c: F.rint(c).cast("bigint")
    c = {"w": F.col("l_partkey") % 40, "h": F.col("l_suppkey") % 30, "channels": F.col("l_linenumber") % 4, "length": near(F.col("l_quantity") * 20), "largest": near(F.col("l_extendedprice") / 64), "stride": F.col("l_partkey") % 37 + 4}
    found = s.picture_checks(c, 8 + 2 * (F.col("l_linenumber") % 3), near(F.col("l_discount") * 1500))
    return t.select("l_orderkey", "l_linenumber", *[x.alias(n) for n, x in found.items()])


def var_sql(size: int) -> str:
    return f"b AS (SELECT y // {size} AS brow, x // {size} AS bcol, sum(v)::BIGINT AS a, sum(v * v)::BIGINT AS q, count(*)::BIGINT AS n FROM raw GROUP BY ALL), var AS (SELECT brow, bcol, q // n - (a // n) * (a // n) AS var FROM b)"


@query("block_variance", f"WITH {planes.RAW_SQL}, {var_sql(8)} SELECT brow, bcol, var FROM var")
def block_variance(spark, sf_dir):
    return blocks.variance(planes.samples(planes.embedding_rows(spark, sf_dir)), 8)


@query(
    "aq_target_qp",
    f"""WITH {planes.RAW_SQL}, {var_sql(32)}, e AS (SELECT brow, bcol, log2(1.0 + greatest(0, var)) AS e FROM var)
    SELECT brow, bcol, least(51, greatest(7, {QP} + least(6, greatest(-6, round(e - (SELECT avg(e) FROM e))::BIGINT))))::BIGINT AS qp FROM e""",
)
def aq_target_qp(spark, sf_dir):
    return blocks.adaptive_qp(planes.samples(planes.embedding_rows(spark, sf_dir)), QP)


@query(
    "block_gradient",
    f"""WITH {planes.RAW_SQL}, k AS (SELECT y // 8 AS brow, x // 8 AS bcol, y, x, v FROM raw),
    d AS (SELECT brow, bcol, abs(lead(v) OVER (PARTITION BY brow, bcol, y ORDER BY x) - v) AS dx, abs(lead(v) OVER (PARTITION BY brow, bcol, x ORDER BY y) - v) AS dy FROM k)
    SELECT brow, bcol, coalesce(sum(dx), 0)::BIGINT AS gx, coalesce(sum(dy), 0)::BIGINT AS gy FROM d GROUP BY brow, bcol""",
)
def block_gradient(spark, sf_dir):
    return blocks.gradients(planes.embedding_rows(spark, sf_dir), 8)


def _satd(n: int) -> None:
    signs = ", ".join(f"({k}, {i}, {v})" for k, row in enumerate(blocks.hadamard(n)) for i, v in enumerate(row))
    QUERIES[f"satd_{n}x{n}"] = lambda spark, sf_dir: blocks.satd(rows_of(spark, sf_dir, n).withColumn("row", F.transform("row", lambda v: v - 128)), n)
    ORACLE_SQL[f"satd_{n}x{n}"] = f"""WITH {planes.plane_sql(n)}, m(k, i, m) AS (VALUES {signs}),
    a AS (SELECT y // {n} AS brow, x // {n} AS bcol, y % {n} AS j, k AS u, sum((v - 128) * m)::BIGINT AS t FROM plane JOIN m ON i = x % {n} GROUP BY ALL),
    b AS (SELECT brow, bcol, u, k, sum(t * m)::BIGINT AS c FROM a JOIN m ON i = j GROUP BY ALL) SELECT brow, bcol, sum(abs(c))::BIGINT AS satd FROM b GROUP BY brow, bcol"""


_satd(4)
_satd(8)


@query("psnr", f"WITH {planes.RAW_SQL}, p AS (SELECT y // 16 AS band, avg(((v - v // 8 * 8) * (v - v // 8 * 8))::DOUBLE) AS mse FROM raw GROUP BY ALL) SELECT band, round(10 * log10(65025 / mse), 6) AS psnr FROM p WHERE mse > 0")
def psnr(spark, sf_dir):
    d = planes.samples(planes.embedding_rows(spark, sf_dir)).select(F.expr("y div 16").alias("band"), (F.col("v") % 8).alias("d"))
    mse = d.groupBy("band").agg(F.avg((F.col("d") * F.col("d")).cast("double")).alias("mse")).where("mse > 0")
    return mse.select("band", F.round(10 * F.log10(65025 / F.col("mse")), 6).alias("psnr"))


@query(
    "split_quadtree",
    f"""WITH RECURSIVE {planes.RAW_SQL}, {', '.join(f"v{n} AS (SELECT y // {n} AS brow, x // {n} AS bcol, sum(v)::BIGINT AS a, sum(v * v)::BIGINT AS q, count(*)::BIGINT AS c FROM raw GROUP BY ALL)" for n in (8, 16, 32, 64))},
    s AS ({' UNION ALL '.join(f"SELECT {n} AS size, brow, bcol, q // c - (a // c) * (a // c) > {64 + QP * QP} AS busy FROM v{n}" for n in (8, 16, 32, 64))}),
    t AS (SELECT size, brow, bcol, busy FROM s WHERE size = 64 UNION ALL
          SELECT s.size, s.brow, s.bcol, s.busy FROM t JOIN s ON t.busy AND t.size > 8 AND s.size = t.size // 2 AND s.brow // 2 = t.brow AND s.bcol // 2 = t.bcol)
    SELECT bcol * size AS x, brow * size AS y, size::BIGINT AS size FROM t WHERE size = 8 OR NOT busy""",
)
def split_quadtree(spark, sf_dir):
    return blocks.quadtree(planes.embedding_rows(spark, sf_dir), QP)


def _oblong(name: str, w: int, h: int) -> None:
    """SQL with the order of splits written out for the block's shape."""
    fits = {"quad": min(w, h) // 2, "bin_v": w // 2, "bin_h": h // 2, "tri_v": w // 4, "tri_h": h // 4}
    first = lambda order: next((f"'{k}'" for k in order.split() if fits[k] >= 8), "'none'")
    across, down, even = first("bin_v tri_v quad bin_h tri_h"), first("bin_h tri_h quad bin_v tri_v"), first("quad bin_v bin_h tri_v tri_h")
    busy = across if w >= 2 * h else down if h >= 2 * w else f"CASE WHEN gx * 4 > gy * 5 THEN {across} WHEN gy * 4 > gx * 5 THEN {down} ELSE {even} END"
    QUERIES[name] = lambda spark, sf_dir: blocks.oblong_split(planes.embedding_rows(spark, sf_dir), w, h, QP)
    ORACLE_SQL[name] = f"""WITH {planes.RAW_SQL}, k AS (SELECT y // {h} AS brow, x // {w} AS bcol, y, x, v FROM raw),
    d AS (SELECT a.brow, a.bcol, a.v, abs(r.v - a.v) AS dx, abs(u.v - a.v) AS dy FROM k a LEFT JOIN k r ON r.y = a.y AND r.x = a.x + 1 AND r.bcol = a.bcol LEFT JOIN k u ON u.x = a.x AND u.y = a.y + 1 AND u.brow = a.brow),
    t AS (SELECT brow, bcol, sum(v)::BIGINT AS a, sum(v * v)::BIGINT AS q, count(*) AS n, coalesce(sum(dx), 0) AS gx, coalesce(sum(dy), 0) AS gy FROM d GROUP BY brow, bcol)
    SELECT brow, bcol, CASE WHEN q // n - (a // n) * (a // n) < {64 + QP * QP} THEN 'none' ELSE {busy} END AS split FROM t"""


_oblong("split_oblong_32x32", 32, 32)
_oblong("split_oblong_64x16", 64, 16)
_oblong("split_oblong_16x32", 16, 32)


def _leaf_sql(select: str) -> str:
    return f"""WITH l AS MATERIALIZED ({ORACLE_SQL['split_quadtree']}), c AS (SELECT p AS cx, r AS cy, x, y, size FROM l, unnest(range(x // 4, (x + size) // 4)) a(p), unnest(range(y // 4, (y + size) // 4)) b(r)) {select}"""


@query("leaf_cells", _leaf_sql("SELECT cx, cy, x, y, size FROM c"))
def leaf_cells(spark, sf_dir):
    return blocks.cells(split_quadtree(spark, sf_dir))


@query(
    "leaf_neighbours",
    _leaf_sql("SELECT l.x, l.y, l.size, a.size AS left_size, b.size AS above_size FROM l LEFT JOIN c a ON a.cx = (l.x - 4) // 4 AND a.cy = (l.y + l.size - 1) // 4 LEFT JOIN c b ON b.cy = (l.y - 4) // 4 AND b.cx = (l.x + l.size - 1) // 4"),
)
def leaf_neighbours(spark, sf_dir):
    return blocks.cell_neighbours(split_quadtree(spark, sf_dir))


def scan_sql(w: int, h: int) -> str:
    """Groups along the diagonals, positions along the diagonals of a group; in a diagonal from its lower left end."""
    return f"""SELECT row_number() OVER (ORDER BY x // 4 + y // 4, x // 4, x % 4 + y % 4, x % 4) - 1 AS pos, x, y FROM range(0, {w}) a(x), range(0, {h}) b(y)"""


def _scanned_sql(w: int, h: int) -> str:
    return f"SELECT {w}::BIGINT AS w, {h}::BIGINT AS h, brow, bcol, pos, c FROM (WITH {forward_sql(w, h)}, o AS ({scan_sql(w, h)}) SELECT brow, bcol, pos, c FROM coef JOIN o ON x = u AND o.y = v)"


@query("scan_order", " UNION ALL ".join(_scanned_sql(w, h) for w, h in ((8, 8), (16, 8))))
def scan_order(spark, sf_dir):
    """The coefficients of every 8 x 8 and 16 x 8 block in the order in which they are coded."""
    out = None
    for w, h in ((8, 8), (16, 8)):
        found = trellis.in_scan_order(transforms.forward(rows_of(spark, sf_dir, h), w, h), w, h).select("brow", "bcol", F.posexplode("scanned").alias("pos", "c"))
        one = found.select(F.lit(w).cast("bigint").alias("w"), F.lit(h).cast("bigint").alias("h"), "brow", "bcol", F.col("pos").cast("bigint").alias("pos"), "c")
        out = one if out is None else out.union(one)
    return out


@query(
    "last_sig_pos",
    f"""WITH {forward_sql(8, 8)}, o AS ({scan_sql(8, 8)}) SELECT brow, bcol, max(CASE WHEN {quant_sql('c', 8, 8, QP)} <> 0 THEN pos ELSE -1 END) AS last, max(CASE WHEN {quant_sql('c', 8, 8, QP)} <> 0 THEN pos ELSE -1 END) >= 0 AS cbf
    FROM coef JOIN o ON o.x = u AND o.y = v GROUP BY brow, bcol""",
)
def last_sig_pos(spark, sf_dir):
    levels = transforms.forward(rows_of(spark, sf_dir, 8), 8, 8).withColumn("c", transforms.quantize(F.col("c"), 8, 8, QP))
    return blocks.last_significant(levels, scan(8, 8))


SIGNAL = "sig AS (SELECT user_id, event_id AS i, floor(value)::BIGINT AS v FROM events)"
LINE = "OVER (PARTITION BY user_id ORDER BY i)"


@query(
    "ref_substitution",
    f"WITH {SIGNAL}, k AS (SELECT *, CASE WHEN v % 3 <> 0 THEN v END AS seen FROM sig) SELECT user_id, i, coalesce(last(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), first(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 128) AS s FROM k",
)
def ref_substitution(spark, sf_dir):
    return neighbours.substituted(planes.event_signal(spark, sf_dir), "user_id", "i", F.col("v") % 3 != 0, 128).select("user_id", "i", F.col("s").cast("bigint").alias("s"))


@query("ref_smoothing", f"WITH {SIGNAL}, k AS (SELECT user_id, i, v, lag(v) {LINE} AS b, lead(v) {LINE} AS a FROM sig) SELECT user_id, i, CASE WHEN a IS NULL OR b IS NULL THEN v ELSE (b + 2 * v + a + 2) >> 2 END AS f FROM k")
def ref_smoothing(spark, sf_dir):
    return neighbours.smoothed(planes.event_signal(spark, sf_dir), "user_id", "i").select("user_id", "i", "f")


@query("bdpcm_forward", f"WITH {SIGNAL} SELECT user_id, i, v - coalesce(lag(v) {LINE}, 0) AS d FROM sig")
def bdpcm_forward(spark, sf_dir):
    return neighbours.differences(planes.event_signal(spark, sf_dir), "user_id", "i").select("user_id", "i", "d")


@query("bdpcm_inverse", f"WITH {SIGNAL} SELECT user_id, i, v AS r FROM sig")
def bdpcm_inverse(spark, sf_dir):
    d = neighbours.differences(planes.event_signal(spark, sf_dir), "user_id", "i").drop("v")
    return neighbours.running_sums(d, "user_id", "i").select("user_id", "i", "r")


W = "(({}) % 64 + 2)"


def mpm_sql() -> str:
    low, high = "least(a, b)", "greatest(a, b)"
    under, over, under2, over2 = (lambda m, k=k: W.format(f"{m} + {k}") for k in (61, -1, 60, 0))
    one = f"[0, {high}, {under(high)}, {over(high)}, {under2(high)}, {over2(high)}]"
    pair = lambda *v: f"[0, a, b, {', '.join(v)}]"
    return f"""SELECT l_orderkey, l_linenumber, a AS left_mode, b AS above_mode, unnest(range(0, 6)) AS k, unnest(CASE
        WHEN a = b AND a > 1 THEN {one}
        WHEN a <> b AND {low} > 1 THEN CASE WHEN abs(a - b) = 1 THEN {pair(under(low), over(high), under2(low))} WHEN abs(a - b) >= 62 THEN {pair(over(low), under(high), over2(low))}
             WHEN abs(a - b) = 2 THEN {pair(over(low), under(low), over(high))} ELSE {pair(under(low), over(low), under(high))} END
        WHEN a <> b AND {high} > 1 THEN {one} ELSE [0, 1, 50, 18, 46, 54] END) AS mode FROM (SELECT *, l_partkey % 67 AS a, (l_partkey // 67 + l_linenumber * 5 + l_suppkey) % 67 AS b FROM lineitem)"""


@query("mpm_list", mpm_sql())
def mpm_list(spark, sf_dir):
    left, above = F.col("l_partkey") % 67, (F.expr("l_partkey div 67") + F.col("l_linenumber") * 5 + F.col("l_suppkey")) % 67
    drawn = lines(spark, sf_dir).select(*KEYS, left.alias("left_mode"), above.alias("above_mode"))
    found = drawn.select("*", F.posexplode(modes.likely_modes(F.col("left_mode"), F.col("above_mode"))).alias("k", "mode"))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("k", "mode")})


@query("chroma_candidates", "SELECT l_orderkey, l_linenumber, m AS luma_mode, unnest(range(0, 4)) AS k, unnest([CASE WHEN c = m THEN 66 ELSE c END FOR c IN [0, 50, 18, 1]])::BIGINT AS mode FROM (SELECT *, l_partkey % 67 AS m FROM lineitem)")
def chroma_candidates(spark, sf_dir):
    found = lines(spark, sf_dir).select(*KEYS, (F.col("l_partkey") % 67).alias("luma_mode")).select("*", F.posexplode(modes.chroma_modes(F.col("luma_mode"))).alias("k", "mode"))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("k", "mode")})


#: A block's shape and mode out of a line's keys: logarithms p and q of its sides, and m.
SHAPES = "SELECT l_orderkey, l_linenumber, (4 << (l_partkey % 5)::INTEGER)::BIGINT AS w, (4 << (l_suppkey % 5)::INTEGER)::BIGINT AS h, (l_orderkey + l_linenumber) % 67 AS m, l_partkey % 5 + 2 AS p, l_suppkey % 5 + 2 AS q, [0, 6, 10, 12, 14, 15][(abs(l_partkey % 5 - l_suppkey % 5) + 1)::INTEGER] AS e FROM lineitem"


def shapes(spark, sf_dir) -> DataFrame:
    """(keys, w, h, mode) drawn from ``lineitem``."""
    side = lambda c: F.pow(F.lit(2.0), F.col(c) % 5 + 2).cast("bigint")
    return lines(spark, sf_dir).select(*KEYS, side("l_partkey").alias("w"), side("l_suppkey").alias("h"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 67).alias("mode"))


def angle_sql(back: int) -> str:
    return f"CASE WHEN m > 1 AND w > h AND m < 2 + e THEN m + 65 WHEN m > 1 AND h > w AND m > 66 - e THEN m - {back} ELSE m END"


@query("wide_angle", f"SELECT l_orderkey, l_linenumber, w, h, m AS mode, ({angle_sql(65)})::BIGINT AS predicted, ({angle_sql(67)})::BIGINT AS for_set FROM ({SHAPES})")
def wide_angle(spark, sf_dir):
    at = [F.col(c) for c in ("w", "h", "mode")]
    return shapes(spark, sf_dir).select(*KEYS, *at, modes.wide_angle(*at).cast("bigint").alias("predicted"), modes.wide_angle(*at, back=67).cast("bigint").alias("for_set"))


REFS = f"""{planes.RAW_SQL}, refs AS (SELECT y, list_prepend(t[1], t[2:17]) AS top, list_prepend(t[1], t[18:33]) AS lft, t FROM (SELECT y, list(v ORDER BY x) AS t FROM raw GROUP BY y)),
    places AS (SELECT y AS id, top, lft, t, j, i FROM refs, range(0, 8) a(j), range(0, 8) b(i))"""


def references(spark, sf_dir) -> DataFrame:
    """(id, row, top, left): references of a square block out of each plane row.

    Of a row's 64 samples 16 are the upper and 16 the left references, and those from the 35th on the block's own.
    """
    side = lambda at: F.concat(F.slice("row", 1, 1), F.slice("row", at, 16))
    return planes.embedding_rows(spark, sf_dir).select(F.col("y").alias("id"), "row", side(2).alias("top"), side(18).alias("left"))


def reference_rows(spark, sf_dir, size: int = 8) -> DataFrame:
    """The ``references`` with each position (y, x) of a block."""
    r = references(spark, sf_dir).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    return r.select("id", "row", "top", "left", F.expr(f"cast(_p div {size} as bigint)").alias("y"), (F.col("_p") % size).cast("bigint").alias("x"))


def best_of(refs: DataFrame, modes, taps) -> DataFrame:
    """(id, mode, satd, rank): the four best modes of a 4 x 4 block with its references."""
    line = prediction.reference_line(F.col("top"), F.col("left"), 4).alias("line")
    made = refs.repartition("id").select("id", F.slice("row", 34, 16).alias("own"), line)  # few large row groups, much work a row
    return blocks.best_modes(made.select("id", prediction.residuals("own", "line", modes, taps, 4).alias("residuals")), ["id"], "residuals", modes, 4, 4)


PLANAR = "((((7 - i) * lft[j + 2] + (i + 1) * top[9] + (7 - j) * top[i + 2] + (j + 1) * lft[9]) * 8 + 64) >> 7)"
MEAN = "((list_sum(top[2:9])::BIGINT + list_sum(lft[2:9])::BIGINT + 8) >> 4)"
BLEND = "p + (((32 >> least(31, (2 * i) >> 1)) * (lft[j + 2] - p) + (32 >> least(31, (2 * j) >> 1)) * (top[i + 2] - p) + 32) >> 6)"


@query("pred_planar", f"WITH {REFS} SELECT id, j AS y, i AS x, {PLANAR} AS p FROM places")
def pred_planar(spark, sf_dir):
    return reference_rows(spark, sf_dir).select("id", "y", "x", prediction.planar(F.col("top"), F.col("left"), F.col("x"), F.col("y"), 8).alias("p"))


@query("pred_dc", f"WITH {REFS} SELECT id, j AS y, i AS x, {MEAN} AS p FROM places")
def pred_dc(spark, sf_dir):
    return reference_rows(spark, sf_dir).select("id", "y", "x", prediction.mean(F.col("top"), F.col("left"), 8, 8).alias("p"))


@query("pred_pdpc", f"WITH {REFS}, b AS (SELECT *, {PLANAR} AS p FROM places) SELECT id, j AS y, i AS x, {BLEND} AS p FROM b")
def pred_pdpc(spark, sf_dir):
    r = reference_rows(spark, sf_dir)
    t, left, x, y = (F.col(c) for c in ("top", "left", "x", "y"))
    return r.select("id", "y", "x", prediction.position_blend(prediction.planar(t, left, x, y, 8), t, left, x, y, 8, 8).alias("p"))


ANGLES = tuple(range(2, 67))
_AT = "CASE WHEN {0} >= 0 THEN mn[least({0}, 8) + 1] ELSE sd[least(4, ((-({0})) * inv + 256) >> 9) + 1] END"


_ANGULAR = f"""{REFS}, a AS (SELECT id, top, lft, t AS line, j, i, m::BIGINT AS m, CASE WHEN m >= 34 THEN top ELSE lft END AS mn, CASE WHEN m >= 34 THEN lft ELSE top END AS sd, CASE WHEN m >= 34 THEN i ELSE j END AS al, CASE WHEN m >= 34 THEN j ELSE i END AS ac,
        CASE WHEN m >= 34 THEN m - 50 ELSE 18 - m END AS t FROM places, (SELECT unnest({list(ANGLES)}) AS m) WHERE i < 4 AND j < 4),
    b AS (SELECT *, {list(prediction.SLOPES)}[abs(t) + 1] AS sl FROM a),
    c AS (SELECT *, CASE WHEN sl = 0 THEN 0 ELSE round(16384 / sl)::BIGINT END AS inv, (CASE WHEN t < 0 THEN -sl ELSE sl END) * (ac + 1) AS d FROM b),
    e AS (SELECT id, j, i, m, line, d - (d >> 5) * 32 AS f, {_AT.format('((d >> 5) + al + 1)')} AS p, {_AT.format('((d >> 5) + al + 2)')} AS q FROM c)"""


@query("pred_angular_open", f"WITH {_ANGULAR} SELECT id, j AS y, i AS x, m AS mode, p + ((f * (q - p) + 16) >> 5) AS v FROM e")
def pred_angular_open(spark, sf_dir):
    r = reference_rows(spark, sf_dir, 4).withColumn("mode", F.explode(F.array(*[F.lit(m).cast("bigint") for m in ANGLES])))
    return r.select("id", "y", "x", "mode", prediction.angular(F.col("top"), F.col("left"), F.col("x"), F.col("y"), F.col("mode"), 4).alias("v"))


@query(
    "mode_top4_open",
    f"""WITH {_ANGULAR}, hm(k, n, m) AS (VALUES {", ".join(f"({k}, {i}, {v})" for k, row in enumerate(blocks.hadamard(4)) for i, v in enumerate(row))}),
    small AS (SELECT * FROM places WHERE i < 4 AND j < 4),
    pr AS (SELECT id, j, i, m, line, p + ((f * (q - p) + 16) >> 5) AS p FROM e
           UNION ALL SELECT id, j, i, 0, t, (((3 - i) * lft[j + 2] + (i + 1) * top[5] + (3 - j) * top[i + 2] + (j + 1) * lft[5]) * 4 + 16) >> 5 FROM small
           UNION ALL SELECT id, j, i, 1, t, (list_sum(top[2:5])::BIGINT + list_sum(lft[2:5])::BIGINT + 4) >> 3 FROM small),
    r1 AS (SELECT id, pr.m AS mode, j, k AS u, sum((line[34 + j * 4 + i] - p) * hm.m)::BIGINT AS t FROM pr JOIN hm ON n = i GROUP BY ALL),
    r2 AS (SELECT id, mode, u, k, sum(t * hm.m)::BIGINT AS c FROM r1 JOIN hm ON n = j GROUP BY ALL),
    cost AS (SELECT id, mode, sum(abs(c))::BIGINT AS satd FROM r2 GROUP BY ALL)
    SELECT id, mode, satd, row_number() OVER (PARTITION BY id ORDER BY satd, mode) AS rank FROM cost QUALIFY rank <= 4""",
)
def mode_top4_open(spark, sf_dir):
    return best_of(references(spark, sf_dir), (0, 1, *ANGLES), prediction.angular_taps)


@query(
    "cclm_fit",
    f"""WITH {planes.RAW_SQL}, p AS (SELECT y, list(v ORDER BY x) AS t FROM raw GROUP BY y),
    o AS (SELECT y, CASE WHEN t[1] > t[3] THEN [3, 1] ELSE [1, 3] END AS lo, CASE WHEN t[2] > t[4] THEN [4, 2] ELSE [2, 4] END AS hi, t FROM p),
    q AS (SELECT y, t, CASE WHEN t[lo[1]] > t[hi[2]] THEN hi ELSE lo END AS lo, CASE WHEN t[lo[1]] > t[hi[2]] THEN lo ELSE hi END AS hi FROM o),
    n AS (SELECT y, t, CASE WHEN t[lo[2]] > t[hi[1]] THEN [lo[1], hi[1]] ELSE lo END AS lo, CASE WHEN t[lo[2]] > t[hi[1]] THEN [lo[2], hi[2]] ELSE hi END AS hi FROM q),
    m AS (SELECT y, (t[lo[1]] + t[lo[2]] + 1) >> 1 AS a, (t[hi[1]] + t[hi[2]] + 1) >> 1 AS b, (t[lo[1] + 32] + t[lo[2] + 32] + 1) >> 1 AS c, (t[hi[1] + 32] + t[hi[2] + 32] + 1) >> 1 AS d FROM n),
    f AS (SELECT *, b - a AS diff, d - c AS rise, length(bin(greatest(1, b - a))) - 1 AS x0, length(bin(greatest(1, abs(d - c)))) AS z FROM m),
    g AS (SELECT *, ((greatest(1, diff) * 16) >> x0) % 16 AS nd FROM f),
    h AS (SELECT *, 3 + x0 + (CASE WHEN nd <> 0 THEN 1 ELSE 0 END) - z AS sh, (rise * ({list(RECIPROCAL)}[nd + 1] | 8) + ((1 << z) >> 1)) >> z AS a0 FROM g),
    k AS (SELECT *, CASE WHEN sh < 1 THEN sign(a0) * 15 ELSE a0 END AS a1, greatest(1, sh) AS s1 FROM h)
    SELECT y, (CASE WHEN diff <= 0 THEN 0 ELSE a1 END)::BIGINT AS a, (CASE WHEN diff <= 0 THEN c ELSE c - ((a1::BIGINT * a) >> s1) END)::BIGINT AS b, (CASE WHEN diff <= 0 THEN 0 ELSE s1 END)::BIGINT AS shift FROM k""",
)
def cclm_fit(spark, sf_dir):
    r = planes.embedding_rows(spark, sf_dir)
    points = prediction.line_fit(F.slice("row", 1, 4), F.slice("row", 33, 4))
    return r.select("y", *[c.alias(n) for n, c in points.items()]).select("y", prediction.line_terms(*[F.col(n) for n in points]).alias("t")).select("y", "t.*")


@query(
    "cclm_apply",
    f"SELECT f.y, r.x, least(255, greatest(0, ((f.a * r.v) >> f.shift) + f.b))::BIGINT AS pred FROM ({ORACLE_SQL['cclm_fit']}) f JOIN (WITH {planes.RAW_SQL} SELECT * FROM raw) r ON r.y = f.y AND r.x < 32",
)
def cclm_apply(spark, sf_dir):
    r = planes.embedding_rows(spark, sf_dir)
    points = prediction.line_fit(F.slice("row", 1, 4), F.slice("row", 33, 4))
    fit = r.select("y", "row", *[c.alias(n) for n, c in points.items()]).select("y", "row", prediction.line_terms(*[F.col(n) for n in points]).alias("t"))
    luma = fit.select("y", "t", F.posexplode(F.slice("row", 1, 32)).alias("x", "v"))
    return luma.select("y", F.col("x").cast("bigint").alias("x"), prediction.from_luma(F.col("v"), F.col("t.a"), F.col("t.b"), F.col("t.shift")).alias("pred"))


@query("ue_codes", "SELECT l_orderkey, l_linenumber, v, repeat('0', length(bin(v + 1)) - 1) || bin(v + 1) AS code FROM (SELECT *, l_partkey - 1 AS v FROM lineitem)")
def ue_codes(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEYS, (F.col("l_partkey") - 1).alias("v")).withColumn("code", codes.unsigned_exp_golomb(F.col("v")))


@query("se_codes", "SELECT l_orderkey, l_linenumber, v, repeat('0', length(bin(k + 1)) - 1) || bin(k + 1) AS code FROM (SELECT *, CASE WHEN v > 0 THEN 2 * v - 1 ELSE -2 * v END AS k FROM (SELECT *, l_partkey % 301 - 150 AS v FROM lineitem))")
def se_codes(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEYS, (F.col("l_partkey") % 301 - 150).alias("v")).withColumn("code", codes.signed_exp_golomb(F.col("v")))


@query("trunc_binary", "SELECT l_orderkey, l_linenumber, v, CASE WHEN v < 3 THEN lpad(bin(v), 5, '0') ELSE lpad(bin(v + 3), 6, '0') END AS code FROM (SELECT *, l_partkey % 61 AS v FROM lineitem)")
def trunc_binary(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEYS, (F.col("l_partkey") % 61).alias("v")).withColumn("code", codes.truncated_binary(F.col("v"), 61))


@query(
    "rice_codes",
    """WITH g AS (SELECT l_orderkey, l_linenumber, v, k, v >> k AS hi, CASE WHEN k > 0 THEN lpad(bin(v & ((1 << k) - 1)), k::INTEGER, '0') ELSE '' END AS lo FROM (SELECT *, l_partkey % 1500 AS v, (l_linenumber % 4)::BIGINT AS k FROM lineitem)),
    e AS (SELECT *, length(bin(greatest(1, hi - 4))) - 1 AS p FROM g)
    SELECT l_orderkey, l_linenumber, v, k, CASE WHEN hi < 5 THEN repeat('1', hi) || '0' || lo ELSE repeat('1', p + 5) || '0' || CASE WHEN p > 0 THEN lpad(bin(hi - 4 - (1 << p)), p::INTEGER, '0') ELSE '' END || lo END AS code FROM e""",
)
def rice_codes(spark, sf_dir):
    g = lines(spark, sf_dir).select(*KEYS, (F.col("l_partkey") % 1500).alias("v"), (F.col("l_linenumber") % 4).cast("bigint").alias("k"))
    return g.withColumn("code", codes.rice(F.col("v"), F.col("k")))


@query(
    "ctx_init_states",
    """SELECT l_orderkey, l_linenumber, init, qp, w AS window_size, least(127, greatest(1, ((((init >> 3) - 4) * (least(63, greatest(0, qp)) - 16)) >> 1) + (init & 7) * 18 + 1)) AS state, 2 + ((w >> 2) & 3) AS slow, 5 + ((w >> 2) & 3) + (w & 3) AS fast
    FROM (SELECT *, l_partkey % 64 AS init, (l_suppkey + l_linenumber * 9) % 64 AS qp, l_orderkey % 16 AS w FROM lineitem)""",
)
def ctx_init_states(spark, sf_dir):
    g = lines(spark, sf_dir).select(*KEYS, (F.col("l_partkey") % 64).alias("init"), ((F.col("l_suppkey") + F.col("l_linenumber") * 9) % 64).alias("qp"), (F.col("l_orderkey") % 16).alias("window_size"))
    slow, fast = states.adaptation(F.col("window_size"))
    return g.select(*KEYS, "init", "qp", "window_size", states.initial_probability(F.col("init"), F.col("qp")).cast("bigint").alias("state"), slow.cast("bigint").alias("slow"), fast.cast("bigint").alias("fast"))


WALK = f"""{planes.RAW_SQL}, lv AS (SELECT y, list((v - 128) // 16 ORDER BY x) AS l FROM raw GROUP BY y),
    w AS (SELECT y, 1 AS k, 0 AS st, l FROM lv UNION ALL SELECT y, k + 1, (32040 >> (4 * st + 2 * (abs(l[k]) % 2)::INTEGER)) & 3, l FROM w WHERE k < 64)"""


@query("dq_state_walk", f"WITH RECURSIVE {WALK} SELECT y, k - 1 AS x, st AS state FROM w")
def dq_state_walk(spark, sf_dir):
    levels = F.transform("row", lambda v: F.expr("0") + blocks.whole(v - 128, F.lit(16)))
    r = planes.embedding_rows(spark, sf_dir).select("y", F.posexplode(states.walk(levels)).alias("x", "state"))
    return r.select("y", "x", "state")


_F, _, _S = dequant_terms(8, 8, QP + 1)


@query("dq_dequant", f"WITH RECURSIVE {WALK} SELECT y, k - 1 AS x, l[k] AS level, least(32767, greatest(-32768, ((2 * l[k] - sign(l[k])::BIGINT * (st >> 1)) * {_F} + {1 << _S}) >> {_S + 1}))::BIGINT AS c FROM w")
def dq_dequant(spark, sf_dir):
    levels = planes.embedding_rows(spark, sf_dir).select("y", F.transform("row", lambda v: blocks.whole(v - 128, F.lit(16))).alias("l"))
    both = levels.select("y", F.posexplode(F.arrays_zip(F.col("l").alias("level"), states.walk(F.col("l")).alias("state"))).alias("x", "p"))
    return both.select("y", "x", F.col("p.level").alias("level"), states.dequantize(F.col("p.level"), F.col("p.state"), 8, 8, QP).alias("c"))


def _in(v: str, codes_: tuple[int, ...]) -> str:
    return f"(CASE WHEN {v} IN {tuple(codes_)} THEN {v} ELSE 2 END)::INTEGER"


@query("cicp_lookup", f"SELECT l_orderkey, l_linenumber, c::INTEGER AS code, {_in('c', metadata.PRIMARIES)} AS primaries, {_in('c', metadata.TRANSFERS)} AS transfer, {_in('c', metadata.MATRICES)} AS matrix FROM (SELECT *, l_partkey % 300 AS c FROM lineitem)")
def cicp_lookup(spark, sf_dir):
    c = (F.col("l_partkey") % 300).cast("int")
    tables = {"primaries": metadata.PRIMARIES, "transfer": metadata.TRANSFERS, "matrix": metadata.MATRICES}
    return lines(spark, sf_dir).select(*KEYS, c.alias("code"), *[metadata.known(c, t).alias(n) for n, t in tables.items()])


@query(
    "nclx_parse",
    f"""SELECT l_orderkey, l_linenumber, c, '6E636C78' || lpad(hex(c % 25), 4, '0') || lpad(hex(c % 21), 4, '0') || lpad(hex(c % 19), 4, '0') || CASE WHEN c % 2 = 0 THEN '80' ELSE '00' END AS payload,
    {_in('(c % 25)', metadata.PRIMARIES)} AS primaries, {_in('(c % 21)', metadata.TRANSFERS)} AS transfer, {_in('(c % 19)', metadata.MATRICES)} AS matrix, c % 2 = 0 AS "full" FROM (SELECT *, l_partkey AS c FROM lineitem)""",
)
def nclx_parse(spark, sf_dir):
    c = F.col("c")
    made = lines(spark, sf_dir).select(*KEYS, F.col("l_partkey").alias("c")).withColumn("payload", metadata.nclx(c % 25, c % 21, c % 19, c % 2 == 0))
    return made.withColumn("p", metadata.parse_nclx(F.col("payload"))).select(*KEYS, "c", "payload", "p.*")


_O = "CASE WHEN e BETWEEN 1 AND 8 THEN e ELSE 1 END"


@query(
    "exif_orientation",
    f"""SELECT l_orderkey, l_linenumber, e::INTEGER AS exif, ({_O})::INTEGER AS orientation, {list(metadata.TURNS)}[({_O})::INTEGER] AS turns, [NULL, 0, NULL, 1, 0, NULL, 0, NULL][({_O})::INTEGER] AS mirror, ({_O})::INTEGER AS back FROM (SELECT *, l_partkey % 14 - 2 AS e FROM lineitem)""",
)
def exif_orientation(spark, sf_dir):
    o = lines(spark, sf_dir).select(*KEYS, (F.col("l_partkey") % 14 - 2).cast("int").alias("exif")).withColumn("orientation", metadata.orientation(F.col("exif")))
    o = o.withColumns({"turns": metadata.turns(F.col("orientation")), "mirror": metadata.mirror(F.col("orientation"))})
    return o.withColumn("back", metadata.from_parts(F.col("turns"), F.col("mirror")))


def zero_rich(spark, sf_dir) -> DataFrame:
    """(y, raw): hex of each plane row's samples, folded to 0 .. 4 so that zero runs are common."""
    return planes.embedding_rows(spark, sf_dir).select("y", F.array_join(F.transform("row", lambda v: F.lpad(F.hex(F.floor(v % 20 / 4).cast("bigint")), 2, "0")), "").alias("raw"))


ZERO_RICH = f"{planes.RAW_SQL}, z AS (SELECT y, list(((v % 20) // 4)::INTEGER ORDER BY x) AS b FROM raw GROUP BY y)"


@query(
    "epb_insert",
    f"""WITH RECURSIVE {ZERO_RICH}, w AS (SELECT y, b, 0 AS k, 0 AS zeros, '' AS o FROM z UNION ALL
    SELECT y, b, k + 1, CASE WHEN b[k + 1] = 0 THEN CASE WHEN zeros >= 2 THEN 1 ELSE zeros + 1 END ELSE 0 END, o || CASE WHEN zeros >= 2 AND b[k + 1] <= 3 THEN '03' ELSE '' END || lpad(hex(b[k + 1]), 2, '0') FROM w WHERE k < 64)
    SELECT y, o AS protected FROM w WHERE k = 64""",
)
def epb_insert(spark, sf_dir):
    return zero_rich(spark, sf_dir).select("y", codes.protect(F.col("raw")).alias("protected"))


@query("epb_strip", f"WITH {ZERO_RICH} SELECT y, array_to_string(list_transform(b, lambda v: lpad(hex(v), 2, '0')), '') AS raw FROM z")
def epb_strip(spark, sf_dir):
    return zero_rich(spark, sf_dir).select("y", codes.unprotect(codes.protect(F.col("raw"))).alias("raw"))


_UNIT_BYTES = "array_to_string(list_transform(b[{}], lambda v: lpad(hex(v), 2, '0')), '') || '80'"


@query("nal_split", f"WITH {ZERO_RICH} SELECT y, 0 AS seq, 15 AS type, {_UNIT_BYTES.format('1:20')} AS payload FROM z UNION ALL SELECT y, 1, 7, {_UNIT_BYTES.format('21:64')} FROM z")
def nal_split(spark, sf_dir):
    part = lambda at, n: F.concat(F.substring("raw", at, n), F.lit("80"))
    made = zero_rich(spark, sf_dir).select("y", F.concat(streams.unit(F.lit(15), part(1, 40)), streams.unit(F.lit(7), part(41, 88))).alias("stream"))
    return streams.units(made, "y", F.col("stream"))


@query("heif_boxes", f"WITH {ZERO_RICH} SELECT y, 0 AS seq, 'ftyp' AS name, '68656963' AS payload FROM z UNION ALL SELECT y, 1, 'colr', '6E636C78' FROM z UNION ALL SELECT y, 2, 'mdat', array_to_string(list_transform(b, lambda v: lpad(hex(v), 2, '0')), '') FROM z")
def heif_boxes(spark, sf_dir):
    made = zero_rich(spark, sf_dir).select("y", F.concat(streams.box("ftyp", F.lit("68656963")), streams.box("colr", F.lit("6E636C78")), streams.box("mdat", F.col("raw"))).alias("data"))
    return streams.boxes(made, "y", F.col("data"))
