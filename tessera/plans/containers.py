"""Queries on headers and nested containers, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import headers
from ..functions.metadata import hex_of
from ..sources import streams
from .catalogue import ZERO_RICH, query, zero_rich

# A value for field i of the header of part k: digits by kind, sizes in eights, and depths that are mostly allowed.
_VALUE = """CASE WHEN name IN ('coded_width', 'coded_height') THEN 8 * (k * (i + 1) % 500 + 1) WHEN name IN ('crop_right', 'crop_bottom') THEN k * i % 40 WHEN name = 'bit_depth_minus8' THEN [0, 2, 4, 0, 3][(k % 5 + 1)::INTEGER]
    WHEN kind = 0 THEN (k * (2 * i + 3) + i + k // 7) % (1 << width) WHEN kind = 1 THEN k * (i + 5) % 11 WHEN kind = 2 THEN (k + i) % 9 - 4 END"""
_SPEC = ", ".join(f"({i}, '{n}', {kind}, {width}, {f[0] and headers.NAMES.index(f[0]) if (f := rule) else 'NULL'}, {f[1] if f else 0}, {f[2] if f else 0})" for i, (n, kind, width, *rule) in enumerate(headers.FIELDS))
#: From values and lengths alone: a header's fields, where each ends, and which of them the cut leaves. No other field stands before the alignment than fixed ones of 35 digits in all.
_HEADER = f"""spec(i, name, kind, width, o, low, high) AS (VALUES {_SPEC}), w AS (SELECT p_partkey AS k, p_size, i, name, kind, o, low, high, width, ({_VALUE})::BIGINT AS v FROM part, spec),
    a AS (SELECT w.*, w.o IS NULL OR (p.v BETWEEN w.low AND w.high AND (p.o IS NULL OR (g.v BETWEEN p.low AND p.high AND (g.o IS NULL OR h.v BETWEEN g.low AND g.high)))) AS here
          FROM w LEFT JOIN w p ON p.k = w.k AND p.i = w.o LEFT JOIN w g ON g.k = w.k AND g.i = p.o LEFT JOIN w h ON h.k = w.k AND h.i = g.o),
    n AS (SELECT *, CASE WHEN NOT here THEN 0 WHEN kind = 0 THEN width WHEN kind = 3 THEN 5 WHEN kind = 1 THEN 2 * length(bin(v + 1)) - 1 ELSE 2 * length(bin(CASE WHEN v > 0 THEN 2 * v ELSE 1 - 2 * v END)) - 1 END AS n FROM a),
    e AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) AS until, sum(n) OVER (PARTITION BY k) AS total FROM n),
    c AS (SELECT *, CASE WHEN k % 5 = 0 THEN total * (p_size % 40 + 10) // 50 ELSE total END AS kept FROM e)"""


def cut_headers(spark, sf_dir) -> DataFrame:
    """(p_partkey, header): a header of values drawn from each part's key, every fifth one cut off, read again."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition("p_partkey")  # narrow rows in few files, a header's work each

    def value(i: int, name: str, kind: int, width: int) -> str:
        if name in ("coded_width", "coded_height"):
            return f"8 * (p_partkey * {i + 1} % 500 + 1)"
        if name in ("crop_right", "crop_bottom"):
            return f"p_partkey * {i} % 40"
        if name == "bit_depth_minus8":
            return "array(0, 2, 4, 0, 3)[cast(p_partkey % 5 AS int)]"
        return {headers.U: f"(p_partkey * {2 * i + 3} + {i} + p_partkey div 7) % {1 << width}", headers.UE: f"p_partkey * {i + 5} % 11", headers.SE: f"(p_partkey + {i}) % 9 - 4"}.get(kind, "NULL")

    values = ", ".join(f"cast({value(i, *f[:3])} AS bigint)" for i, f in enumerate(headers.FIELDS))
    made = t.select("p_partkey", "p_size", F.expr(f"array({values})").alias("v")).withColumn("whole", headers.written("v"))
    keep = F.expr("cast(if(p_partkey % 5 = 0, length(whole) * (p_size % 40 + 10) div 50, length(whole)) AS int)")
    return made.select("p_partkey", F.substring("whole", F.lit(1), keep).alias("bits")).select("p_partkey", headers.read("bits").alias("header"))


@query("header_fields", f"WITH {_HEADER} SELECT k AS p_partkey, i::BIGINT AS at, name AS field, v AS value FROM c WHERE here AND kind <> 3 AND until <= kept")
def header_fields(spark, sf_dir):
    names = F.array(*map(F.lit, headers.NAMES))
    # Outer: for a plain one Spark adds a filter on the array's size below, and makes every header again for it.
    each = cut_headers(spark, sf_dir).select("p_partkey", F.posexplode_outer("header.out").alias("at", "value")).where("value IS NOT NULL")
    return each.select("p_partkey", F.col("at").cast("bigint").alias("at"), F.element_at(names, F.col("at") + 1).alias("field"), "value")


_OF = lambda name: f"max(v) FILTER (name = '{name}' AND here)"
_FLAG = lambda name: f"coalesce({_OF(name)}, 0) > 0"


@query(
    "header_summary",
    f"""WITH {_HEADER}, s AS (SELECT k AS p_partkey, any_value(kept) < any_value(total) AS cut, {_OF('chroma_format_idc')} AS idc, {_OF('coded_width')} AS cw, {_OF('coded_height')} AS ch, coalesce({_OF('crop_right')}, 0) AS cr, coalesce({_OF('crop_bottom')}, 0) AS cb, {_OF('bit_depth_minus8')} + 8 AS depth,
        {_FLAG('bdpcm')} AS lossless, {_FLAG('mtt_depth_luma')} AS mtt, {_FLAG('lfnst')} AS lfnst, {_FLAG('dependent_quant')} AS dep_quant, {_FLAG('mts')} AS mts, {_FLAG('dual_tree')} AS dual_tree, {_FLAG('cclm')} AS cclm FROM c GROUP BY k),
    d AS (SELECT *, cw - cr * CASE WHEN idc IN (1, 2) THEN 2 ELSE 1 END AS width, ch - cb * CASE WHEN idc = 1 THEN 2 ELSE 1 END AS height FROM s),
    f AS (SELECT *, CASE WHEN cut THEN 'cut off' WHEN depth NOT IN (8, 10, 12) THEN 'bit depth' WHEN width < 0 OR height < 0 THEN 'bad crop' END AS error FROM d)
    SELECT p_partkey, error, {', '.join(f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in ('idc', 'width', 'height', 'depth', 'lossless', 'mtt', 'lfnst', 'dep_quant', 'mts', 'dual_tree', 'cclm'))} FROM f""",
)
def header_summary(spark, sf_dir):
    found = headers.summary(F.col("header"))
    return cut_headers(spark, sf_dir).select("p_partkey", *[c.alias(k) for k, c in found.items()])


def files(spark, sf_dir) -> DataFrame:
    """(y, data): a container for each plane row, with two items in its data; some have a broken length, some an extent that lies outside."""
    number = lambda v, n: hex_of(v.cast("bigint") if not isinstance(v, int) else F.lit(v), 2 * n)
    y = F.col("y")
    first = 16 + y % 32
    extent = lambda at, length: F.concat(number(at, 4), number(length, 4))
    entry = lambda item, *extents: F.concat(number(item, 2), number(0, 2), number(len(extents), 2), *extents)
    far = F.when(y % 11 == 5, 100_000).otherwise(158)
    iloc = F.concat(F.lit("0000000044000002"), entry(1, extent(far, first)), entry(2, extent(158 + first, F.lit(8)), extent(166 + first, 56 - first)))
    ipco = streams.box("ipco", F.concat(streams.box("ispe", F.lit("00" * 12)), streams.box("colr", F.lit("6E636C78"))))
    ipco = F.when(y % 7 == 3, F.concat(F.lit("00010000"), F.substring(ipco, 9, 1 << 20))).otherwise(ipco)
    meta = F.concat(F.lit("00000000"), streams.box("hdlr", F.lit("70696374")), streams.box("pitm", F.lit("000000000001")), streams.box("iloc", iloc), streams.box("iprp", ipco))
    return zero_rich(spark, sf_dir).select("y", F.concat(streams.box("ftyp", F.lit("68656963")), streams.box("meta", meta), streams.box("mdat", F.col("raw"))).alias("data"))


@query(
    "box_tree",
    f"""WITH {ZERO_RICH}, b(path, parent, name, s, e) AS (VALUES ('0', NULL, 'ftyp', 8, 12), ('1', NULL, 'meta', 20, 150), ('1/0', '1', 'hdlr', 32, 36), ('1/1', '1', 'pitm', 44, 50), ('1/2', '1', 'iloc', 58, 102), ('1/3', '1', 'iprp', 110, 150),
      ('1/3/0', '1/3', 'ipco', 118, 150), ('1/3/0/0', '1/3/0', 'ispe', 126, 138), ('1/3/0/1', '1/3/0', 'colr', 146, 150), ('2', NULL, 'mdat', 158, 222))
    SELECT y, path, parent, CASE WHEN y % 7 = 3 AND name = 'ipco' THEN NULL ELSE name END AS name, (CASE WHEN y % 7 = 3 AND name = 'ipco' THEN 110 ELSE s END)::BIGINT AS start, e::BIGINT AS "end", CASE WHEN y % 7 = 3 AND name = 'ipco' THEN 'broken length' END AS error
    FROM z, b WHERE y % 7 <> 3 OR path NOT LIKE '1/3/0/%'""",
)
def box_tree(spark, sf_dir):
    return streams.box_tree(files(spark, sf_dir), "y", "data")


@query(
    "item_extents",
    f"""WITH {ZERO_RICH}, h AS (SELECT y, array_to_string(list_transform(b, lambda v: lpad(hex(v), 2, '0')), '') AS raw, 16 + y % 32 AS n FROM z),
    x AS (SELECT y, raw, 1 AS item, 0 AS extent, CASE WHEN y % 11 = 5 THEN 100000 ELSE 158 END AS o, n AS l FROM h UNION ALL SELECT y, raw, 2, 0, 158 + n, 8 FROM h UNION ALL SELECT y, raw, 2, 1, 166 + n, 56 - n FROM h)
    SELECT y, item::BIGINT AS item, extent::BIGINT AS extent, o::BIGINT AS "offset", l::BIGINT AS length, CASE WHEN o < 100000 THEN substr(raw, 2 * (o - 158) + 1, 2 * l) END AS payload, CASE WHEN o = 100000 THEN 'outside of the data' END AS error FROM x""",
)
def item_extents(spark, sf_dir):
    made = files(spark, sf_dir)
    return streams.item_extents(made, streams.box_tree(made, "y", "data"), "y", "data")
