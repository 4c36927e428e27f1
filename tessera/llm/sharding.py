"""Sharding by weighted rendezvous hashing, all in DataFrame functions.

Every shard draws a number for a record's key; the best draw wins. A draw depends on the key and the
shard's own number only, so one more shard takes records solely into itself, and a weight of two wins
twice as often. A draw is u = (x1*a + x2*b + c) mod P, with x1 and x2 from the key's MD5 and a, b, c from
the shard's; the smallest -ln(u)/weight wins, ties to the smaller shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import numbered
from .shared import cut, unused

P = 2_147_483_647


def draw_terms(shard: int) -> tuple[int, int, int]:
    """a, b, c of a shard, each in 1 .. P-1."""
    h = hashlib.md5(f"shard {shard}".encode()).hexdigest()
    return tuple(1 + int(h[i : i + 10], 16) % (P - 1) for i in (0, 10, 20))


def key_numbers(key: Column) -> tuple[Column, Column]:
    """Two numbers below P from a key of any simple type; a null key has numbers of its own."""
    digest = F.md5(F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("key "), key.cast("string"))).cast("binary"))
    return tuple(F.conv(F.substring(digest, i, 15), 16, 10).cast("bigint") % P for i in (1, 16))


def _draw(x1: str, x2: str, term: Column) -> Column:
    u = (F.col(x1) * term["a"] + F.col(x2) * term["b"] + term["c"]) % P
    return -F.log((u + 1).cast("double") / (P + 1)) / term["weight"]


def _terms(shards: dict[int, float]) -> Column:
    """The shards' terms as one literal array: an expression for each shard would outgrow generated code."""
    fields = [dict(zip("abc", draw_terms(s), strict=True)) | {"weight": float(w)} for s, w in shards.items()]
    return F.array(*[F.struct(F.lit(s).alias("s"), *[F.lit(v).cast("double" if k == "weight" else "bigint").alias(k) for k, v in f.items()]) for s, f in zip(shards, fields, strict=True)])


def rendezvous(rows: DataFrame, key: str, weights: list[float], name: str = "shard", grown: float | None = None) -> DataFrame:
    """``rows`` with the shard of each key; with ``grown``, also ``grown_<name>``, under one more shard of that weight.

    Null keys share a shard, and so do rows that repeat a key; a tie of draws goes to the smaller shard. All
    other columns stay, whatever their names, but a column named like a result is replaced. No shuffle and
    no state: the shard of a row needs only its key.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight over 0")
    x1, x2 = key_numbers(F.col(key))
    one, two, won = unused(rows, "_x1", "_x2", "_best")
    best = lambda shards: F.array_min(F.transform(_terms(shards), lambda t: F.struct(_draw(one, two, t).alias("d"), t["s"].alias("s"))))
    out = rows.withColumns({one: x1, two: x2}).withColumn(won, best(dict(enumerate(weights)))).withColumn(name, F.col(won)["s"])
    if grown is not None:
        n = len(weights)
        out = out.withColumn(f"grown_{name}", F.when(best({n: grown})["d"] < F.col(won)["d"], F.lit(n)).otherwise(F.col(won)["s"]))
    return out.drop(one, two, won)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every document under the law ``key``.

    Size: UTF-8 bytes of the text (null: none) plus 16. Slots are gapless from 0 in each shard; repeated
    rows get a slot each; a null text counts as empty; other columns are dropped. The narrow rows are
    written once, so texts are read once; only narrow rows are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = numbered(cut(rendezvous(narrow, id_col, [1.0] * shards, "shard", grown=1.0), "shards"), "shard", "slot")
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle_sql(shards: int, parts: int = 64) -> str:
    """DuckDB SQL of the same rows: the draws from the same MD5s, CRC-32 by its table, slots by the same order."""
    terms = ", ".join(f"({s}, {a}, {b}, {c})" for s in range(shards + 1) for a, b, c in [draw_terms(s)])
    return f"""
    WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                 lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
         d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
                      list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM documents),
         k AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
                      coalesce(md5('key ' || doc_id::VARCHAR), md5('null')) AS h FROM d, tab),
         w AS (SELECT h, ('0x' || substr(h, 1, 15))::BIGINT % {P} AS x1, ('0x' || substr(h, 16, 15))::BIGINT % {P} AS x2 FROM (SELECT DISTINCT h FROM k)),
         u AS (SELECT h, s, (x1 * a + x2 * b + c) % {P} AS u FROM w, (VALUES {terms}) v(s, a, b, c)),
         best AS (SELECT h, arg_max(s, u * 1000 - s) FILTER (s < {shards}) AS shard, arg_max(s, u * 1000 - s) AS grown_shard FROM u GROUP BY h),
         r AS (SELECT doc_id, size, text_crc32, shard, grown_shard, ('0x' || substr(md5(concat_ws(',', coalesce(doc_id::VARCHAR, 'null'), size, text_crc32, shard, grown_shard)), 1, 8))::BIGINT % {parts} AS part
               FROM k JOIN best USING (h))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
           row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32)::BIGINT - 1 AS slot
    FROM r
    """


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
