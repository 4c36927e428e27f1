"""Sample planes and signals derived from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, row): a plane of 8-bit samples with one embedding a row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), 128 + F.floor(v.cast("double") * 256))).cast("bigint")
    return e.select(F.col("vec_id").alias("y"), F.transform("embedding", level).alias("row"))


def padded(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the last one repeated, so that the height is a multiple of ``size``."""
    last = F.broadcast(rows.agg(F.max("y").alias("_last")))
    end = F.expr(f"(_last div {size} + 1) * {size} - 1")
    every = F.when(F.col("y") == F.col("_last"), F.sequence("_last", end)).otherwise(F.array("y"))
    return rows.join(last).withColumn("y", F.explode(every)).drop("_last")


def samples(rows: DataFrame) -> DataFrame:
    """(y, x, v): a row for each sample."""
    return rows.select("y", F.posexplode("row").alias("x", "v")).withColumn("x", F.col("x").cast("bigint"))


def pixels(rows: DataFrame) -> DataFrame:
    """(y, x, r, g, b): every three samples of a row as one RGB pixel; a last incomplete one is left out."""
    at = F.explode(F.sequence(F.lit(0), F.lit(WIDTH // 3 - 1))).alias("x")
    part = lambda k: F.element_at("row", (F.col("x") * 3 + k).cast("int"))
    return rows.select("y", "row", at).select("y", F.col("x").cast("bigint").alias("x"), part(1).alias("r"), part(2).alias("g"), part(3).alias("b"))


def channels(rows: DataFrame, names: str) -> DataFrame:
    """(y, x, one column a channel): rows of interleaved samples; a last incomplete pixel is left out."""
    n = len(names)
    at = rows.select("y", "row", F.explode(F.sequence(F.lit(0), F.lit(WIDTH // n - 1))).alias("x"))
    return at.select("y", F.col("x").cast("bigint").alias("x"), *[F.element_at("row", F.col("x") * n + k + 1).alias(c) for k, c in enumerate(names)])


def resampled(rows: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """``rows`` of a chroma plane subsampled by ``source`` (across, down) at the coarser or finer ``target``, by index."""
    (sw, sh), (tw, th) = source, target
    wide = -(-WIDTH * sw // tw)
    x = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda k: F.least(F.floor(k * tw / sw), F.lit(WIDTH - 1)).cast("int"))
    across = rows.select("y", F.transform(x, lambda k: F.element_at("row", k + 1)).alias("row"))
    # Row y is taken by every target row t with t * th div sh = y.
    first, last = F.expr(f"(y * {sh} + {th - 1}) div {th}"), F.expr(f"((y + 1) * {sh} + {th - 1}) div {th} - 1")
    return across.where(last >= first).select(F.explode(F.sequence(first, last)).alias("y"), "row")


def pairs(hex_text: Column) -> Column:
    """The unsigned numbers of little-endian byte pairs; a last odd byte is left out."""
    every = F.regexp_extract_all(hex_text, F.lit("(....)"), 1)
    return F.transform(every, lambda p: F.conv(F.concat(F.substring(p, 3, 2), F.substring(p, 1, 2)), 16, 10).cast("bigint"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(brow, bcol, block): an array of row parts for each block; rows must be padded to a multiple of ``size``."""
    at = rows.select("y", "row", F.explode(F.sequence(F.lit(0), F.lit(WIDTH // size - 1))).alias("bcol"))
    part = F.struct(F.col("y"), F.slice("row", F.col("bcol") * size + 1, size).alias("part"))
    found = at.groupBy(F.expr(f"y div {size}").alias("brow"), F.col("bcol").cast("bigint").alias("bcol")).agg(F.sort_array(F.collect_list(part)).alias("block"))
    return found.withColumn("block", F.transform("block", lambda b: b["part"]))


def placed(found: DataFrame, size: int) -> DataFrame:
    """(y, x, v): the samples of blocks at their places; needs no shuffle."""
    rows = found.select("brow", "bcol", F.posexplode("block").alias("j", "part"))
    return rows.select((F.col("brow") * size + F.col("j")).alias("y"), "bcol", F.posexplode("part").alias("i", "v")).select("y", (F.col("bcol") * size + F.col("i")).alias("x"), "v")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, v): the whole part of each event's value, in the order of event_id within a user."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("i"), F.floor("value").cast("bigint").alias("v"))


RAW_SQL = """raw AS (SELECT vec_id AS y, i - 1 AS x, least(255, greatest(0, 128 + floor(embedding[i]::DOUBLE * 256)::BIGINT)) AS v
                     FROM embeddings, range(1, 65) r(i))"""


def plane_sql(size: int) -> str:
    """Common table expressions that end in plane(y, x, v), padded to ``size`` rows."""
    return f"""{RAW_SQL}, h AS (SELECT max(y) + 1 AS h FROM raw),
     g AS (SELECT unnest(range(0, ((h + {size - 1}) // {size}) * {size})) AS y, h FROM h),
     plane AS (SELECT g.y, x, v FROM g JOIN raw ON raw.y = least(g.y, h - 1))"""
