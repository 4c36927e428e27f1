"""Gapless numbers within keys, however many rows one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_of(cols: list[str], parts: int) -> Column:
    digest = F.md5(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % parts


#: Rows of a part, about, when all rows have one key.
PART_ROWS = 1_000_000


def numbered(rows: DataFrame, key: str, name: str, parts: int = 64) -> DataFrame:
    """``rows`` with a long column ``name``: 0, 1, 2 ... within each value of ``key`` (never null).

    ``rows`` should be a written table, as it is read three times. The rows of a key are dealt over windows by
    the MD5 of all columns, ``parts`` of them or as many as hold PART_ROWS each, so no task holds a key;
    equal rows are first counted on the map side, so copies do not gather either. A second, small window
    over one count a part and key gives each part its first number. Order: by part, then by columns.
    """
    cols, parts = rows.columns, max(parts, -(-rows.count() // PART_ROWS))
    counted = rows.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("_part", part_of(cols, parts))
    sizes = counted.groupBy(key, "_part").agg(F.sum("_n").alias("_size"))
    first = sizes.select(key, "_part", (F.sum("_size").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_first"))
    within = Window.partitionBy(key, "_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_at", F.sum("_n").over(within) - F.col("_n")).join(first, [key, "_part"])
    return placed.select(*cols, F.explode(F.sequence(F.col("_first") + F.col("_at"), F.col("_first") + F.col("_at") + F.col("_n") - 1)).alias(name))
