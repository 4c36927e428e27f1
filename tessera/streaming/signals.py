"""Streams of samples: the block reductions as Structured Streaming jobs. An extension; the batch operators are the library's core."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.transforms import dequantize, quantize


def windowed_variance(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, key, var) of a stream's whole-number samples, with the truncating variance of blocks; rows later than ``late`` are left out."""
    v = F.floor(value).cast("bigint")
    sums = events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.sum(v).alias("a"), F.sum(v * v).alias("b"), F.count("*").alias("n"))
    mean = F.expr("a div n")
    return sums.select("window", key, (F.expr("b div n") - mean * mean).alias("var"))


def quantized(samples: DataFrame, qp: int, size: int = 8, value: str = "c") -> DataFrame:
    """A stream of coefficients with their levels and what these give back; no state."""
    level = quantize(F.col(value), size, size, qp)
    return samples.withColumn("level", level).withColumn("back", dequantize(F.col("level"), size, size, qp))
