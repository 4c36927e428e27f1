"""Bit strings of variable-length codes, and bytes of a stream, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(v: Column, width: Column) -> Column:
    """``v`` in ``width`` binary digits; none for a width of 0."""
    return F.when(width > 0, F.lpad(F.bin(v), width.cast("int"), "0")).otherwise("")


def unsigned_exp_golomb(v: Column) -> Column:
    code = F.bin(v + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def signed_exp_golomb(v: Column) -> Column:
    """1, -1, 2, -2 ... are coded as 1, 2, 3, 4 ..."""
    return unsigned_exp_golomb(F.when(v > 0, 2 * v - 1).otherwise(-2 * v))


def truncated_binary(v: Column, symbols: int) -> Column:
    """The first symbols take one digit less than the others."""
    width = symbols.bit_length() - 1
    short = (2 << width) - symbols
    return F.when(v < short, bits(v, F.lit(width))).otherwise(bits(v + short, F.lit(width + 1)))


def rice(v: Column, k: Column, cutoff: int = 5) -> Column:
    """Rice code of a value under cutoff * 2**k; from there on an exponential-Golomb escape."""
    high = F.floor(v / F.pow(F.lit(2.0), k)).cast("bigint")
    low = bits(v - high * F.pow(F.lit(2.0), k).cast("bigint"), k)
    prefix = F.length(F.bin(high - cutoff + 1)) - 1  # of the escape, above the cutoff's ones
    rest = high - cutoff + 1 - F.pow(F.lit(2.0), prefix).cast("bigint")
    plain = F.concat(F.repeat(F.lit("1"), high.cast("int")), F.lit("0"), low)
    escape = F.concat(F.repeat(F.lit("1"), prefix + cutoff), F.lit("0"), bits(rest, prefix), low)
    return F.when(high < cutoff, plain).otherwise(escape)


def byte_list(hex_text: Column) -> Column:
    """Upper-case hex as a list of two-digit bytes."""
    return F.regexp_extract_all(hex_text, F.lit("(..)"), 1)


def protect(hex_text: Column) -> Column:
    """Hex with a byte 03 before every byte 00 to 03 that follows two zero bytes, so that no start code occurs."""
    zero, low = F.lit("00"), ("00", "01", "02", "03")

    def step(s: Column, b: Column) -> Column:
        caught = (s["zeros"] >= 2) & b.isin(*low)
        zeros = F.when(b == zero, F.when(caught, 1).otherwise(s["zeros"] + 1)).otherwise(0)
        return F.struct(F.concat(s["out"], F.when(caught, F.lit("03")).otherwise(""), b).alias("out"), zeros.alias("zeros"))

    return F.aggregate(byte_list(hex_text), F.struct(F.lit("").alias("out"), F.lit(0).alias("zeros")), step, lambda s: s["out"])


def unprotect(hex_text: Column) -> Column:
    """Hex without the bytes 03 that follow two zero bytes."""

    def step(s: Column, b: Column) -> Column:
        drop = (s["zeros"] >= 2) & (b == "03")
        zeros = F.when(drop, 0).when(b == "00", s["zeros"] + 1).otherwise(0)
        return F.struct(F.concat(s["out"], F.when(drop, F.lit("")).otherwise(b)).alias("out"), zeros.alias("zeros"))

    return F.aggregate(byte_list(hex_text), F.struct(F.lit("").alias("out"), F.lit(0).alias("zeros")), step, lambda s: s["out"])


def read_bits(bits_: Column, at: Column, width: Column) -> Column:
    """The number in ``width`` digits from place ``at`` (0: the first); null if they are not there."""
    part = F.substring(bits_, at.cast("int") + 1, width.cast("int"))
    return F.when(F.length(part) == width, F.conv(part, 2, 10).cast("bigint"))


def read_unsigned(bits_: Column, at: Column) -> Column:
    """Struct of the value of the exponential-Golomb code at ``at`` and the digits it used; nulls if it is cut off."""
    zeros = F.instr(F.substring(bits_, at.cast("int") + 1, F.length(bits_)), "1") - 1
    value = F.when(zeros >= 0, read_bits(bits_, at + zeros, zeros + 1) - 1)
    return F.struct(value.alias("value"), F.when(value.isNotNull(), 2 * zeros + 1).alias("used"))


def read_signed(bits_: Column, at: Column) -> Column:
    code = read_unsigned(bits_, at)
    k = code["value"]
    half = F.floor((k + 1) / 2).cast("bigint")
    return F.struct(F.when(k % 2 == 1, half).otherwise(-half).alias("value"), code["used"].alias("used"))


def only_stop_bit(bits_: Column, at: Column) -> Column:
    """Whether from ``at`` on there is nothing but a one and zeros."""
    return F.substring(bits_, at.cast("int") + 1, F.length(bits_)).rlike("^10*$")
