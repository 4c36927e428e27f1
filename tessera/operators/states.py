"""Small state machines as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.samples import clip
from ..functions.tables import dequant_terms

# Fixed value: next states of the dependent quantizer, two bits for each state and parity.
NEXT = 32_040


def after(state: Column, level: Column) -> Column:
    """The quantizer's state after a level."""
    return F.floor(F.lit(NEXT) / F.pow(F.lit(2.0), 4 * state + 2 * F.abs(level % 2))).cast("int") % 4


def walk(levels: Column) -> Column:
    """The state in which each level of an array was coded; the first in state 0."""
    step = lambda s, v: F.struct(after(s["state"], v).alias("state"), F.concat(s["out"], F.array(s["state"])).alias("out"))
    return F.aggregate(levels, F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])


def dequantize(level: Column, state: Column, w: int, h: int, qp: int) -> Column:
    """A coefficient from its level and the state it was coded in."""
    odd = F.when(level > 0, -F.floor(state / 2)).when(level < 0, F.floor(state / 2)).otherwise(0).cast("bigint")
    factor, _, shift = dequant_terms(w, h, qp + 1)
    return clip(F.shiftright((2 * level + odd) * factor + (1 << shift), shift + 1), -32768, 32767)


def initial_probability(init: Column, qp: Column) -> Column:
    """The 7-bit state in which a context starts a slice, from its 6-bit initial value."""
    slope, offset = F.floor(init / 8).cast("int") - 4, (init % 8) * 18 + 1
    return clip(F.shiftright(slope * (clip(qp, 0, 63) - 16), 1) + offset, 1, 127)


def adaptation(window: Column) -> tuple[Column, Column]:
    """The two rates of a context, from its 4-bit window size."""
    slow = 2 + F.floor(window / 4).cast("int") % 4
    return slow, 3 + slow + window % 4


# The digits that each of a context's two estimates keeps.
KEPT = (0x7FE0, 0x7FFE)


def adapted(bins: Column, start: int, slow: int, fast: int) -> Column:
    """The 8-bit probability of a one before each of an array's bins, both estimates from ``start`` on."""

    def moved(v: Column, b: Column, rate: int, digits: int) -> Column:
        kept = v - F.shiftright(v, rate).bitwiseAND(F.lit(digits))
        return kept + F.when(b == 1, (0x7FFF >> rate) & digits).otherwise(0)

    def step(s: Column, b: Column) -> Column:
        out = F.concat(s["out"], F.array(F.shiftright(s["a"] + s["b"], 8)))
        return F.struct(moved(s["a"], b, slow, KEPT[0]).alias("a"), moved(s["b"], b, fast, KEPT[1]).alias("b"), out.alias("out"))

    return F.aggregate(bins, F.struct(F.lit(start).alias("a"), F.lit(start).alias("b"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])


# Initial values and window sizes of the twelve contexts of a significant level, in slices without references.
SIGNIFICANT = (25, 19, 28, 14, 25, 20, 29, 30, 19, 37, 30, 38)
SIGNIFICANT_WINDOWS = (12, 9, 9, 10, 9, 9, 9, 10, 8, 8, 8, 10)


def contexts(inits: tuple[int, ...], windows: tuple[int, ...], qp: Column) -> Column:
    """An array of contexts (a, b, slow, fast) as a slice of quantizer ``qp`` starts them."""

    def one(init: int, window: int) -> Column:
        start = (initial_probability(F.lit(init), qp) * 256).cast("int")
        slow, fast = adaptation(F.lit(window))
        return F.struct(*[start.bitwiseAND(F.lit(k)).alias(n) for n, k in zip("ab", KEPT, strict=True)], slow.cast("int").alias("slow"), fast.cast("int").alias("fast"))

    return F.array(*[one(i, w) for i, w in zip(inits, windows, strict=True)])


def adapted_each(start: str, bins: str) -> Column:
    """The 8-bit probability of a one before each of the array ``bins`` of (ctx, bin), each bin moving its own of the contexts in array ``start``.

    The fold's state is the array of all contexts; a bin replaces the one it was coded in.
    """

    def moved(name: str, rate: str, digits: int) -> str:
        return f"c.{name} - (shiftright(c.{name}, c.{rate}) & {digits}) + if(v.bin = 1, shiftright(32767, c.{rate}) & {digits}, 0)"

    new = f"struct({moved('a', 'slow', KEPT[0])} AS a, {moved('b', 'fast', KEPT[1])} AS b, c.slow AS slow, c.fast AS fast)"
    step = f"struct(transform(s.at, (c, i) -> if(i = v.ctx, {new}, c)) AS at, concat(s.out, array(shiftright(s.at[v.ctx].a + s.at[v.ctx].b, 8))) AS out)"
    return F.expr(f"aggregate({bins}, struct({start} AS at, cast(array() AS array<int>) AS out), (s, v) -> {step}, s -> s.out)")


def less_likely(prob: Column, span: Column) -> Column:
    """The part of a coder's range that is left to the less likely bin."""
    folded = F.when(prob >= 128, 255 - prob).otherwise(prob)
    return F.shiftright(F.shiftright(folded, 2) * F.shiftright(span, 5), 1) + 4
