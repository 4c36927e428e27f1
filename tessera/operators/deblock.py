"""Deblocking of luma: samples on both sides of the edges between leaves are smoothed, all upright edges first.

A line across an edge is an array of sixteen samples, eight of each side; p0 and q0 meet at the edge. A segment is
four lines side by side, and its first and last line decide for all. Leaves are at least eight samples wide and
high, so that edges lie eight apart and what one changes no other edge of the same direction reads. Expressions are SQL text, as Spark parses one of this size far sooner than it is built call by call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strength by quantizer plus 2, for 10-bit samples.
STRENGTH = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3, 4, 4, 4, 4, 5, 5, 5, 5, 7, 7, 8, 9, 10, 10, 11, 13, 14, 15, 17, 19, 21, 24, 25, 29, 33, 36, 41, 45, 51, 57, 64, 71, 80, 89, 100, 112, 125,
    141, 157, 177, 198, 222, 250, 280, 314, 352, 395,
)
# Weights and reaches of the long filter, by the number of samples it changes.
WEIGHTS = {3: (53, 32, 11), 7: (59, 50, 41, 32, 23, 14, 5)}
REACHES = {3: (6, 4, 2), 7: (6, 5, 4, 3, 2, 1, 1)}


def threshold(qp: int) -> int:
    """The activity up to which an edge is smoothed: none, then one a step, then two."""
    return 0 if qp < 16 else qp - 10 if qp <= 28 else 2 * qp - 38


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def p(line: str, k: int) -> str:
    return f"{line}[{7 - k}]"


def q(line: str, k: int) -> str:
    return f"{line}[{8 + k}]"


def half(v: str, by: int = 1) -> str:
    return f"shiftright({v}, {by})"


def clip(v: str, low: str | int, high: str | int) -> str:
    return f"least({high}, greatest({low}, {v}))"


def bend(side, line: str, k: int = 0) -> str:
    return f"abs({side(line, k + 2)} - 2 * {side(line, k + 1)} + {side(line, k)})"


def strong(line: str, d: str, long_p: str, long_q: str) -> str:
    """Whether a line is flat enough on both sides for the strong filter, or the long one if a side is long."""

    def flat(side, is_long: str) -> str:
        near = f"abs({side(line, 3)} - {side(line, 0)})"
        far = f"abs({side(line, 4)} - {side(line, 5)} - {side(line, 6)} + {side(line, 7)})"
        return near if is_long == "false" else f"if({is_long}, {half(f'{near} + {far} + abs({side(line, 3)} - {side(line, 7)}) + 1')}, {near})"

    some = f"{long_p} OR {long_q}"
    within = f"{flat(p, long_p)} + {flat(q, long_q)} < if({some}, {half('3 * t.beta', 5)}, {half('t.beta', 3)})"
    return f"({within} AND {d} < if({some}, {half('t.beta', 4)}, {half('t.beta', 2)}) AND abs({p(line, 0)} - {q(line, 0)}) < {half('5 * t.tc + 1')})"


def decided(first: str, last: str, size_p: str, size_q: str, qp: str, top: str) -> tuple[str, str]:
    """The facts ``t`` of a segment, and from them (mode, tc, long_p, long_q, more_p, more_q); mode 0: as it is, 1: weak, 2: strong, 3: long.

    ``top``: the edge is the upper one of a coding tree unit, above which no more than three samples change.
    """
    strengths, thresholds = ", ".join(map(str, STRENGTH)), ", ".join(str(threshold(k)) for k in range(64))
    wide = f"({size_p} > 4 AND {size_q} > 4)"
    bends = "".join(f", struct({bend(side, first, k)} AS a, {bend(side, last, k)} AS b) AS {name}" for name, side, k in (("p", p, 0), ("q", q, 0), ("pp", p, 3), ("qq", q, 3)))
    facts = f"""struct({half(f"array({strengths})[cast({clip(f'{qp} + 2', 0, len(STRENGTH) - 1)} AS int)] + 2", 2)} AS tc, array({thresholds})[cast({clip(qp, 0, 63)} AS int)] AS beta, {wide} AS wide,
        {wide} AND {size_p} >= 32 AND NOT {top} AS long_p, {wide} AND {size_q} >= 32 AS long_q{bends})"""
    longer = lambda s, n: f"if(t.long_{s}, {half(f't.{s}.{n} + t.{s}{s}.{n} + 1')}, t.{s}.{n})"
    d_long, d = {n: f"({longer('p', n)} + {longer('q', n)})" for n in "ab"}, {n: f"(t.p.{n} + t.q.{n})" for n in "ab"}
    lines = {"a": first, "b": last}
    use_long = f"(t.long_p OR t.long_q) AND {d_long['a']} + {d_long['b']} < t.beta AND {' AND '.join(strong(lines[n], f'2 * {d_long[n]}', 't.long_p', 't.long_q') for n in 'ab')}"
    use_strong = f"t.wide AND {' AND '.join(strong(lines[n], f'2 * {d[n]}', 'false', 'false') for n in 'ab')}"
    more = lambda s: f"t.wide AND t.{s}.a + t.{s}.b < {half('t.beta + ' + half('t.beta'), 3)}"
    mode = f"CASE WHEN {use_long} THEN 3 WHEN {d['a']} + {d['b']} >= t.beta THEN 0 WHEN {use_strong} THEN 2 ELSE 1 END"
    return facts, f"struct({mode} AS mode, cast(t.tc AS bigint) AS tc, t.long_p AS long_p, t.long_q AS long_q, {more('p')} AS more_p, {more('q')} AS more_q)"


def near(v: str, new: str, reach: str) -> str:
    return f"least(greatest({new}, {v} - {reach}), {v} + {reach})"


def weak_line(a: str) -> str:
    p0, p1, p2, q0, q1, q2 = (side(a, k) for side in (p, q) for k in range(3))
    step = clip("e", "-d.tc", "d.tc")
    second = lambda on, x, y, z, sign: f"if({on}, {clip(f'{y} + ' + clip(half(f'{half(f"{x} + {z} + 1")} - {y} {sign} {step}'), '-' + half('d.tc'), half('d.tc')), 0, 255)}, {y})"
    new = f"concat(slice({a}, 1, 6), array({second('d.more_p', p2, p1, p0, '+')}, {clip(f'{p0} + {step}', 0, 255)}, {clip(f'{q0} - {step}', 0, 255)}, {second('d.more_q', q2, q1, q0, '-')}), slice({a}, 11, 6))"
    return let("e", half(f"9 * ({q0} - {p0}) - 3 * ({q1} - {p1}) + 8", 4), f"if(abs(e) < 10 * d.tc, {new}, {a})")


def strong_line(a: str) -> str:
    p0, p1, p2, p3, q0, q1, q2, q3 = (side(a, k) for side in (p, q) for k in range(4))
    mid = [
        near(p2, half(f"2 * {p3} + 3 * {p2} + {p1} + {p0} + {q0} + 4", 3), "d.tc"), near(p1, half(f"{p2} + {p1} + {p0} + {q0} + 2", 2), "2 * d.tc"), near(p0, half(f"{p2} + 2 * {p1} + 2 * {p0} + 2 * {q0} + {q1} + 4", 3), "3 * d.tc"),
        near(q0, half(f"{p1} + 2 * {p0} + 2 * {q0} + 2 * {q1} + {q2} + 4", 3), "3 * d.tc"), near(q1, half(f"{p0} + {q0} + {q1} + {q2} + 2", 2), "2 * d.tc"), near(q2, half(f"{p0} + {q0} + {q1} + 3 * {q2} + 2 * {q3} + 4", 3), "d.tc"),
    ]
    return f"concat(slice({a}, 1, 5), array({', '.join(mid)}), slice({a}, 12, 5))"


def long_line(a: str, n_p: int, n_q: int) -> str:
    """The long filter that changes ``n_p`` and ``n_q`` samples: towards a middle value, by distance.

    The samples of side p are counted from q0 on, so q0 is moved for both sides, first for p, and the outermost p stays.
    """
    if n_p == n_q:
        middle = f"2 * ({p(a, 0)} + {q(a, 0)}) + " + " + ".join(side(a, k) for k in range(1, 7) for side in (p, q))
    else:
        longer, shorter = (p, q) if n_p > n_q else (q, p)
        middle = f"2 * {longer(a, 0)} + 3 * {shorter(a, 0)} + 3 * {shorter(a, 1)} + 2 * {shorter(a, 2)} + " + " + ".join(longer(a, k) for k in range(1, 7))
    refs = f"struct({half(f'{middle} + 8', 4)} AS mid, {half(f'{p(a, n_p - 2)} + {p(a, n_p - 1)} + 1')} AS p, {half(f'{q(a, n_q - 1)} + {q(a, n_q)} + 1')} AS q)"
    drawn = lambda v, side, n, k: near(v, half(f"r.mid * {WEIGHTS[n][k]} + r.{side} * {64 - WEIGHTS[n][k]} + 32", 6), half(f"d.tc * {REACHES[n][k]}"))
    before = [drawn(p(a, k - 1), "p", n_p, k) for k in range(n_p - 1, 0, -1)]
    after = [drawn(drawn(q(a, 0), "p", n_p, 0), "q", n_q, 0), *(drawn(q(a, k), "q", n_q, k) for k in range(1, n_q))]
    return let("r", refs, f"concat(slice({a}, 1, {9 - n_p}), array({', '.join(before + after)}), slice({a}, {9 + n_q}, {8 - n_q}))")


def smoothed(lines: str, size_p: str, size_q: str, qp: str, top: str) -> str:
    """The four lines of a segment after smoothing, as an expression."""
    facts, choice = decided("z[0]", "z[3]", size_p, size_q, qp, top)
    line = f"CASE d.mode WHEN 0 THEN a WHEN 1 THEN {weak_line('a')} WHEN 2 THEN {strong_line('a')} ELSE CASE WHEN d.long_p AND d.long_q THEN {long_line('a', 7, 7)} WHEN d.long_p THEN {long_line('a', 7, 3)} ELSE {long_line('a', 3, 7)} END END"
    return let("z", lines, let("t", facts, let("d", choice, f"transform(z, a -> {line})")))


def covers(leaves: DataFrame) -> DataFrame:
    """(b, cover): of each eight rows the leaves (x, size, y, qp) across them, from left to right."""
    spread = leaves.withColumn("b", F.explode(F.sequence(F.expr("y div 8"), F.expr("(y + size) div 8 - 1"))))
    return spread.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("x", "size", "y", "qp"))).alias("cover"))


def upright() -> str:
    """Eight ``rows`` after the edges between the leaves of ``cover``.

    Each edge gives its eight lines of sixteen; a leaf's samples come from the edge at its left, from the row, and from the edge at its right.
    """
    mean = half("cover[i - 1].qp + cover[i].qp + 1")
    lines = "transform(slice(rows, 4 * g + 1, 4), w -> slice(w, cast(cover[i].x AS int) - 7, 16))"
    edges = f"if(size(cover) > 1, transform(sequence(1, size(cover) - 1), i -> flatten(transform(array(0, 1), g -> {smoothed(lines, 'cover[i - 1].size', 'cover[i].size', mean, 'false')}))), array())"
    x, size, n = "cast(c.x AS int)", "cast(c.size AS int)", "cast(least(8, c.size div 2) AS int)"
    left, right = f"if(i > 0, slice(edges[i - 1][k], 9, {n}), slice(r, {x} + 1, {n}))", f"if(i < size(cover) - 1, slice(edges[i][k], 9 - {n}, {n}), slice(r, {x} + {size} - {n} + 1, {n}))"
    rebuilt = f"transform(rows, (r, k) -> flatten(transform(cover, (c, i) -> concat({left}, slice(r, {x} + {n} + 1, {size} - 2 * {n}), {right}))))"
    return let("edges", edges, rebuilt)


def level(ctu: int, width: int) -> str:
    """Eight rows of ``own`` after the edges at their top and bottom; ``above`` and ``below`` are null beyond the picture."""
    at = lambda part: f"filter({part}.cover, c -> c.x <= x AND x < c.x + c.size)[0]"
    # The edges as an array of two, so that their filter is written once: its parts, and the number of the block below it.
    pairs = "array(struct(above AS upper, own AS lower, b AS number), struct(own AS upper, below AS lower, b + 1 AS number))"
    lines = "transform(sequence(x, x + 3), c -> concat(transform(v.upper.rows, w -> w[c]), transform(v.lower.rows, w -> w[c])))"
    edge = let("o", f"struct({at('v.upper')} AS upper, {at('v.lower')} AS lower)", f"if(o.lower.y = v.number * 8, {smoothed(lines, 'o.upper.size', 'o.lower.size', half('o.upper.qp + o.lower.qp + 1'), f'(v.number * 8 % {ctu} = 0)')}, NULL)")
    both = f"transform({pairs}, v -> if(v.upper IS NULL OR v.lower IS NULL, NULL, {edge}))"
    upper, lower = "transform(e[0], w -> slice(w, 9, 8))", "transform(e[1], w -> slice(w, 1, 8))"
    plain = "transform(sequence(x, x + 3), c -> transform(own.rows, w -> w[c]))"
    joined = f"CASE WHEN e[0] IS NOT NULL AND e[1] IS NOT NULL THEN zip_with({upper}, {lower}, (m, n) -> concat(slice(m, 1, 4), slice(n, 5, 4))) WHEN e[0] IS NOT NULL THEN {upper} WHEN e[1] IS NOT NULL THEN {lower} ELSE {plain} END"
    columns = f"flatten(transform(sequence(0, {width - 4}, 4), x -> {let('e', both, joined)}))"
    return let("every", columns, "transform(sequence(0, 7), k -> transform(every, w -> w[k]))")


def deblocked(rows: DataFrame, leaves: DataFrame, width: int, ctu: int = 128) -> DataFrame:
    """(y, row) of 8-bit rows after both passes; ``leaves``: (x, y, size, qp), which cover the picture, rows padded to a multiple of eight.

    Rows are shuffled twice: into blocks of eight, and for the second pass to the blocks above and below.
    """
    blocks = rows.groupBy(F.expr("y div 8").alias("b")).agg(F.sort_array(F.collect_list(F.struct("y", "row"))).alias("rows"))
    one = blocks.join(covers(leaves), "b").select("b", F.transform("rows", lambda r: r["row"]).alias("rows"), "cover")
    one = one.select("b", F.struct(F.expr(upright()).alias("rows"), "cover").alias("part"))
    sent = one.select("b", "part", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("to"))
    place = lambda to: F.first(F.when(F.col("to") == to, F.col("part")), ignorenulls=True)
    near = sent.groupBy((F.col("b") + F.col("to")).alias("b")).agg(place(0).alias("own"), place(1).alias("above"), place(-1).alias("below")).where("own IS NOT NULL")
    done = near.select("b", F.posexplode(F.expr(level(ctu, width))).alias("k", "row"))
    return done.select((F.col("b") * 8 + F.col("k")).alias("y"), "row")


def chroma_run(lines: str, size_p: str, size_q: str, qp: str, ctb: str) -> str:
    """Two lines of eight chroma samples across an edge, after smoothing, as an expression; sizes and edges are those of luma.

    ``ctb``: the edge is the upper one of a coding tree unit, above which one sample changes and two are read.
    """
    p, q = (lambda k, a="a": f"{a}[{3 - k}]"), (lambda k, a="a": f"{a}[{4 + k}]")
    strengths, thresholds = ", ".join(map(str, STRENGTH)), ", ".join(str(threshold(k)) for k in range(64))
    tc, beta = half(f"array({strengths})[cast({clip(f'{qp} + 2', 0, len(STRENGTH) - 1)} AS int)] + 2", 2), f"array({thresholds})[cast({clip(qp, 0, 63)} AS int)]"
    bend_p = lambda a: f"if(t.ctb, abs({p(0, a)} - {p(1, a)}), abs({p(2, a)} - 2 * {p(1, a)} + {p(0, a)}))"
    d = lambda a: f"({bend_p(a)} + abs({q(2, a)} - 2 * {q(1, a)} + {q(0, a)}))"
    flat = lambda a: f"(if(t.ctb, abs({p(1, a)} - {p(0, a)}), abs({p(3, a)} - {p(0, a)})) + abs({q(3, a)} - {q(0, a)}) < {half('t.beta', 3)} AND 2 * {d(a)} < {half('t.beta', 2)} AND abs({p(0, a)} - {q(0, a)}) < {half('5 * t.tc + 1')})"
    full = f"t.large AND {d('z[0]')} + {d('z[1]')} < t.beta AND {flat('z[0]')} AND {flat('z[1]')}"
    step = clip(half(f"4 * ({q(0)} - {p(0)}) + {p(1)} - {q(1)} + 4", 3), "-t.tc", "t.tc")
    weak = f"transform(array({step}), e -> array({p(3)}, {p(2)}, {p(1)}, {clip(f'{p(0)} + e', 0, 255)}, {clip(f'{q(0)} - e', 0, 255)}, {q(1)}, {q(2)}, {q(3)}))[0]"
    mean = lambda old, *weights: near(old, half(" + ".join(f"{n} * {v}" for v, n in weights) + " + 4", 3), "t.tc")
    q1 = mean(q(1), (p(1), 1), (p(0), 1), (q(0), 1), (q(1), 2), (q(2), 1), (q(3), 2))
    q2 = mean(q(2), (p(0), 1), (q(0), 1), (q(1), 1), (q(2), 2), (q(3), 3))
    both = [
        p(3), mean(p(2), (p(3), 3), (p(2), 2), (p(1), 1), (p(0), 1), (q(0), 1)), mean(p(1), (p(3), 2), (p(2), 1), (p(1), 2), (p(0), 1), (q(0), 1), (q(1), 1)),
        mean(p(0), (p(3), 1), (p(2), 1), (p(1), 1), (p(0), 2), (q(0), 1), (q(1), 1), (q(2), 1)), mean(q(0), (p(2), 1), (p(1), 1), (p(0), 1), (q(0), 2), (q(1), 1), (q(2), 1), (q(3), 1)), q1, q2, q(3),
    ]
    low = [p(3), p(2), p(1), mean(p(0), (p(1), 3), (p(0), 2), (q(0), 1), (q(1), 1), (q(2), 1)), mean(q(0), (p(1), 2), (p(0), 1), (q(0), 2), (q(1), 1), (q(2), 1), (q(3), 1)), q1, q2, q(3)]
    facts = f"struct({tc} AS tc, {beta} AS beta, {ctb} AS ctb, {size_p} >= 16 AND {size_q} >= 16 AS large)"
    line = f"if(NOT full, {weak}, if(t.ctb, array({', '.join(low)}), array({', '.join(both)})))"
    return let("z", lines, let("t", facts, let("full", full, f"transform(z, a -> {line})")))


def chroma_upright(width: int) -> str:
    """Four chroma ``rows`` after the edges of ``cover`` that lie on the grid of eight samples."""
    run = lambda k: chroma_run(f"transform(slice(acc, {k}, 2), r -> slice(r, x - 3, 8))", "cover[i - 1].size", "cover[i].size", half("cover[i - 1].qp + cover[i].qp + 1"), "false")
    changed = f"zip_with(acc, concat({run(1)}, {run(3)}), (r, n) -> concat(slice(r, 1, x - 4), n, slice(r, x + 5, {width})))"
    step = let("x", "cast(cover[i].x div 2 AS int)", changed)
    edges = "filter(if(size(cover) > 1, sequence(1, size(cover) - 1), cast(array() AS array<int>)), i -> cover[i].x % 16 = 0)"
    return f"aggregate({edges}, rows, (acc, i) -> {step})"


def chroma_level(ctu: int, width: int) -> str:
    """The rows of ``above`` and ``below`` (null beyond the picture), four each, after the edge between them, that is 8 * e in chroma."""
    at = lambda part: f"filter({part}.cover, c -> c.x <= 2 * x AND 2 * x < c.x + c.size)[0]"
    lines = "transform(sequence(x, x + 1), c -> concat(transform(above.rows, r -> r[c]), transform(below.rows, r -> r[c])))"
    run = chroma_run(lines, "o.upper.size", "o.lower.size", half("o.upper.qp + o.lower.qp + 1"), f"(e * 8 % {ctu // 2} = 0)")
    column = let("o", f"struct({at('above')} AS upper, {at('below')} AS lower)", f"if(o.lower.y = e * 16, {run}, {lines})")
    columns = f"flatten(transform(sequence(0, {width - 2}, 2), x -> {column}))"
    turned = let("every", columns, "transform(sequence(0, 7), k -> transform(every, w -> w[k]))")
    return f"CASE WHEN above IS NULL THEN below.rows WHEN below IS NULL THEN above.rows ELSE {turned} END"


def chroma_deblocked(rows: DataFrame, leaves: DataFrame, width: int, ctu: int = 128) -> DataFrame:
    """(y, row) of a chroma plane of half the width and height, its rows padded to a multiple of four; ``leaves`` are those of luma.

    Rows are shuffled twice: into blocks of four, and then each block to the one across its only edge on the grid.
    """
    blocks = rows.groupBy(F.expr("y div 4").alias("b")).agg(F.sort_array(F.collect_list(F.struct("y", "row"))).alias("rows"))
    one = blocks.join(covers(leaves), "b").select("b", F.transform("rows", lambda r: r["row"]).alias("rows"), "cover")
    one = one.select(F.expr("(b + 1) div 2").alias("e"), "b", F.struct(F.expr(chroma_upright(width)).alias("rows"), "cover").alias("part"))
    place = lambda odd: F.first(F.when(F.col("b") % 2 == odd, F.col("part")), ignorenulls=True)
    pairs = one.groupBy("e").agg(place(1).alias("above"), place(0).alias("below"))
    done = pairs.select("e", F.col("above").isNull().alias("first"), F.posexplode(F.expr(chroma_level(ctu, width))).alias("k", "row"))
    return done.select((F.col("e") * 8 + F.col("k") - F.when(F.col("first"), 0).otherwise(4)).alias("y"), "row")
