"""The walk down the coding tree: from units of 128 to leaves, each node split by what its place and samples allow.

The samples of a unit meet once, as sums over its 4 x 4 cells. A node carries the cells inside it and its state, and the
walk is a fold over an array of nodes that replaces each open one by its parts, level by level, so it needs no
further shuffle and its expressions stand in the plan once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import partition

CELL = 4
STATE = ("x", "y", "w", "h", "qt_depth", "mt_depth", "bt_depth", "implicit", "part")


def _cell() -> str:
    """Sums over cell (i, j) of ``rows``: values, squares, changes along and down inside it, and those to the next cells."""
    at = [[f"s[{j}][{i}]" for i in range(CELL + 1)] for j in range(CELL + 1)]
    inside = [at[j][i] for j in range(CELL) for i in range(CELL)]
    across = lambda columns: " + ".join(f"abs({at[j][i + 1]} - {at[j][i]})" for j in range(CELL) for i in columns)
    down = lambda lines: " + ".join(f"abs({at[j + 1][i]} - {at[j][i]})" for j in lines for i in range(CELL))
    inner, last = range(CELL - 1), [CELL - 1]
    fields = {
        "a": " + ".join(inside), "b": " + ".join(f"{v} * {v}" for v in inside), "gx": across(inner), "gy": down(inner),
        "ex": f"if(size(s[0]) > {CELL}, {across(last)}, 0L)", "ey": f"if(size(s) > {CELL}, {down(last)}, 0L)",
    }
    values = ", ".join(f"{e} AS {name}" for name, e in fields.items())
    part = f"transform(slice(rows, {CELL} * j + 1, {CELL + 1}), r -> slice(r, {CELL} * i + 1, {CELL + 1}))"
    return f"transform(array({part}), s -> struct(tcol * unit + {CELL} * i AS cx, trow * unit + {CELL} * j AS cy, {values}))[0]"


def cells(rows: DataFrame, width: int, unit: int) -> DataFrame:
    """(trow, tcol, cells) of each unit of (y, row); width and height are multiples of 4."""
    parts = rows.select("y", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // unit))).alias("tcol"), "row")
    parts = parts.select(F.expr(f"y div {unit}").alias("trow"), F.col("tcol").cast("bigint").alias("tcol"), F.struct("y", F.slice("row", F.col("tcol") * unit + 1, unit).alias("part")).alias("r"))
    units = parts.groupBy("trow", "tcol").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["part"]).alias("rows"))
    every = f"flatten(transform(sequence(0, size(rows) div {CELL} - 1), j -> transform(sequence(0, size(rows[0]) div {CELL} - 1), i -> {_cell()})))"
    return units.withColumn("unit", F.lit(unit)).select("trow", "tcol", F.expr(every).alias("cells"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def by_statistics(n: Column, may: dict[str, Column], sums: Column, qp: int, least: int) -> Column:
    """The split of a node: none if flat, else the first in an order of splits whose parts are at least ``least``, else the first allowed one.

    Long nodes are split across their length, others across the direction of more change, from a ratio of 5 to 4 on,
    and evenly changing ones into quarters first. Nodes over 64 are always split.
    """
    w, h = n["w"], n["h"]
    small = {"quad": F.least(w, h) < 2 * least, "bin_v": w < 2 * least, "bin_h": h < 2 * least, "tri_v": w < 4 * least, "tri_h": h < 4 * least}
    vertical, horizontal, even = ("bin_v", "tri_v", "quad", "bin_h", "tri_h"), ("bin_h", "tri_h", "quad", "bin_v", "tri_v"), ("quad", "bin_v", "bin_h", "tri_v", "tri_h")
    first = lambda order: F.coalesce(*[F.when(may[s] & ~small[s], s) for s in order])
    across = (w >= 2 * h) | ((h < 2 * w) & (sums["gx"] * 4 > sums["gy"] * 5))
    down = (h >= 2 * w) | (sums["gy"] * 4 > sums["gx"] * 5)
    usable = F.when(across, first(vertical)).when(down, first(horizontal)).otherwise(first(even))
    stay = may["none"] & (F.greatest(w, h) <= 64)
    mean = F.floor(sums["a"] / sums["n"]).cast("bigint")
    calm = F.floor(sums["b"] / sums["n"]).cast("bigint") - mean * mean < 64 + qp * qp
    return F.when(stay & calm, "none").otherwise(F.coalesce(usable, F.when(stay, "none"), *[F.when(may[s], s) for s in even], F.lit("none")))


def first_legal(may: dict[str, Column]) -> Column:
    """No split where that is allowed, else the first split that is."""
    return F.coalesce(*[F.when(may[s], s) for s in partition.SPLITS])


def sums_of(n: Column) -> Column:
    """Of the cells of a node: values, squares, changes inside the node, and the number of samples."""
    names = ("a", "b", "gx", "gy", "n")

    def step(s: Column, c: Column) -> Column:
        gx = s["gx"] + c["gx"] + F.when(c["cx"] + CELL < n["x"] + n["w"], c["ex"]).otherwise(0)
        gy = s["gy"] + c["gy"] + F.when(c["cy"] + CELL < n["y"] + n["h"], c["ey"]).otherwise(0)
        return F.struct(*[v.alias(k) for k, v in zip(names, (s["a"] + c["a"], s["b"] + c["b"], gx, gy, s["n"] + CELL * CELL), strict=True)])

    return F.aggregate(n["cells"], F.struct(*[F.lit(0).cast("bigint").alias(k) for k in names]), step)


def walked(found: DataFrame, width: int, height: DataFrame, qp: int, least: int = 8, unit: int = 128, limits: partition.Limits = partition.LUMA, statistics: bool = True, forced_to: int | None = None) -> DataFrame:
    """(trow, tcol, path, x, y, w, h, qt_depth, mt_depth): the leaves of every unit of ``cells``.

    ``path``: the numbers of the parts from the unit down, so its order within a unit is the coding order. ``height``
    has one row. ``forced_to``: nodes above this size go into quarters whatever they hold. Each split halves a
    node at least, so the levels are bounded by the unit's size.
    """

    def split_up(n: Column) -> Column:
        state = {c: n[c] for c in (*STATE, "last")}

        def with_facts(t: Column) -> Column:
            allowed = partition.allowed_splits(state, t["forced"], limits)

            def with_rights(m: Column) -> Column:
                may = {k: m[k] for k in partition.SPLITS}
                chosen = by_statistics(n, may, t["sums"], qp, least) if statistics else first_legal(may)
                if forced_to:
                    chosen = F.when(F.greatest(n["w"], n["h"]) > forced_to, "quad").otherwise(chosen)
                return let(chosen, with_split)

            def with_split(split: Column) -> Column:
                def child(c: Column) -> Column:
                    inside = F.filter(n["cells"], lambda d: (d["cx"] >= c["x"]) & (d["cx"] < c["x"] + c["w"]) & (d["cy"] >= c["y"]) & (d["cy"] < c["y"] + c["h"]))
                    path = F.concat(n["path"], F.when(split == "none", "").otherwise(c["part"].cast("string")))
                    return node({k: c[k] for k in (*STATE, "last")} | {"path": path, "done": split == "none", "cells": inside})

                parts = partition.children(state, split, t["forced"] != "none")
                return F.transform(F.filter(parts, lambda c: (c["x"] < width) & (c["y"] < F.col("pic_h"))), child)

            return let(F.struct(*[c.alias(k) for k, c in allowed.items()]), with_rights)

        facts = F.struct(partition.forced_split(state, width, F.col("pic_h"), limits).alias("forced"), (sums_of(n) if statistics else F.lit(0)).alias("sums"))
        return F.when(n["done"], F.array(n)).otherwise(let(facts, with_facts))

    node = lambda fields: F.struct(*[c.alias(k) for k, c in fields.items()])
    zero, side = F.lit(0).cast("bigint"), F.lit(unit).cast("bigint")
    root = {"x": F.col("tcol") * unit, "y": F.col("trow") * unit, "w": side, "h": side} | dict.fromkeys(STATE[4:], zero) | {"last": F.lit("none"), "path": F.lit(""), "done": F.lit(False), "cells": F.col("cells")}
    levels = 2 * (unit.bit_length() - 1 - 2)
    nodes = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(node(root)), lambda open_nodes, _: F.flatten(F.transform(open_nodes, split_up)))
    out = ("path", "x", "y", "w", "h", "qt_depth", "mt_depth")
    return found.join(F.broadcast(height.toDF("pic_h"))).select("trow", "tcol", F.inline(F.transform(nodes, lambda n: F.struct(*[n[c].alias(c) for c in out]))))


def in_order(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``seq``, the place of a leaf in the coding order of its unit; a unit's leaves already lie together."""
    return leaves.withColumn("seq", F.row_number().over(Window.partitionBy("trow", "tcol").orderBy("path")).cast("bigint") - 1)


def dual(found: DataFrame, width: int, height: DataFrame, qp: int, unit: int = 128) -> DataFrame:
    """(trow, tcol, tree, path, x, y, w, h, qt_depth, mt_depth, seq) of luma and chroma leaves: quarters down to 64, and of each such region its luma leaves, then its chroma leaves."""
    luma = walked(found, width, height, qp, 4, unit, forced_to=64).withColumn("tree", F.lit("luma"))
    chroma = walked(found, width, height, qp, 4, unit, partition.CHROMA, statistics=False, forced_to=64).withColumn("tree", F.lit("chroma"))
    regions = (unit // 64).bit_length() - 1
    order = Window.partitionBy("trow", "tcol").orderBy(F.substring("path", 1, regions), F.desc("tree"), "path")
    return luma.unionByName(chroma).withColumn("seq", F.row_number().over(order).cast("bigint") - 1)
