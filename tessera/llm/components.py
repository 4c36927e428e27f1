"""Connected components of a link table, by contraction, without collecting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _parents(links: DataFrame, turn: int) -> DataFrame:
    """(node, parent): each node's first neighbour in the order of this turn, or itself if it comes before it."""

    def place(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))

    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    first = both.groupBy("node").agg(F.min(place("to")).alias("to"))
    return first.select("node", F.least(place("node"), F.col("to"))["v"].alias("parent"))


def hop(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node within two links, so that all of a star have one label.

    Two nodes with one label are surely connected; connected ones may still differ.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    near = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label"))
    beyond = both.join(near.select(F.col("node").alias("to"), F.col("label").alias("far")), "to").groupBy("node").agg(F.min("far").alias("far"))
    return near.join(beyond, "node").select("node", F.least("label", "far").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is one node of its component, the same for all of it.

    Each round points every node at the neighbour that comes first in a random order of that round, jumps to
    that one's own, and contracts the links to the nodes reached. No two neighbours can both stay, so a round
    leaves a fraction of the nodes, whatever the shape; long chains take rounds in the logarithm of their
    length. Each round is written to the shared folder. Links of a node with itself make no node.
    """
    labels, rest, turn = None, cut(links.where("a <> b").select("a", "b").distinct(), "rest"), 0
    while not rest.isEmpty():
        parents = _parents(rest, turn)
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        jumped = cut(parents.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("label")), "jumped")
        if labels is None:
            labels = jumped
        else:
            step = jumped.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        for x in ("a", "b"):
            rest = rest.join(jumped.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}")), x)
        rest = cut(rest.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "rest")
        turn += 1
    return labels if labels is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
