"""Connected components of a table of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """The least node reachable from each node that has a link.

    ``links`` has columns ``a`` and ``b``, one for each end. Returns ``node,
    root``; nodes without links (or linked with themselves alone) are missing,
    and so are links with a null end.

    Each round hangs every node under its least neighbour, follows that three
    times, and goes on with the links between different roots only. The least
    neighbour is found before the shuffle as far as it can be, and links are
    joined by node, where adaptive execution splits a hub: nothing is gathered
    in one task. Every round's tables go to the shared folder, which cuts the
    lineage.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    forest: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "near")
        half = _follow(near)
        jumped = _follow(half)
        if forest is None:
            grown = jumped
        else:
            higher = jumped.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            grown = stored(forest.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "forest")
        root_a = jumped.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        root_b = jumped.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        moved = edges.join(root_a, "a").join(root_b, "b").filter("root_a <> root_b")
        left = stored(moved.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
        discard(edges, near, half, *([] if forest is None else [forest, jumped]))
        edges, forest = left, grown
    if forest is None:
        forest = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "forest")
    discard(edges)
    return forest


def _follow(tree: DataFrame) -> DataFrame:
    """Every node's root's root."""
    up = tree.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return stored(tree.join(up, "root").select("node", F.col("higher").alias("root")), "roots")
