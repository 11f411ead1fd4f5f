"""Connected components of very many links by alternating stars.

Large star hangs every larger neighbour of a node on the least node it knows; small star does the same with the
smaller ones.  The links become stars around each component's least node in a number of rounds that grows with
the logarithm of the longest chain.  Minima are pre-aggregated and hubs' minima are broadcast to their links, so a
node with very many links is no hot key, and each round's links are cut into the shared checkpoint folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, join_skewed


def _least(pairs: DataFrame) -> DataFrame:
    """For each u of pairs (u, v) the least of u and its neighbours, and how many pairs it has."""
    return cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) between longs -> (node, root): every node that has a link to another, and the least node
    that it reaches.  Links to itself and nulls are no links.  No links give no rows."""
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u > v").distinct()
    )
    while True:
        # Large star: of each node's neighbours only the larger ones move, but all count for the minimum.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_skewed(both, _least(both), "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u > v").distinct())
        # Small star: the smaller neighbours, and the node itself, hang on the least.
        least = _least(large)
        hung = join_skewed(large, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(hung.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        # Done when each node hangs on one root, and no root hangs on another node.
        nodes, total = edges.agg(F.count_distinct("u"), F.count("*")).first()
        if nodes == total and edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").limit(1).count() == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def least_of_components(nodes: DataFrame, value: str) -> DataFrame:
    """nodes (root, value, ...) with component_id, the least value among the nodes of a root, in place of both.  A component of very many nodes is no hot key."""
    least = cut(nodes.groupBy("root").agg(F.min(value).alias("component_id"), F.count("*").alias("__n")))
    return join_skewed(nodes.drop(value), least, "root", "__n").drop("root")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, by rounds of joining components."""
    n = len(linked)
    label, out = np.arange(n), []
    active = np.flatnonzero(linked.any(1))
    while len(active):
        away = linked[active] & (label[active][:, None] != label[None, :])
        has = away.any(1)
        active, to = active[has], away[has].argmax(1)
        parent = {}

        def find(v):
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        for a, b in zip(active.tolist(), to.tolist()):
            x, y = find(int(label[a])), find(int(label[b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
        if parent:
            label = np.array([find(int(v)) for v in label])
    return out
