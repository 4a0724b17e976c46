"""Connected components of an edge table, without gathering them anywhere.

Each round lets every node point to the neighbour (or itself) of lowest random
rank, replaces the ends of every edge by what they point to and keeps the
distinct edges left; random ranks make the graph shrink by a constant factor a
round whatever its shape, a star in one. Labels are then carried back down the
rounds. Every round is written, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.llm.common import staged


def _ranked(node: str | Column, salt: int) -> Column:
    c = F.col(node) if isinstance(node, str) else node
    return F.struct(F.xxhash64(c, F.lit(salt)).alias("rank"), c.alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``; one root per component.

    Both edge tables of a join are plain written tables, so a node with a large
    share of the edges is split by the engine's skew rule. Self-loops name
    isolated nodes; null ends are ignored; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    edges = staged(edges, "cc-edges")
    levels, salt = [], 0
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = F.least(F.min(_ranked("b", salt)), F.min(_ranked("a", salt)))
        points = staged(both.groupBy(F.col("a").alias("node")).agg(lowest["node"].alias("to")), f"cc-points-{salt}")
        levels.append(points)
        left = points.select(F.col("node").alias("a"), F.col("to").alias("na"))
        right = points.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        moved = edges.join(left, "a").join(right, "b").where("na != nb").select(
            F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")
        )
        edges = staged(moved.distinct(), f"cc-edges-{salt}")
        if edges.isEmpty():
            break
        salt += 1
    roots = levels.pop()
    roots = roots.select("node", F.col("to").alias("root"))
    while levels:
        below = levels.pop()
        above = roots.select(F.col("node").alias("to"), "root")
        # A node that no edge of the next round names is the root of its component.
        roots = below.join(above, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        roots = staged(roots, f"cc-roots-{len(levels)}")
    return roots
