"""Connected components of an edge table, as joins over shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by doubling, and relabels the edges, until none is left. The ends
    are at most half of the nodes that had edges, so rounds and doublings both
    grow with a logarithm. Only whether rows are left reaches the driver. Null ends and self-loops are dropped; repeated edges count once.
    """
    cur = saved(_oriented(edges.select("a", "b")))
    trail: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
        hooks = _ends(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        cur = saved(_oriented(cur.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        trail.append(hooks)
    if not trail:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = trail[0]
    for hooks in trail[1:]:
        step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _ends(hooks: DataFrame) -> DataFrame:
    """Every node with the end of its chain of hooks."""
    while True:
        step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = saved(hooks.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        hooks = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return hooks
