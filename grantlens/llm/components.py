"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


class Forest:
    """Union-find inside one task; ``links`` holds those that joined two trees, at most one a node."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up.setdefault(up[x], up[x])
            x = up[x]
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> one row ``(node, component)`` for each node, component = smallest node reachable.

    Each round maps every node to the smallest among itself and its
    neighbours, and on to where that one maps (pointer jumping), then contracts
    the links: ends become what they map to, loops and repeats go.  So a round
    leaves at most half the nodes, and links inside a group vanish at once.
    The smallest node of a group maps to itself in every round and gives the
    component.  Each round's tables are written to the shared folder, so
    lineage stays short and joins read stored tables, whose skewed keys AQE
    can split; minima are combined before the shuffle.
    """
    def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
        df = df.where(F.col(a) != F.col(b))
        return stored(df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")

    edges, total = ordered(links, "a", "b"), None
    while total is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = both.groupBy("node").agg(F.least("node", F.min("other")).alias("up"))
        above = up.select(F.col("node").alias("up"), F.col("up").alias("jump"))
        up = stored(up.join(above, "up").select("node", "jump"), "labels")
        if total is None:
            total = up.select("node", F.col("jump").alias("component"))
        else:
            later = up.select(F.col("node").alias("component"), "jump")
            total = stored(total.join(later, "component", "left").select("node", F.coalesce("jump", "component").alias("component")), "labels")
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("jump").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("jump").alias("y")), "b")
        edges = ordered(ends, "x", "y")
    return total
