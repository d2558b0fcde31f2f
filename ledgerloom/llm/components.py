"""Connected components by alternating star contractions.

Each round is four plain joins and aggregates: first every node hands its larger neighbours to
its smallest one, then every node and its smaller neighbours are tied to the smallest of them.
Both keep the components and shrink paths, so that the edges end as stars around the smallest
node after a number of rounds that grows with the logarithm of the longest path. No node's
neighbours are gathered: minima are partial aggregates, and the joins on a hub are plain
equi-joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage


def _tie(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(neighbour, smallest) for pairs (hub, neighbour)."""
    return pairs.join(least, "hub").select(F.col("node"), F.col("root"))


def components(edges: DataFrame, left: str, right: str, *, max_rounds: int = 100) -> DataFrame:
    """Undirected edges to (node, root): each node of an edge with its component's smallest node.

    Edges with a null end and loops are ignored; repeated edges count once. An empty table of
    edges gives an empty result. Roots are listed too, with themselves.
    """
    node = edges.schema[left].dataType
    current = stage(
        edges.select(
            F.greatest(left, right).cast(node).alias("node"), F.least(left, right).cast(node).alias("root")
        )
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct(),
        "edges",
    )
    seen = _mark(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = current.select(F.col("root").alias("hub"), "node").unionByName(
            current.select(F.col("node").alias("hub"), F.col("root").alias("node"))
        )
        least = both.groupBy("hub").agg(F.min("node").alias("low"))
        least = least.select("hub", F.least("low", "hub").alias("root"))
        large = _tie(both.where(F.col("node") > F.col("hub")), least).where("node != root").distinct()
        down = large.select(F.col("node").alias("hub"), F.col("root").alias("node"))
        lowest = down.groupBy("hub").agg(F.min("node").alias("root"))
        small = (
            _tie(down, lowest)
            .where("node != root")
            .unionByName(lowest.select(F.col("hub").alias("node"), "root"))
            .distinct()
        )
        following = stage(small, "edges")
        unstage(current)
        current, before, seen = following, seen, _mark(following)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.unionByName(current.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges: equal before and after a round that changed nothing."""
    digest = F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())
