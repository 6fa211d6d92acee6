"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Join each edge (a, b) to its node's row of ``least`` (a, m, n).

    Nodes of more than ``hub`` edges, of which there are few, are broadcast, so
    their edges stay where they are; edges of the others meet by node.
    """
    hubs = checkpointed(least.filter(F.col("n") > hub))
    if hubs.isEmpty():
        return edges.join(least, "a")
    marked = edges.join(F.broadcast(hubs.select("a", "m")), "a", "left")
    rest = marked.filter("m is null").drop("m").join(least.filter(F.col("n") <= hub).select("a", "m"), "a")
    return marked.filter("m is not null").unionByName(rest)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Link each node's larger neighbours to the least node among the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, least, hub).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return _with_least(down, least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, least_hub: int = 1_000) -> DataFrame:
    """(node, component) for all ends of ``edges`` (a, b); a component is named by its least node.

    Each round is two joins on node numbers and is checkpointed; rounds end
    when nothing changes, and their number grows with the logarithm of the
    longest path. A node of more than a ten-thousandth of all edges, and of
    more than ``least_hub``, is a hub, of which there are less than 20,000 at
    any size. Null ends and loops are ignored.
    """
    edges = checkpointed(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while mark[0]:
        large = checkpointed(_large_star(edges, max(least_hub, mark[0] // 10_000)))
        edges = checkpointed(_small_star(large, max(least_hub, mark[0] // 10_000)))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
