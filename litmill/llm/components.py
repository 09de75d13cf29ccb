"""Connected components of links, by alternating large and small stars.

Each round moves every node's links to the smallest neighbour it knows, first for larger neighbours, then for smaller
ones. The number of rounds grows with the logarithm of the longest path. Only sums and joins by node are used: no list
of a node's neighbours is ever gathered. A node with very many links, as the smallest one of a large group has, is summed
in each task first; its smallest neighbour is sent to the tasks that hold its links, which stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm._base import materialise

#: Links that make a node a hub, and hubs there can be: a node has that many links, or that part of all.
HUB_LINKS, HUBS = 1_000, 10_000


def _star(links: DataFrame, n: int, *, large: bool) -> DataFrame:
    """links: u > v, distinct, no more than ``n``. Result in the same form."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("links")), 2 * n)
    hub = F.col("links") >= max(HUB_LINKS, -(-2 * n // HUBS))  # so there are HUBS of them at most
    hubs, others = F.broadcast(least.where(hub).drop("links")), least.where(~hub).drop("links")
    if least.where(hub).isEmpty():
        joined = both.join(others, "u")
    else:
        joined = both.join(hubs, "u", "left_anti").join(others, "u").unionByName(both.join(hubs, "u"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b of written frames. Result: node, component (the smallest node reachable), for nodes with a link."""
    n = links.count()
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, n)
    while not _done(now):
        # Each star is written by itself, which keeps plans small. None has more links than twice those it is made of.
        for large in (True, False):
            n = now.count()
            now = materialise(_star(now, n, large=large), 2 * n)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _done(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none."""
    return links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and links.select("v").distinct().join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
