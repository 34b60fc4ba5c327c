"""Connected components of a links table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm._common import cut_lineage

#: A node of more links than this is a hub, unless there could be more than MOST_HUBS of them.
HUB_LINKS, MOST_HUBS = 1_000, 100_000


def _with_least(links: DataFrame, least: DataFrame, node: str, total: int) -> DataFrame:
    """Links with the least neighbour (low) of one of their nodes.

    Hubs' links meet a broadcast, so they stay where they are; only others are
    shuffled. Among so many links there are at most MOST_HUBS hubs, as every
    link has two ends.
    """
    many = max(HUB_LINKS, 2 * total // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") > many).select(node, F.col("low").alias("hub_low")))
    marked = links.join(hubs, node, "left")
    others = marked.where("hub_low is null").drop("hub_low").join(least.where(F.col("n") <= many).select(node, "low"), node)
    return marked.where("hub_low is not null").select("a", "b", F.col("hub_low").alias("low")).union(others.select("a", "b", "low"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("n"))
    return _with_least(both.where("b > a"), least, "a", total).select(F.col("low").alias("a"), "b").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of these. Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("n"))
    moved = _with_least(links, least, "b", total).where("a > low").select(F.col("low").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select(F.col("low").alias("x"), F.col("b").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """The least reachable node of every linked node.

    links has long columns a and b; links with a null or from a node to itself
    are left out, repeated and turned ones do no harm. The result has a row
    (node, component) for each node that is in a link and is not its own
    component's least. No node's neighbours are gathered in one place, and each
    round is materialised in the shared folder. Rounds grow with the logarithm
    of the longest path and go on until nothing changes.
    """
    now = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before, seen = None, _sum(now)
    while seen[0] and before != seen:
        # Both stars leave at most twice as many links as there are ends.
        wide = cut_lineage(_large_star(now, seen[0]))
        now = cut_lineage(_small_star(wide, 2 * seen[0]))
        before, seen = seen, _sum(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
