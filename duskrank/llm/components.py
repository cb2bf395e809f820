"""Connected components of a table of links, by contraction.

In every round a node hops to the neighbour with the least hash (or stays, if its own is the least), and
the links are renamed by the hops; links that became loops vanish. A star is gone after two rounds, and
any other graph loses a constant share of its nodes per round, in whatever order its nodes are numbered.
The hops of all rounds are composed at the end, the small ones first. Every round is written to the
scratch folder, so lost executors cost a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.session import cut


def _links(a: str, b: str, edges: DataFrame) -> DataFrame:
    named = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    return cut(named, "links")


def _hops(edges: DataFrame) -> DataFrame:
    """(node, goal) for every node with a link."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    best = both.groupBy(F.col("u").alias("node")).agg(F.min_by("v", F.xxhash64("v")).alias("_best"))
    lower = F.xxhash64("_best") < F.xxhash64("node")
    return cut(best.select("node", F.when(lower, F.col("_best")).otherwise(F.col("node")).alias("goal")), "hops")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (two long columns u, v); a component's name is one of its nodes."""
    edges, rounds = _links("u", "v", links), []
    while edges.limit(1).count():
        hops = _hops(edges)
        rounds.append(hops)
        met = edges.join(hops.select(F.col("node").alias("u"), F.col("goal").alias("a")), "u")
        met = met.join(hops.select(F.col("node").alias("v"), F.col("goal").alias("b")), "v")
        edges = _links("a", "b", met)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    named = rounds[-1].select("node", F.col("goal").alias("component"))
    for hops in reversed(rounds[:-1]):
        later = named.select(F.col("node").alias("goal"), F.col("component").alias("_later"))
        named = hops.join(later, "goal", "left").select("node", F.coalesce("_later", "goal").alias("component"))
    return named
