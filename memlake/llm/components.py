"""Connected components of a link table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Stash, join_skewed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """(node, component) of every node with a link; component: the smallest node reachable.

    ``links`` has columns a and b. Each round hangs every node's larger neighbours on its smallest
    neighbour, then every node's smaller neighbours, until nothing changes: O(log^2 n) rounds.
    Nodes with very many links join by broadcast, so that no node's links meet in one task."""
    edges = stash.put("links", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, k = _state(edges), 0
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash.put(f"large{k}", both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count_if(F.expr("v > u")).alias("size")))
        large = join_skewed(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash.put(f"large_links{k}", large.distinct())
        least2 = stash.put(f"small{k}", large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")))
        moved = join_skewed(large, least2, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        oriented = moved.unionByName(least2.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        old, edges = edges, stash.put(f"links{k}", oriented.distinct())
        now = _state(edges)
        stash.drop(f"large{k}", f"large_links{k}", f"small{k}", "links" if k == 0 else f"links{k - 1}")
        if now == before:
            break
        before, k = now, k + 1
    # Every edge now leads from a node to the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
