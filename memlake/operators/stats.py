"""Statistics of stores and of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.schema import TIERS


def session_stats(memories: DataFrame) -> DataFrame:
    """Per owner: rows that aren't archived, their oldest and newest time and vectors, and rows by tier (all rows)."""
    live = F.col("tier") != "archived"
    by_tier = [F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in TIERS]
    return memories.groupBy("owner_id").agg(F.count_if(live).alias("total"), F.min(F.when(live, F.col("ts_ms"))).alias("oldest"), F.max(F.when(live, F.col("ts_ms"))).alias("newest"), F.count_if(live & F.col("embedding").isNotNull()).alias("with_embeddings"), *by_tier)


def by_role(memories: DataFrame) -> DataFrame:
    return memories.where("tier <> 'archived'").groupBy("owner_id", "role").agg(F.count("*").alias("n"))


def by_tier(memories: DataFrame) -> DataFrame:
    return memories.groupBy("owner_id", "tier").agg(F.count("*").alias("n"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy("session_id").agg(F.count("*").alias("graph_nodes"))
    b = edges.groupBy("session_id").agg(F.count("*").alias("graph_edges"))
    return a.join(b, "session_id", "full").na.fill(0)


def percentiles(samples: DataFrame, value: str, *by: str, at: tuple[float, ...] = (0.5, 0.95, 0.99), cells: int = 64) -> DataFrame:
    """Nearest rank: the sample at place floor(n q) of the sorted samples, from 0; and the least and largest.

    Distinct values with their counts, after partial counting, are dealt to ``cells`` ranges a group (bounds from a
    sketch, so about even). Ranges are sorted apart and start at the exact number of samples below them, so that no
    task sorts a whole group and the picked samples are exact."""
    rows = samples.where(F.col(value).isNotNull()).select(F.struct(*by, F.lit(0).alias("_")).alias("g"), F.col(value).alias("v"))
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    bounds = counts.groupBy("g").agg(F.percentile_approx("v", [k / cells for k in range(1, cells)], 1000).alias("bounds"))
    dealt = counts.join(bounds, "g").select("g", "v", "c", F.size(F.filter("bounds", lambda b: b <= F.col("v"))).alias("cell"))
    group = Window.partitionBy("g")
    below = F.sum("inside").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("g", "cell").agg(F.sum("c").alias("inside")).select("g", "cell", F.coalesce(below, F.lit(0)).alias("below"), F.sum("inside").over(group).alias("n"))
    order = Window.partitionBy("g", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("own", F.sum("c").over(order)).join(starts, ["g", "cell"]).withColumn("upto", F.col("below") + F.col("own"))
    pick = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("v")))
    found = placed.groupBy("g").agg(F.max("n").alias("n"), *[pick(q).alias(f"p{round(q * 100)}") for q in at], F.min("v").alias("least"), F.max("v").alias("largest"))
    return found.select("g.*", *[c for c in found.columns if c != "g"]).drop("_")


def accuracy(results: DataFrame, correct: str, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col(correct)).alias("correct"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def throughput(runs: DataFrame, count: str, seconds: str) -> DataFrame:
    return runs.withColumn("per_second", F.floor(F.col(count) / F.col(seconds) + 0.5).cast("long"))
