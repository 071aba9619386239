"""Consolidation, briefings and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.providers import Embedder, Generator, Summariser, parsed_strings
from memlake.schema import MAX_CONTENT, short_hash, with_defaults


def consolidation_candidates(memories: DataFrame, batch: int = 50, keep: int = 20, threshold: float = 0.8) -> DataFrame:
    """Each owner's oldest working rows below the importance threshold: ``batch`` at most, and never the
    last ``keep`` of all such rows. Status doesn't count.

    Only an owner's oldest batch + keep rows can matter, so rows are limited (before the exchange too) and then counted."""
    rows = memories.where((F.col("tier") == "working") & (F.col("importance") < threshold))
    oldest = Window.partitionBy("owner_id").orderBy("ts_ms", "id")
    rows = rows.withColumn("place", F.row_number().over(oldest)).where(F.col("place") <= batch + keep)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("owner_id")))
    return rows.where(F.col("place") <= F.least(F.lit(batch), F.col("n") - keep)).drop("n")


def over_threshold(memories: DataFrame, threshold: int = 100) -> DataFrame:
    """Owners with more working rows than the threshold."""
    return memories.where("tier = 'working'").groupBy("owner_id").agg(F.count("*").alias("working")).where(F.col("working") > threshold)


def consolidate(memories: DataFrame, summariser: Summariser, as_of_ms: int, batch: int = 50, keep: int = 20, threshold: float = 0.8, dry_run: bool = False, embedder: Embedder | None = None, max_content: int = MAX_CONTENT) -> tuple[DataFrame, DataFrame]:
    """Memories after consolidation and a report (owner_id, summarized, created, archived, previews).

    Summaries become long-term rows: cut as any content, with the hash of the whole summary and, given an embedder,
    a vector. Their sources are archived. Owners for whom the summariser gives nothing keep their rows."""
    picked = consolidation_candidates(memories, batch, keep, threshold)
    packed = picked.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "content"))).alias("rows"))
    made = summariser(packed.select("owner_id", F.transform("rows", lambda r: r["content"]).alias("contents"), F.transform("rows", lambda r: r["id"]).alias("ids")))
    made = made.withColumn("summaries", F.filter("summaries", lambda s: F.trim(s) != ""))
    count = F.size("ids").cast("long")
    done = F.lit(not dry_run) & (F.size("summaries") > 0)
    report = made.select("owner_id", count.alias("summarized"), F.when(done, F.size("summaries")).otherwise(0).cast("long").alias("created"), F.when(done, count).otherwise(0).cast("long").alias("archived"), F.when(F.lit(dry_run), F.col("summaries")).alias("previews"))
    if dry_run:
        return memories, report
    good = made.where(F.size("summaries") > 0)
    old = good.select(F.explode("ids").alias("id")).withColumn("_old", F.lit(True))
    kept = memories.join(old, "id", "left").withColumn("tier", F.when(F.col("_old"), "archived").otherwise(F.col("tier"))).drop("_old")
    new = good.select("owner_id", "ids", F.explode("summaries").alias("content"))
    scope = memories.select("owner_id", "scope").distinct() if "scope" in memories.columns else None
    new = new.join(scope, "owner_id") if scope is not None else new
    new = embedder(new) if embedder is not None else new
    hashes = [short_hash(F.col("owner_id"), F.lit("lt"), F.col("content"), F.lit(as_of_ms)).alias("id"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash")]
    new = new.select("*", *hashes).withColumn("content", F.substring("content", 1, max_content))
    new = new.select("*", F.lit("system").alias("role"), F.lit(as_of_ms).cast("long").alias("ts_ms"), F.lit("long_term").alias("tier"), F.col("ids").alias("consolidated_from")).drop("ids")
    return with_defaults(kept).unionByName(with_defaults(new), allowMissingColumns=True), report


def briefing(recalled: DataFrame) -> DataFrame:
    """Bullet text of each user's recalled rows, in order; owners without rows have none."""
    packed = recalled.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["content"])), "\n")
    return packed.select("owner_id", F.concat(F.lit("Briefing ("), F.size("rows").cast("string"), F.lit(" items):\n"), lines).alias("briefing"))


def insights(used: DataFrame, query: str, generator: Generator) -> DataFrame:
    """(owner_id, insights) on a query from the memories used, in their order (``recall.reflect_order``). Without a
    reply the memories' contents stand for them."""
    row = F.struct("reflect_position", "certainty", "importance", "content")
    packed = used.groupBy("owner_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["reflect_position"].cast("string"), F.lit("] "), r["content"])), "\n")
    task = F.lit(f"Give insights on the query as a JSON array of strings.\n{query}\n")
    asked = generator(packed.withColumn("prompt", F.concat(task, lines)))
    found = F.when(F.col("reply").isNull(), F.transform("rows", lambda r: r["content"])).otherwise(parsed_strings(F.col("reply")))
    return asked.select("owner_id", found.alias("insights"))
