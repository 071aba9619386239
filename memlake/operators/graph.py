"""Entity graph: upserts, lookup and one-hop augmentation, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.schema import short_hash


def valid_triples(triples: DataFrame) -> DataFrame:
    """Triples with all three parts, lower-case and trimmed."""
    parts = ("from_entity", "relation", "to_entity")
    rows = triples
    for p in parts:
        rows = rows.where(F.coalesce(F.col(p), F.lit("")) != "")
    return rows.withColumns({p: F.trim(F.lower(p)) for p in parts})


def upsert_edges(triples: DataFrame) -> DataFrame:
    """One edge per (session, from, relation, to): the last written, by ``seq`` and, if there, ``pos`` (the place in
    what was written at once). Columns as ``EDGES``, without id collisions."""
    order = F.struct("seq", "pos") if "pos" in triples.columns else F.col("seq")
    key = ["session_id", "from_entity", "relation", "to_entity"]
    last = triples.groupBy(*key).agg(F.max_by(F.struct("confidence", "memory_id", F.col("seq").alias("created_ms")), order).alias("last"))
    return last.select(*key, F.coalesce("last.confidence", F.lit(1.0)).alias("confidence"), "last.memory_id", "last.created_ms").withColumn("id", short_hash(*[F.col(k) for k in key]))


def upsert_nodes(triples: DataFrame) -> DataFrame:
    """One node per (session, entity): the first written."""
    ends = triples.select("session_id", F.explode(F.array("from_entity", "to_entity")).alias("entity"), "seq")
    first = ends.groupBy("session_id", "entity").agg(F.min("seq").alias("created_ms"))
    return first.withColumn("id", short_hash(F.col("session_id"), F.col("entity")))


def lookup(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships of entities (session_id, entity), outgoing then incoming."""
    asked = entities.select("session_id", F.trim(F.lower("entity")).alias("entity")).distinct()
    out = edges.join(asked.withColumnRenamed("entity", "from_entity"), ["session_id", "from_entity"])
    into = edges.join(asked.withColumnRenamed("entity", "to_entity"), ["session_id", "to_entity"])
    columns = ["relation", "target", "confidence", "memory_id"]
    found = out.select("session_id", F.col("from_entity").alias("entity"), F.lit("outgoing").alias("type"), "relation", F.col("to_entity").alias("target"), "confidence", "memory_id")
    return found.unionByName(into.select("session_id", F.col("to_entity").alias("entity"), F.lit("incoming").alias("type"), "relation", F.col("from_entity").alias("target"), "confidence", "memory_id")).select("session_id", "entity", "type", *columns)


def related_memories(edges: DataFrame, entities: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories that an entity's edges came from."""
    ids = lookup(edges, entities).where("memory_id IS NOT NULL").select("session_id", "entity", F.col("memory_id").alias("id")).distinct()
    return ids.join(memories, "id")


def augment(results: DataFrame, edges: DataFrame, memories: DataFrame, limit: int = 10, seeds: int = 3, each: int = 5) -> DataFrame:
    """Append memories one hop away from the first results, cut at limit.

    Of each of the first ``seeds`` results of a session, the entities of its edges lead to the session's
    edges from them; the first ``each`` of those (by edge id) are read, seen memories among them or not."""
    known = edges.where("memory_id IS NOT NULL")
    first = results.where(F.col("position") <= seeds).select("owner_id", F.col("id").alias("seed"))
    own = first.join(edges.select(F.col("memory_id").alias("seed"), F.explode(F.array("from_entity", "to_entity")).alias("entity")), "seed").distinct()
    near = own.join(known.select(F.col("session_id").alias("owner_id"), F.col("from_entity").alias("entity"), F.col("id").alias("edge"), "memory_id"), ["owner_id", "entity"])
    near = near.select("owner_id", "seed", "edge", "memory_id").distinct()
    some = near.withColumn("n", F.row_number().over(Window.partitionBy("owner_id", "seed").orderBy("edge"))).where(F.col("n") <= each)
    fresh = some.select("owner_id", F.col("memory_id").alias("id")).distinct().join(results.select("owner_id", "id"), ["owner_id", "id"], "left_anti")
    found = fresh.join(memories.select("id", "content"), "id").select("owner_id", "id", "content", F.lit(1).alias("part"), F.lit(0).alias("position"))
    both = results.select("owner_id", "id", "content", F.lit(0).alias("part"), "position").unionByName(found)
    order = Window.partitionBy("owner_id").orderBy("part", "position", "id")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).withColumn("from_graph", F.col("part") == 1).drop("part")
