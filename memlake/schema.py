"""Schemas of the model's tables and defaults of missing fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORIES = """scope string, owner_id string, id string, content string, role string, ts_ms long, metadata string,
    content_hash string, embedding array<double>, tier string, consolidated_from array<string>, importance double,
    certainty double, reinforcement_count long, last_verified_ms long, memory_type string, status string,
    contradicts array<string>"""
EDGES = "session_id string, id string, from_entity string, relation string, to_entity string, confidence double, memory_id string, created_ms long"
OPERATIONS = "owner_id string, memory_id string, op string, amount double, op_ms long, seq long"
CLAIMS = """window_id string, pos int, id string, canonical_text string, subject_entity_id string, subject_text string,
    predicate string, object_text string, object_entity_id string, memory_type string, explicitness string, polarity string,
    status string, confidence double, temporal struct<raw_text:string,normalized_start:string,normalized_end:string,
    granularity:string,relation_type:string,relation_to_event:string>, source_turn_index int, linked_claim_ids array<string>,
    extraction_confidence double, entity_resolution_confidence double, temporal_resolution_confidence double,
    support_count long, source_directness double"""
ENTITIES = "window_id string, id string, name string, type string, aliases array<string>"

ROLES, TIERS = ("user", "assistant", "system"), ("working", "long_term", "archived")
#: Characters of a memory's content that are stored.
MAX_CONTENT = 4000


@dataclass(frozen=True)
class Config:
    """Settings of a store, with the defaults of the published interface."""

    max_context_length: int = MAX_CONTENT
    semantic_search: bool = True
    graph_memory: bool = False
    auto_consolidate: bool = False
    consolidate_threshold: int = 100
    consolidate_keep: int = 20
    consolidate_batch: int = 50
    importance_scoring: bool = False
    importance_threshold: float = 0.8
    contradiction_detection: bool = False
    default_memory_type: str = "episodic"


def short_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def with_defaults(memories: DataFrame) -> DataFrame:
    """Fill what older rows lack: columns that don't exist and null fields."""
    spark = memories.sparkSession
    full = memories.unionByName(spark.createDataFrame([], MEMORIES), allowMissingColumns=True)
    return full.withColumns({
        "importance": F.coalesce("importance", F.lit(0.5)),
        "certainty": F.coalesce("certainty", F.lit(0.5)),
        "reinforcement_count": F.coalesce("reinforcement_count", F.lit(0).cast("long")),
        "last_verified_ms": F.coalesce("last_verified_ms", "ts_ms"),
        "tier": F.coalesce("tier", F.lit("working")),
        "memory_type": F.coalesce("memory_type", F.lit("episodic")),
        "status": F.coalesce("status", F.lit("active")),
    })


def remembered(rows: DataFrame, scope: str, config: Config | None = None) -> DataFrame:
    """New memories from rows (owner_id, content, role, ts_ms and, if there, metadata, embedding): ids and
    hashes of the whole content, content cut, importance scored if asked for."""
    from memlake.functions.text import importance

    config = config or Config()
    new = rows.withColumns({
        "scope": F.lit(scope),
        "id": short_hash(F.col("owner_id"), F.col("content"), F.col("ts_ms")),
        "content_hash": F.substring(F.sha2("content", 256), 1, 16),
        "memory_type": F.lit(config.default_memory_type),
        "importance": importance(F.col("content")) if config.importance_scoring else F.lit(0.5),
        "last_verified_ms": F.col("ts_ms"),
    })
    return with_defaults(new.withColumn("content", F.substring("content", 1, config.max_context_length)))


def collisions(memories: DataFrame) -> DataFrame:
    """Ids that more than one row has: same owner, content and millisecond."""
    return memories.groupBy("scope", "id").count().where("count > 1")
