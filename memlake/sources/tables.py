"""The benchmark tables as tables of the model. Fields that they lack are fixed rules of their keys, the
same in the oracle's SQL. Texts are whole: only the verbs that store a memory cut it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.graph import valid_triples
from memlake.schema import short_hash

EPOCH_MS = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_memories(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Conversations as session memories; with vectors, every row whose number below 503 is a vector's has it."""
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"owner_id": F.col("conv_id").cast("string"), "ts_ms": EPOCH_MS + F.col("conv_id") * 1_000_000 + t * 1000})
    rows = rows.select(
        "owner_id", short_hash(F.col("owner_id"), F.col("text"), F.col("ts_ms")).alias("id"), F.col("text").alias("content"), "role", "ts_ms",
        F.when(t % 7 == 6, "archived").when(t % 5 == 4, "long_term").otherwise("working").alias("tier"),
        F.when(t % 6 == 5, "superseded").when((F.col("conv_id") + t) % 11 == 7, "contradicted").otherwise("active").alias("status"),
        (((F.col("conv_id") * 7 + t * 3) % 10).cast("double") / 10).alias("importance"), (F.lit(0.5) + (t % 3).cast("double") * 0.15).alias("certainty"),
        (t % 3).alias("reinforcement_count"), F.when(t % 3 > 0, F.col("ts_ms") + (t % 3) * 500).alias("last_verified_ms"), ((F.col("conv_id") * 8 + t) % 503).alias("vec_id"),
    )
    if not vectors:
        return rows
    return rows.join(embeddings(spark, sf_dir), "vec_id", "left")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 3) -> DataFrame:
    return embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query_vector"))


def agent_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as memories of agents, one agent a label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("string").alias("owner_id"), F.col("vec_id").cast("string").alias("id"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (EPOCH_MS + F.col("vec_id") * 1000).alias("ts_ms"))


def user_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories of users, one user a source."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").withColumns({"owner_id": F.col("source"), "ts_ms": EPOCH_MS + d * 1000})
    return rows.select(
        "owner_id", short_hash(F.col("owner_id"), F.col("text"), F.col("ts_ms")).alias("id"), F.col("text").alias("content"), F.when(d % 3 == 0, "assistant").otherwise("user").alias("role"), "ts_ms",
        F.when(d % 9 == 8, "archived").when(d % 4 == 3, "long_term").otherwise("working").alias("tier"), F.lit("active").alias("status"),
        ((d * 3 % 10).cast("double") / 10).alias("importance"), (F.lit(0.5) + (d % 5).cast("double") * 0.1).alias("certainty"), d.alias("doc_id"),
    )


def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user of each session."""
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return conv.select(F.col("conv_id").cast("string").alias("owner_id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("user_id"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on one memory a user."""
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "reinforce").when(kind == "error", "contradict").when(kind == "signup", "invalidate")
    rows = table(spark, sf_dir, "events").withColumn("op", op).where(F.col("op").isNotNull())
    user = F.col("user_id").cast("string")
    return rows.select(user.alias("owner_id"), user.alias("memory_id"), "op", F.lit(None).cast("double").alias("amount"), F.unix_millis(F.col("ts").cast("timestamp")).alias("op_ms"), F.col("event_id").alias("seq"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer in_nation nation, and nation in_region region again with each customer; sessions are segments."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    both = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.array(F.struct(F.col("c_name").alias("from_entity"), F.lit("in_nation").alias("relation"), F.col("n_name").alias("to_entity")), F.struct(F.col("n_name").alias("from_entity"), F.lit("in_region").alias("relation"), F.col("r_name").alias("to_entity")))
    rows = both.select(F.col("c_mktsegment").alias("session_id"), F.explode(said).alias("t"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("memory_id"), F.lit(0.9).alias("confidence"), F.col("c_custkey").alias("seq"))
    return valid_triples(rows.select("session_id", "t.*", "memory_id", "confidence", "seq"))


def graph_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory per customer."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("owner_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("content"), "c_acctbal")
