"""Streaming ingest of the operation log: an extension beyond the reference's calls.

Operations arrive as files, in any order and however late. Each micro-batch is appended to the log once (its path
carries the batch number, so a replayed batch overwrites itself). Repeated deliveries of a (memory, sequence number)
are dropped where the log is read, so that nothing is lost to a watermark and the stream keeps no state; state is the
same fold over the log as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import belief
from memlake.schema import OPERATIONS
from memlake.sources import tables
from memlake.sources.store import scratch


def read_operations(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(operations: DataFrame, log: str, checkpoint: str):
    """Start a query that appends operations to the log; returns it."""

    def append(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["owner_id", "memory_id", "seq"]).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return operations.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_rows(spark: SparkSession, log: str) -> DataFrame:
    """The log's operations, each once."""
    return spark.read.schema(OPERATIONS).parquet(log).dropDuplicates(["owner_id", "memory_id", "seq"])


def state(spark: SparkSession, log: str) -> DataFrame:
    return belief.fold(log_rows(spark, log))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of operations in several batches, not in order of time and one part twice; the
    state that results."""
    place = scratch(spark, "stream")
    operations = tables.operations(spark, sf_dir)
    operations.repartition(6, F.xxhash64("seq")).write.parquet(f"{place}/in")
    operations.where(F.col("seq") % 5 == 0).repartition(2).write.mode("append").parquet(f"{place}/in")
    ingest(read_operations(spark, f"{place}/in", 2), f"{place}/log", f"{place}/checkpoint").awaitTermination()
    return state(spark, f"{place}/log").select("owner_id", "certainty", "reinforcement_count")
