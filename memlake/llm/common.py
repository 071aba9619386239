"""Shared plumbing of the training-data operators.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``, so a
lost executor costs a re-read and not a recomputation of everything before it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker. Long documents make the byte bound
#: the one that counts; both keep a worker's memory flat whatever the partition holds.
ARROW_ROWS, ARROW_BYTES = 2048, 8 << 20

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="memlake-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


class Stash:
    """Tables written to the shared folder; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.replaced = spark, {}, []
        for made in _SCOPES[-1:]:
            made.append(self)

    def put(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/memlake/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        if name in self.paths:
            self.replaced.append(self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def clear(self, *but: str) -> None:
        """Drop all tables of this stash but the named ones."""
        for path in self.replaced:
            self._delete(path)
        self.replaced = []
        self.drop(*[name for name in self.paths if name not in but])

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)


_SCOPES: list[list[Stash]] = []


@contextmanager
def released() -> Iterator[None]:
    """Drops, at its end, the tables that operators stashed inside; write what they return before that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for stash in _SCOPES.pop():
            stash.clear()


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and, as ``size``, how many of ``rows`` have it.

    Of P shuffle partitions, a key with over 1 / (8 P) of all rows is hot: there are at most 8 P of these,
    which are broadcast, so that no hot key meets in one task. The others meet in an exchange."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, largest = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    bound = max(total // (8 * partitions), 1000)
    if largest <= bound:
        return rows.join(table, keys)
    hot = table.where(F.col("size") > bound)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col("size") <= bound), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``; no state is kept between batches."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
