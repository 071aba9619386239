"""Reading and writing the store's tables: Parquet folders, bucketed by owner where a catalogue is at hand."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from memlake.schema import with_defaults


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that the session names (``spark.checkpoint.dir``); where that is unset a
    temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{found.rstrip('/') if found else 'file://' + tempfile.mkdtemp(prefix='memlake-')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Tables below one path. Appends are new files; nothing is updated in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._last: dict[str, int] = {}

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one that was never written; columns added since then are null."""
        fs, path = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def version(self, name: str) -> int:
        """The next number of a table's writes, from 1. A number is taken by creating a file, so that of two
        writers one takes the next."""
        fs, folder = self._path("_versions", name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if name not in self._last:
            found = fs.listStatus(folder) if fs.exists(folder) else []
            self._last[name] = max((int(x.getPath().getName()) for x in found), default=0)
        while True:
            self._last[name] += 1
            if fs.createNewFile(path(folder, f"{self._last[name]:012d}")):
                return self._last[name]

    def _path(self, *parts: str) -> tuple:
        found = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def memories(self, schema: str) -> DataFrame:
        return with_defaults(self.read("memories", schema))


def save_bucketed(rows: DataFrame, table: str, buckets: int, owner: str = "owner_id", path: str | None = None) -> None:
    """A catalogue table bucketed and sorted by owner: recall, stats and folds on it need no exchange."""
    writer = rows.write.mode("overwrite").bucketBy(buckets, owner).sortBy(owner, "ts_ms")
    (writer.option("path", path) if path else writer).saveAsTable(table)
