"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a
DataFrame, which is written and read again before the next. All but the last return the columns of
``documents``; where a stage changes the text, n_chars counts the new one. Documents whose whole
text goes stay as empty ones until near-copy removal leaves one of them.

Cases: null and empty texts are judged, and stay or go, as each operator's docstring says; rows that
repeat id and text stay once after the near-copy stage; an empty table gives no rows; extra columns of
``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import line_dedup, packing, quality, simhash, suffix_dedup
from memlake.llm.common import Stash, documents, released


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejected documents go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that another document with a smaller id has go."""
    found = line_dedup.dedup_lines(docs).select(F.col("row").withField("text", F.col("text")).alias("row"))
    return _counted(found.select("row.*"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: strings of 200 bytes that occur twice or more go."""
    return _counted(suffix_dedup.dedup_text(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: pieces with their ids, sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("suffixes", suffix_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor similarity components nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them rows go through a table in the shared folder."""
    docs = documents(spark, sf_dir)
    stash = Stash(spark)
    for name, stage in STAGES[:-1]:
        with released():  # a stage's own tables go once its rows are written
            docs = stash.put(f"stage_{name}", stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
