"""Line deduplication across documents, with DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points that stand in two or more documents keep their lines only in the document
with the smallest id. Lines travel as 96-bit key hashes with document and position, never as text:

1. hot keys: lines are counted by a coarse hash bucket, then exactly within heavy buckets. A key is
   hot with over 1/(8 P) of all lines (P shuffle partitions), so at most 8 P keys are, and their
   table can be broadcast. Hot keys get a salt from the document id;
2. lines are range-partitioned by key hash and salt and sorted within by document and position; the
   first row of each key streams by first and names the document that keeps it;
3. the few first rows of the hot keys' salts meet in one small aggregation;
4. dropped positions become one run-length coded keep bitmap a document (runs of kept lines), which
   the documents then apply.

Cases: null or empty text is one empty line; a null doc_id counts as the smallest; rows that repeat
a doc_id count as one document, each with its own lines; an empty table gives no rows; other
columns pass through ``dedup_lines`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import Stash

MIN_CHARS = 10
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Coarse buckets for finding hot keys; salts a hot key is dealt to, a shuffle partition.
BUCKETS, SALTS = 1 << 16, 4


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_table(docs: DataFrame) -> DataFrame:
    """One row a line whose key is long enough: document, hash of its text, position, key hashes."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc", "version", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= MIN_CHARS)
    return keys.select("doc", "version", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))


def hot_keys(lines: DataFrame, partitions: int) -> DataFrame:
    """Key hashes with over 1/(8 partitions) of all lines: at most 8 x partitions rows."""
    bucket = F.pmod("h", F.lit(BUCKETS))
    counts = lines.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    least = F.greatest(F.col("total") / F.lit(8 * partitions), F.lit(1000))
    heavy = counts.join(F.broadcast(total)).where(F.col("n") > least).select("bucket", least.alias("least"))
    inside = lines.withColumn("bucket", bucket).join(F.broadcast(heavy), "bucket")
    return inside.groupBy("h", "g").agg(F.count("*").alias("n"), F.first("least").alias("least")).where(F.col("n") > F.col("least")).select("h", "g")


def keep_runs(docs: DataFrame, stash: Stash) -> DataFrame:
    """Run-length coded keep bitmap of each document that loses lines: doc, version, runs of kept
    lines (start from 1, length; the last run is open), n_dropped."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = stash.put("lines", line_table(docs))
    hot = F.broadcast(hot_keys(lines, partitions).withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS * partitions))).otherwise(-1)
    dealt = lines.join(hot, ["h", "g"], "left").withColumn("salt", salt).drop("hot").repartitionByRange(partitions, "h", "g", "salt")
    run = Window.partitionBy("h", "g", "salt").orderBy(F.asc_nulls_first("doc"), "pos")
    seen = dealt.withColumn("first", F.struct(F.first("doc").over(run).alias("doc")))
    cold = seen.where("salt < 0").select("doc", "version", "pos", "first")
    some = stash.put("salted", seen.where("salt >= 0").select("h", "g", "doc", "version", "pos", "first"))
    firsts = some.groupBy("h", "g").agg(F.min("first").alias("least"))
    warm = some.join(F.broadcast(firsts), ["h", "g"]).select("doc", "version", "pos", F.col("least").alias("first"))
    dropped = cold.unionByName(warm).where(~F.col("doc").eqNullSafe(F.col("first.doc")))
    bitmaps = dropped.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # Before the k-th dropped position stand the lines since the one dropped before it.
    before = F.transform("at", lambda x, k: F.struct((F.when(k > 0, F.get("at", k - 1)).otherwise(F.lit(-1)) + 2).alias("start"), (x - F.when(k > 0, F.get("at", k - 1)).otherwise(F.lit(-1)) - 1).alias("length")))
    tail = F.array(F.struct((F.element_at("at", -1) + 2).alias("start"), F.lit(1 << 30).alias("length")))
    runs = F.filter(F.concat(before, tail), lambda r: r["length"] > 0)
    return bitmaps.select("doc", "version", runs.alias("runs"), F.size("at").alias("n_dropped"))


def dedup_lines(docs: DataFrame, stash: Stash | None = None) -> DataFrame:
    """Each document's ``row`` (all its columns), ``text`` without the dropped lines, n_lines, n_dropped."""
    stash = stash or Stash(docs.sparkSession)
    bitmaps = keep_runs(docs.select("doc_id", "text"), stash).select("doc", F.col("version").alias("of"), F.struct("runs", "n_dropped").alias("bitmap"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"))
    both = rows.join(bitmaps, F.col("id").eqNullSafe(F.col("doc")) & (F.col("version") == F.col("of")), "left")
    lines = split_lines(F.col("row.text"))
    kept = F.flatten(F.transform("bitmap.runs", lambda r: F.slice(lines, r["start"], r["length"])))
    text = F.when(F.col("bitmap").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return both.select("row", text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce("bitmap.n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of the remaining lines."""
    kept = F.coalesce("text", F.lit(""))
    return dedup_lines(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the same by plain grouping.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
