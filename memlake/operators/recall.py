"""Recall: rank a session's memories by meaning, keywords and recency and fuse the ranks.

All sessions are answered at once. Candidates are each owner's newest rows; three ranks become columns of
one row a candidate, so fusing them takes no join and the whole pipeline one exchange by owner.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions import vectors as V

K, CANDIDATES = 60, 3
LIVE = ("working", "long_term")


def _newest(*more: Column):
    return Window.partitionBy("owner_id").orderBy(*more, F.desc("ts_ms"), F.asc("id"))


def eligible(memories: DataFrame, tiers=LIVE, role: str | None = None, after: int | None = None, before: int | None = None, active_only: bool = True) -> DataFrame:
    """Rows of the tiers (and role, and time range, both ends in); session recall sees active rows only."""
    rows = memories.where(F.col("tier").isin(*tiers))
    if active_only:
        rows = rows.where(F.col("status") == "active")
    if role:
        rows = rows.where(F.col("role") == role)
    if after is not None:
        rows = rows.where(F.col("ts_ms") >= after)
    if before is not None:
        rows = rows.where(F.col("ts_ms") <= before)
    return rows


def newest(memories: DataFrame, limit: int) -> DataFrame:
    """Each owner's newest rows, with ``position`` from 1."""
    return memories.withColumn("position", F.row_number().over(_newest())).where(F.col("position") <= limit)


def semantic_score(similarity: Column) -> Column:
    return similarity * 0.6 + F.coalesce("importance", F.lit(0.5)) * 0.2 + F.coalesce("certainty", F.lit(0.5)) * 0.2


def recall(memories: DataFrame, query: str | None = None, limit: int = 10, query_vector: DataFrame | None = None, full_scan: bool = False, **filters) -> DataFrame:
    """Each owner's top rows: position, fused score and, with vectors, similarity.

    ``query_vector``: one row, column ``query_vector``. Without a query: the newest rows. Only the newest
    3 x limit rows are looked at unless ``full_scan``. Ties keep the order of the lists semantic,
    keyword, recency, and then the rank there."""
    rows = eligible(memories, **filters)
    if not (query and query.strip()):
        return newest(rows, limit)
    rows = rows.withColumn("recency", F.row_number().over(_newest()))
    if not full_scan:
        rows = rows.where(F.col("recency") <= limit * CANDIDATES)
    rows = rows.withColumn("words", T.words(F.col("content")))
    rows = rows.withColumn("keyword", T.keyword_score(F.col("words"), query)).drop("words")
    ranked = Window.partitionBy("owner_id")
    rank = lambda *by: F.row_number().over(ranked.orderBy(*by, F.asc("recency")))
    lists = [("by_keyword", F.when(F.col("keyword") > 0, rank(F.desc(F.when(F.col("keyword") > 0, F.col("keyword")))))), ("by_recency", F.col("recency"))]
    if query_vector is not None:
        rows = rows.crossJoin(F.broadcast(query_vector.select("query_vector").limit(1)))
        rows = rows.withColumn("similarity", F.coalesce(V.cosine(F.col("query_vector"), F.col("embedding")), F.lit(0.0))).drop("query_vector")
        rows = rows.withColumn("blend", semantic_score(F.col("similarity")))
        lists.insert(0, ("by_meaning", rank(F.desc("blend"))))
    for name, place in lists:
        rows = rows.withColumn(name, place)
        rows = rows.withColumn(name, F.when(F.col(name) <= limit, F.col(name)))
    part = lambda name: F.coalesce(F.lit(1.0) / (K + F.col(name)), F.lit(0.0))
    score = part(lists[0][0])
    for name, _ in lists[1:]:
        score = score + part(name)
    first = F.coalesce(*[F.when(F.col(name).isNotNull(), F.struct(F.lit(k).alias("list"), F.col(name).cast("int").alias("place"))) for k, (name, _) in enumerate(lists)])
    fused = rows.withColumn("score", score).withColumn("first", first).where("first IS NOT NULL")
    order = ranked.orderBy(F.desc("score"), F.asc("first"))
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("first", *[n for n, _ in lists if n != "by_recency"], "by_recency")


def recall_user(memories: DataFrame, query: str | None = None, limit: int = 10, query_vector: DataFrame | None = None, tiers=LIVE, role: str | None = None, active_only: bool = False) -> DataFrame:
    """Each user's rows: by similarity over all of them with a vector, else the newest that contain a term.
    Status counts only with ``active_only``."""
    rows = eligible(memories, tiers, role, active_only=active_only)
    if query and query.strip():
        if query_vector is not None:
            rows = rows.crossJoin(F.broadcast(query_vector.select("query_vector").limit(1)))
            rows = rows.withColumn("similarity", F.coalesce(V.cosine(F.col("query_vector"), F.col("embedding")), F.lit(0.0))).drop("query_vector")
            return rows.withColumn("position", F.row_number().over(_newest(F.desc("similarity")))).where(F.col("position") <= limit)
        if (hit := T.like_any(F.col("content"), query)) is not None:
            rows = rows.where(hit)
    return newest(rows, limit)


def blend(session: DataFrame, user: DataFrame, owners: DataFrame, limit: int = 10) -> DataFrame:
    """Session results, then the user's rows with other contents, cut at limit. ``owners``: owner_id and
    user_id of each session."""
    some = user.where(F.col("position") <= ceil(limit / 2)).select(F.col("owner_id").alias("user_id"), "id", "content", "role", "ts_ms", "position")
    offered = owners.join(some, "user_id")
    fresh = offered.join(session.select("owner_id", "content").distinct(), ["owner_id", "content"], "left_anti")
    parts = session.select("owner_id", "id", "content", "role", "ts_ms", F.lit(0).alias("part"), "position", F.lit(False).alias("user_memory"))
    parts = parts.unionByName(fresh.select("owner_id", "id", "content", "role", "ts_ms", F.lit(1).alias("part"), "position", F.lit(True).alias("user_memory")))
    order = Window.partitionBy("owner_id").orderBy("part", "position")
    return parts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("part")


def history(memories: DataFrame, limit: int = 20) -> DataFrame:
    """Each owner's newest rows whatever their status, oldest first. Belief fields are not read back."""
    rows = newest(memories, limit)
    order = Window.partitionBy("owner_id").orderBy(F.asc("ts_ms"), F.desc("id"))
    rows = rows.withColumn("position", F.row_number().over(order))
    return rows.withColumns({"certainty": F.lit(0.5), "status": F.lit("active"), "reinforcement_count": F.lit(0).cast("long")})


def reflect_order(recalled: DataFrame) -> DataFrame:
    """Recall results re-ordered by 0.6 similarity (0.5 if unknown) + 0.4 certainty."""
    similarity = F.coalesce("similarity", F.lit(0.5)) if "similarity" in recalled.columns else F.lit(0.5)
    rows = recalled.withColumn("weight", similarity * 0.6 + F.col("certainty") * 0.4)
    order = Window.partitionBy("owner_id").orderBy(F.desc("weight"), F.asc("position"))
    return rows.withColumn("reflect_position", F.row_number().over(order))


def with_metadata(memories: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose metadata (a JSON object) has these values of top-level fields; an opt-in filter."""
    rows = memories
    for key, value in wanted.items():
        rows = rows.where(F.try_element_at(F.from_json("metadata", "map<string,string>"), F.lit(key)) == value)
    return rows


def vector_search(memories: DataFrame, query_vector: DataFrame, limit: int = 10, threshold: float = 0.0, agent_id: str | None = None) -> DataFrame:
    """Top rows of the whole store by strict cosine at or over the threshold; not filtered by agent unless asked for."""
    rows = memories if agent_id is None else memories.where(F.col("owner_id") == agent_id)
    rows = rows.crossJoin(F.broadcast(query_vector.select("query_vector").limit(1)))
    scored = rows.withColumn("score", V.cosine_strict(F.col("query_vector"), F.col("embedding"))).drop("query_vector")
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(limit)
