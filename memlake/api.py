"""A store of memories behind the usual verbs: remember, recall, forget, reinforce, consolidate.

Writes append: new rows to ``memories`` and ``edges``, changes to ``operations``. Reads fold the operations into
present state first. Every verb takes DataFrames of many owners where that makes sense; the single-owner forms
wrap them. Operations apply in the order of the calls, which the log numbers. Times are explicit (``as_of_ms``) where a run
is to be repeated; else they are the clock's, a millisecond apart at least."""

from __future__ import annotations

import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake import schema as S
from memlake.functions.text import parsed_importance
from memlake.operators import belief, graph, lifecycle, recall, stats
from memlake.providers import Embedder, Generator, Summariser, first_sentences, hash_embedder, no_reply, parsed_triples
from memlake.sources.store import Store

LOG_SCHEMA = S.OPERATIONS


class MemoryLake:
    """``scope`` of the verbs: session memories unless the name says user."""

    def __init__(self, spark: SparkSession, path: str, config: S.Config | None = None, embedder: Embedder | None = None, generator: Generator | None = None, summariser: Summariser = first_sentences):
        self.spark, self.store, self.config = spark, Store(spark, path), config or S.Config()
        self.embedder, self.generator, self.summariser = embedder or hash_embedder(), generator, summariser
        self._last_ms = 0

    def _now(self, as_of_ms: int | None) -> int:
        if as_of_ms is None:
            as_of_ms = self._last_ms = max(time.time_ns() // 1_000_000, self._last_ms + 1)
        return as_of_ms

    def close(self) -> None:
        """Forget what was read of the store's files; the next call reads them anew."""
        self.store = Store(self.spark, self.store.path)

    # writing

    def remember_all(self, rows: DataFrame, scope: str = "session") -> DataFrame:
        """Append rows (owner_id, content, role, ts_ms, metadata if there); returns them with ids."""
        if self.config.semantic_search:
            rows = self.embedder(rows)
        new = S.remembered(rows, scope, self.config)
        if self.config.importance_scoring and self.generator is not None:
            asked = self.generator(new.withColumn("prompt", F.concat(F.lit("Rate the importance of this memory from 0.0 to 1.0. Reply with the number alone.\n"), F.substring("content", 1, 300))))
            new = asked.withColumn("importance", parsed_importance(F.col("reply"), F.col("importance"))).drop("prompt", "reply")
        self.store.append("memories", new)
        if scope == "session" and self.config.graph_memory and self.generator is not None:
            asked = self.generator(new.withColumn("prompt", F.concat(F.lit("List up to 5 facts as a JSON array of objects with from, relation, to.\n"), F.col("content"))))
            told = asked.select(F.col("owner_id").alias("session_id"), F.col("id").alias("memory_id"), F.col("ts_ms").alias("seq"), F.posexplode(parsed_triples(F.col("reply"))).alias("pos", "t"))
            self.relate(told.select("session_id", "t.*", "memory_id", "seq", "pos"))
        return new

    def remember(self, session_id: str, content: str, role: str = "user", metadata: str | None = None, as_of_ms: int | None = None) -> DataFrame:
        return self._one(session_id, content, role, metadata, as_of_ms, "session")

    def remember_user(self, user_id: str, content: str, role: str = "user", metadata: str | None = None, as_of_ms: int | None = None) -> DataFrame:
        return self._one(user_id, content, role, metadata, as_of_ms, "user")

    def _one(self, owner: str, content: str, role: str, metadata: str | None, as_of_ms: int | None, scope: str) -> DataFrame:
        if role not in S.ROLES:
            raise ValueError(f"role must be one of {S.ROLES}")
        as_of_ms = self._now(as_of_ms)
        rows = self.spark.createDataFrame([(owner, content, role, as_of_ms, metadata)], "owner_id string, content string, role string, ts_ms long, metadata string")
        new = self.remember_all(rows, scope)
        if scope == "session" and self.config.auto_consolidate and not lifecycle.over_threshold(self.memories(owner=owner), self.config.consolidate_threshold).isEmpty():
            self.consolidate(owner, as_of_ms=as_of_ms)
        return new

    def relate(self, triples: DataFrame) -> None:
        """Append triples (session_id, from_entity, relation, to_entity, confidence, memory_id, seq and, if there, pos)."""
        self.store.append("triples", graph.valid_triples(triples.withColumn("pos", F.col("pos") if "pos" in triples.columns else F.lit(0))))

    def apply(self, ids: DataFrame, op: str, amount: float | None = None, as_of_ms: int | None = None, scope: str | None = None) -> DataFrame:
        """Log one operation on each memory of ``ids`` (column id), of both tables or of one scope's."""
        rows = self.memories(scope).join(ids.select("id").distinct(), "id", "left_semi")
        times = [F.lit(self._now(as_of_ms)).cast("long").alias("op_ms"), F.lit(self.store.version("operations")).cast("long").alias("seq")]
        ops = rows.select("owner_id", F.col("id").alias("memory_id"), F.lit(op).alias("op"), F.lit(amount).cast("double").alias("amount"), *times)
        self.store.append("operations", ops)
        return ops

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def set_importance(self, id: str, importance: float, as_of_ms: int | None = None) -> None:
        self.apply(self._ids(id), "importance", importance, as_of_ms)

    def reinforce(self, id: str, boost: float = belief.BOOST, as_of_ms: int | None = None) -> DataFrame:
        """(id, certainty, reinforcement_count) after it."""
        self.apply(self._ids(id), "reinforce", boost, as_of_ms)
        return self.memories(None).where(F.col("id") == id).select("id", "certainty", "reinforcement_count")

    def contradict(self, session_id: str, contradicted_id: str, content: str, role: str = "user", as_of_ms: int | None = None) -> DataFrame | None:
        """Mark a session memory (of any session) contradicted and remember the new content, which names it.
        Blank content only marks."""
        as_of_ms = self._now(as_of_ms)
        self.apply(self._ids(contradicted_id), "contradict", belief.DROP, as_of_ms, "session")
        if not content.strip():
            return None
        return self.remember(session_id, content, role, f'{{"contradicts":["{contradicted_id}"]}}', as_of_ms)

    def invalidate(self, id: str, as_of_ms: int | None = None) -> None:
        self.apply(self._ids(id), "invalidate", None, as_of_ms)

    def forget(self, session_id: str, before: int | None = None, id: str | None = None, include_long_term: bool = False, as_of_ms: int | None = None, scope: str = "session") -> int:
        """Delete rows; returns how many. Graph edges stay."""
        own = self.memories(scope, session_id)
        _, gone = belief.forget(own, before, id, include_long_term)
        ids = gone.select("id")
        n = ids.count()
        self.apply(ids, "delete", None, as_of_ms, scope)
        return n

    def forget_user(self, user_id: str, **options) -> int:
        return self.forget(user_id, scope="user", **options)

    # reading

    def operations(self) -> DataFrame:
        return self.store.read("operations", LOG_SCHEMA)

    def memories(self, scope: str | None = "session", owner: str | None = None) -> DataFrame:
        """Present state of a scope's memories, or of one owner's: then only their part of the log is read."""
        rows, log = self.store.memories(S.MEMORIES), self.operations()
        rows = rows if scope is None else rows.where(F.col("scope") == scope)
        if owner is not None:
            rows, log = (x.where(F.col("owner_id") == owner) for x in (rows, log))
        return belief.current(rows, log)

    def _vector(self, query: str | None) -> DataFrame | None:
        if not (self.config.semantic_search and query and query.strip()):
            return None
        asked = self.spark.createDataFrame([(query,)], "content string")
        return self.embedder(asked).select(F.col("embedding").alias("query_vector"))

    def recall(self, session_id: str, query: str | None = None, limit: int = 10, user_id: str | None = None, include_graph: bool = True, **filters) -> DataFrame:
        own = self.memories(owner=session_id)
        found = recall.recall(own, query, limit, self._vector(query), **filters)
        if self.config.graph_memory and include_graph and query and query.strip():
            more = graph.augment(found, graph.upsert_edges(self._triples()), self.memories(), limit)
            rest = self.memories().select("id", "role", "ts_ms", "certainty", "importance")
            found = more.select("owner_id", "id", "content", "position").join(rest, "id")
        if user_id is not None:
            users = recall.recall_user(self.memories("user", user_id), query, limit, self._vector(query))
            owners = self.spark.createDataFrame([(session_id, user_id)], "owner_id string, user_id string")
            found = recall.blend(found, users, owners, limit)
        return found

    def recall_user(self, user_id: str, query: str | None = None, limit: int = 10, **filters) -> DataFrame:
        return recall.recall_user(self.memories("user", user_id), query, limit, self._vector(query), **filters)

    def history(self, session_id: str, limit: int = 20) -> DataFrame:
        return recall.history(self.memories(owner=session_id), limit)

    def timeline(self, session_id: str, limit: int = 50) -> DataFrame:
        return belief.timeline(self.memories(owner=session_id), limit)

    def detect_contradictions(self, session_id: str, content: str, limit: int = 20) -> DataFrame:
        said = self.spark.createDataFrame([(session_id, "new", content)], "owner_id string, statement_id string, statement string")
        mem = self.memories(owner=session_id)
        if self.config.contradiction_detection and self.generator is not None:
            return belief.contradictions_by_model(said, mem, self.generator, limit)
        return belief.find_contradictions(said, mem, limit)

    def reflect(self, session_id: str, query: str, limit: int = 20, user_id: str | None = None, include_archived: bool = False) -> tuple[DataFrame, DataFrame]:
        """Insights (query, insights) and the memories used, in order. A failed model call gives their contents."""
        tiers = S.TIERS if include_archived else recall.LIVE
        used = recall.reflect_order(recall.recall(self.memories(owner=session_id), query, limit, self._vector(query), tiers=tiers))
        found = lifecycle.insights(used, query, self.generator or no_reply)
        return found.select(F.lit(query).alias("query"), "insights"), used

    def _triples(self) -> DataFrame:
        return self.store.read("triples", "session_id string, from_entity string, relation string, to_entity string, confidence double, memory_id string, seq long, pos int")

    def graph(self, session_id: str, entity: str) -> tuple[DataFrame, DataFrame]:
        """Relationships of an entity and the memories they came from."""
        edges = graph.upsert_edges(self._triples())
        asked = self.spark.createDataFrame([(session_id, entity)], "session_id string, entity string")
        return graph.lookup(edges, asked), graph.related_memories(edges, asked, self.memories())

    def stats(self, session_id: str) -> DataFrame:
        return stats.session_stats(self.memories(owner=session_id))

    def user_stats(self, user_id: str) -> DataFrame:
        return stats.session_stats(self.memories("user", user_id))

    # life cycle

    def consolidate(self, session_id: str, batch: int | None = None, keep: int | None = None, dry_run: bool = False, as_of_ms: int | None = None, scope: str = "session") -> DataFrame:
        """Summarise and archive the oldest working rows; a report."""
        c, as_of_ms = self.config, self._now(as_of_ms)
        own = self.memories(scope, session_id)
        batch, keep = c.consolidate_batch if batch is None else batch, c.consolidate_keep if keep is None else keep
        embedder = self.embedder if c.semantic_search else None
        after, report = lifecycle.consolidate(own, self.summariser, as_of_ms, batch, keep, c.importance_threshold, dry_run, embedder, c.max_context_length)
        said = report.collect()  # one row: one owner
        if not dry_run and said and said[0]["created"]:
            picked = lifecycle.consolidation_candidates(own, batch, keep, c.importance_threshold).select("id")
            fresh = after.join(own.select("id"), "id", "left_anti").withColumn("scope", F.lit(scope))
            new = S.with_defaults(fresh)
            self.store.append("memories", new)
            self.apply(picked, "archive", None, as_of_ms, scope)
        return self.spark.createDataFrame(said, report.schema)

    def consolidate_user(self, user_id: str, **options) -> DataFrame:
        return self.consolidate(user_id, scope="user", **options)

    def wake_briefing(self, user_id: str, limit: int = 20) -> str:
        """Bullet text of the user's newest memories; empty without any."""
        found = lifecycle.briefing(self.recall_user(user_id, None, limit)).collect()
        return found[0]["briefing"] if found else ""

    def handle_sleep(self, session_id: str | None = None, user_id: str | None = None, as_of_ms: int | None = None) -> list[str]:
        """Consolidate session and user; what failed is returned and not raised."""
        failed = []
        for owner, scope in ((session_id, "session"), (user_id, "user")):
            if owner:
                try:
                    self.consolidate(owner, as_of_ms=as_of_ms, scope=scope)
                except Exception as e:  # noqa: BLE001  sleeping is best effort
                    failed.append(f"{scope}: {e}")
        return failed


class VectorAdapter(Protocol):
    """What a store of agents' memories offers; verbs take and give DataFrames."""

    def init(self) -> None: ...
    def store_many(self, rows: DataFrame) -> DataFrame: ...
    def get(self, id: str, as_of_ms: int = 0) -> DataFrame: ...
    def search(self, query: str, limit: int = 10, threshold: float = 0.0) -> DataFrame: ...
    def forget(self, id: str, as_of_ms: int = 0) -> None: ...
    def list(self, agent_id: str, limit: int = 50) -> DataFrame: ...
    def close(self) -> None: ...


class AgentStore:
    """Vector memories of agents: store, search over all of them, list by agent. Reading one counts an access."""

    SCHEMA = "owner_id string, id string, content string, embedding array<double>, importance double, metadata string, ts_ms long"

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.data, self.embedder = spark, Store(spark, path), embedder or hash_embedder()
        self.session_start_ms: int | None = None

    def init(self) -> None:
        """Nothing to prepare: tables come to be as they are written."""

    def close(self) -> None:
        self.data = Store(self.spark, self.data.path)

    def wake(self, as_of_ms: int) -> None:
        """An agent's session starts."""
        self.init()
        self.session_start_ms = as_of_ms

    def sleep(self, as_of_ms: int) -> int | None:
        """The session ends: its length in milliseconds, or None without one."""
        start, self.session_start_ms = self.session_start_ms, None
        self.close()
        return None if start is None else as_of_ms - start

    def store_many(self, rows: DataFrame) -> DataFrame:
        """Append rows (owner_id, content, ts_ms and, if there, importance, metadata)."""
        new = self.embedder(rows).withColumn("id", S.short_hash(F.col("owner_id"), F.col("content"), F.col("ts_ms")))
        new = self.spark.createDataFrame([], self.SCHEMA).unionByName(new, allowMissingColumns=True).withColumn("importance", F.coalesce("importance", F.lit(0.5)))
        self.data.append("agent_memories", new)
        return new

    def store(self, agent_id: str, content: str, importance: float = 0.5, metadata: str | None = None, as_of_ms: int = 0) -> DataFrame:
        return self.store_many(self.spark.createDataFrame([(agent_id, content, as_of_ms, importance, metadata)], "owner_id string, content string, ts_ms long, importance double, metadata string"))

    def _marks(self) -> DataFrame:
        return self.data.read("agent_marks", "id string, kind string, at_ms long")

    def all(self) -> DataFrame:
        marks = self._marks().groupBy("id").agg(F.count_if(F.col("kind") == "forget").alias("gone"), F.count_if(F.col("kind") == "get").alias("access_count"), F.max(F.when(F.col("kind") == "get", F.col("at_ms"))).alias("accessed_ms"))
        rows = self.data.read("agent_memories", self.SCHEMA).join(marks, "id", "left").where("coalesce(gone, 0) = 0").drop("gone")
        return rows.withColumns({"access_count": F.coalesce("access_count", F.lit(0)), "accessed_ms": F.coalesce("accessed_ms", "ts_ms")})

    def _mark(self, id: str, kind: str, at_ms: int) -> None:
        self.data.append("agent_marks", self.spark.createDataFrame([(id, kind, at_ms)], "id string, kind string, at_ms long"))

    def search(self, query: str, limit: int = 10, threshold: float = 0.0, metadata: dict[str, str] | None = None) -> DataFrame:
        """The best rows of all agents. ``metadata``: an extension, values that fields of a row's metadata must have."""
        asked = self.embedder(self.spark.createDataFrame([(query,)], "content string")).select(F.col("embedding").alias("query_vector"))
        return recall.vector_search(recall.with_metadata(self.all(), metadata or {}), asked, limit, threshold)

    def get(self, id: str, as_of_ms: int = 0) -> DataFrame:
        self._mark(id, "get", as_of_ms)
        return self.all().where(F.col("id") == id)

    def forget(self, id: str, as_of_ms: int = 0) -> None:
        self._mark(id, "forget", as_of_ms)

    def list(self, agent_id: str, limit: int = 50) -> DataFrame:
        return recall.newest(self.all().where(F.col("owner_id") == agent_id), limit)
