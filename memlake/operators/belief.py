"""Belief: an append-only log of operations folded, in order, into each memory's present state.

Clamping makes the order matter, so state is a fold over the sorted operations of a memory. A memory's
operations are pre-packed by a grouped aggregation; nothing is updated in place. A fold starts from the
memory's own row, so what no operation touches stays as it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators.recall import newest
from memlake.providers import Generator, parsed_conflicts, unfenced

BOOST, DROP = 0.15, 0.25
#: What operations change.
STATE = ("certainty", "reinforcement_count", "status", "importance", "last_verified_ms", "tier")
OPERATION = ("op_ms", "seq", "op", "amount")


def _step(state: Column, x: Column) -> Column:
    op, amount = x["op"], x["amount"]
    raised = F.least(F.lit(1.0), state["certainty"] + F.coalesce(amount, F.lit(BOOST)))
    lowered = F.greatest(F.lit(0.0), state["certainty"] - F.coalesce(amount, F.lit(DROP)))
    return F.struct(
        F.when(op == "reinforce", raised).when(op == "contradict", lowered).otherwise(state["certainty"]).alias("certainty"),
        (state["reinforcement_count"] + (op == "reinforce").cast("long")).alias("reinforcement_count"),
        F.when(op == "contradict", "contradicted").when(op == "invalidate", "superseded").otherwise(state["status"]).alias("status"),
        F.when(op == "importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), amount))).otherwise(state["importance"]).alias("importance"),
        F.when(op.isin("reinforce", "contradict", "invalidate"), x["op_ms"]).otherwise(state["last_verified_ms"]).alias("last_verified_ms"),
        F.when(op == "archive", "archived").otherwise(state["tier"]).alias("tier"),
        (state["deleted"] | (op == "delete")).alias("deleted"),
    )


def _packed(operations: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The operations of each (owner_id, memory_id), sorted."""
    row = F.struct(*order, *[c for c in OPERATION if c not in order])
    return operations.groupBy("owner_id", "memory_id").agg(F.array_sort(F.collect_list(row)).alias("ops"))


def fold(operations: DataFrame, order: tuple[str, ...] = ("op_ms", "seq")) -> DataFrame:
    """State of each (owner_id, memory_id), from that of a new memory, after its operations."""
    fresh = {"certainty": F.lit(0.5), "reinforcement_count": F.lit(0).cast("long"), "status": F.lit("active"), "importance": F.lit(0.5)}
    fresh |= {"last_verified_ms": F.lit(None).cast("long"), "tier": F.lit("working"), "deleted": F.lit(False)}
    zero = F.struct(*[x.alias(c) for c, x in fresh.items()])
    return _packed(operations, order).select("owner_id", "memory_id", F.aggregate("ops", zero, _step).alias("state")).select("owner_id", "memory_id", "state.*")


def current(memories: DataFrame, operations: DataFrame, order: tuple[str, ...] = ("seq", "op_ms")) -> DataFrame:
    """Memories with their operations applied to their rows, in the order of calls; deleted ones go."""
    packed = _packed(operations, order).withColumnRenamed("memory_id", "id")
    start = F.struct(*STATE, F.lit(False).alias("deleted"))
    state = F.when(F.col("ops").isNull(), start).otherwise(F.aggregate("ops", start, _step))
    both = memories.join(packed, ["owner_id", "id"], "left").withColumn("_state", state).where("NOT _state.deleted")
    return both.withColumns({c: F.col(f"_state.{c}") for c in STATE}).select(*memories.columns)


def find_contradictions(statements: DataFrame, memories: DataFrame, limit: int = 20) -> DataFrame:
    """Conflicts of new statements (owner_id, statement_id, statement) with their owner's newest active,
    unarchived memories."""
    recent = newest(memories.where("status = 'active' AND tier <> 'archived'"), limit).select("owner_id", F.col("id").alias("memory_id"), "content", "certainty", T.tokens(F.col("content")).alias("old"))
    both = statements.withColumn("new", T.tokens(F.col("statement"))).join(recent, "owner_id")
    hits = both.where(T.contradicts(F.col("statement"), F.col("content"), F.col("new"), F.col("old")))
    return hits.select("owner_id", "statement_id", "memory_id", "content", "certainty", T.overlap(F.col("new"), F.col("old")).alias("similarity"))


def contradictions_by_model(statements: DataFrame, memories: DataFrame, generator: Generator, limit: int = 20) -> DataFrame:
    """Conflicts as a model sees them, which gets each owner's newest rows as a numbered list; similarity 0.8. Where
    it gives no reply, or one that can't be read, the heuristic decides."""
    recent = newest(memories.where("status = 'active' AND tier <> 'archived'"), limit)
    packed = recent.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("id").alias("memory_id"), "content", "certainty"))).alias("rows"))
    task = F.lit('Which memories does the statement contradict? Reply {"contradictions": [{"index": N}]}.\n')
    prompt = F.concat(task, F.col("statement"), F.lit("\n"), F.to_json(F.transform("rows", lambda r: r["content"])))
    asked = generator(statements.join(packed, "owner_id").withColumn("prompt", prompt))
    asked = asked.withColumn("numbers", parsed_conflicts(unfenced(F.col("reply"))))
    hits = asked.select("owner_id", "statement_id", F.explode(F.array_distinct("numbers")).alias("k"), "rows").withColumn("r", F.get("rows", F.col("k") - 1))
    found = hits.where("r IS NOT NULL").select("owner_id", "statement_id", "r.memory_id", "r.content", "r.certainty", F.lit(0.8).alias("similarity"))
    silent = asked.where("numbers IS NULL").select(*statements.columns)
    return found.unionByName(find_contradictions(silent, memories, limit))


def forget(memories: DataFrame, before: int | None = None, id: str | None = None, include_long_term: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that go. An id goes whatever its tier; else working and long-term rows
    (archived ones only with ``include_long_term``) before a time, or all of them."""
    tiers = ["working", "long_term"] + ["archived"] * include_long_term
    gone = F.col("id") == id if id is not None else F.col("tier").isin(*tiers) & (F.lit(True) if before is None else F.col("ts_ms") < before)
    gone = F.coalesce(gone, F.lit(False))
    return memories.where(~gone), memories.where(gone)


def timeline(memories: DataFrame, limit: int = 50) -> DataFrame:
    """Events of each owner's oldest rows: creation, a status change one millisecond later, reinforcement."""
    old = memories.withColumn("n", F.row_number().over(Window.partitionBy("owner_id").orderBy("ts_ms", "id"))).where(F.col("n") <= limit)
    event = lambda ms, name, k, importance: F.struct(ms.cast("long").alias("event_ms"), name.alias("event"), F.lit(k).alias("part"), importance.alias("importance"))
    none = F.lit(None).cast("double")
    made = event(F.col("ts_ms"), F.when(F.col("tier") == "long_term", "consolidated").otherwise("created"), 0, F.col("importance"))
    status = F.when(F.col("status").isin("contradicted", "superseded"), event(F.col("ts_ms") + 1, F.col("status"), 1, none))
    again = F.when(F.col("reinforcement_count") > 0, event(F.coalesce("last_verified_ms", "ts_ms"), F.lit("reinforced"), 2, none))
    rows = old.select("owner_id", F.col("id").alias("memory_id"), "content", "certainty", "n", F.explode(F.filter(F.array(made, status, again), lambda e: e.isNotNull())).alias("e"))
    rows = rows.select("owner_id", "memory_id", "content", "certainty", "n", "e.*")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("owner_id").orderBy("event_ms", "n", "part"))).drop("n", "part")
