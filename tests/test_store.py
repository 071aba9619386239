"""The verbs of the store and of the agents' store."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memlake import schema as S
from memlake.api import AgentStore, MemoryLake
from memlake.operators import belief, lifecycle, recall, stats


@pytest.fixture
def lake(spark, tmp_path):
    return MemoryLake(spark, str(tmp_path / "lake"))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_remember_and_belief(lake):
    new = lake.remember("s1", "User prefers TypeScript", as_of_ms=10).first()
    assert (new.certainty, new.status, new.tier, new.reinforcement_count) == (0.5, "active", "working", 0)
    assert rows(lake.reinforce(new.id, as_of_ms=20), "certainty", "reinforcement_count") == [(0.65, 1)]
    assert rows(lake.reinforce(new.id, 0.3, as_of_ms=30), "reinforcement_count") == [(2,)]
    lake.set_importance(new.id, 7.0, as_of_ms=31)
    assert rows(lake.memories(), "importance") == [(1.0,)]
    later = lake.contradict("s1", new.id, "User prefers Rust", as_of_ms=40).first()
    assert later.metadata == f'{{"contradicts":["{new.id}"]}}'
    assert rows(lake.recall("s1"), "id") == [(later.id,)]
    assert [r.event for r in lake.timeline("s1").orderBy("position").collect()] == ["created", "contradicted", "reinforced", "created"]
    lake.invalidate(later.id, as_of_ms=50)
    assert rows(lake.recall("s1"), "id") == []
    assert rows(lake.timeline("nobody"), "event") == []
    with pytest.raises(ValueError):
        lake.remember("s1", "x", role="robot")


def test_operations_start_from_the_row_and_keep_their_order(spark, lake):
    """Calls at one time apply in the order of the calls; what they don't touch stays."""
    row = [("s1", "a fact", "user", 5)]
    new = S.remembered(spark.createDataFrame(row, "owner_id string, content string, role string, ts_ms long"), "session")
    lake.store.append("memories", new.withColumn("importance", F.lit(1.0)))
    id = new.first().id
    for _ in range(4):
        lake.reinforce(id, as_of_ms=9)
    lake.apply(lake._ids(id), "contradict", belief.DROP, 9)
    assert rows(lake.memories(), "certainty", "importance", "reinforcement_count", "status") == [(0.75, 1.0, 4, "contradicted")]
    other = lake.remember("s1", "again").first(), lake.remember("s1", "again").first()
    assert other[0].id != other[1].id and other[0].ts_ms < other[1].ts_ms


def test_contradict_with_blank_content_only_marks(lake):
    new = lake.remember("s1", "likes tea", as_of_ms=1).first()
    assert lake.contradict("s1", new.id, "  ", as_of_ms=2) is None
    assert rows(lake.memories(), "status", "certainty") == [("contradicted", 0.25)]


def test_forget_and_stats(lake):
    for k in range(4):
        lake.remember("s1", f"note number {k}", as_of_ms=k)
    assert lake.forget("s1", before=2, as_of_ms=9) == 2
    assert lake.stats("s1").first().total == 2
    assert [r.content for r in lake.history("s1").orderBy("position").collect()] == ["note number 2", "note number 3"]
    assert lake.forget("s2") == 0


def test_user_memories_blend(lake):
    lake.remember_user("ann", "likes green tea", as_of_ms=1)
    lake.remember_user("bob", "likes coffee", as_of_ms=2)
    lake.remember("s1", "we talked about tea", as_of_ms=3)
    found = lake.recall("s1", user_id="ann").orderBy("position").collect()
    assert [(r.content, r.user_memory) for r in found] == [("we talked about tea", False), ("likes green tea", True)]
    assert lake.user_stats("ann").first().total == 1
    assert lake.wake_briefing("ann") == "Briefing (1 items):\n- likes green tea"
    assert lake.wake_briefing("nobody") == ""


def test_consolidate(lake):
    for k in range(6):
        lake.remember("s1", f"fact {k}", as_of_ms=k)
    dry = lake.consolidate("s1", 3, 2, dry_run=True).first()
    assert (dry.summarized, dry.created, dry.archived, len(dry.previews)) == (3, 0, 0, 1)
    done = lake.consolidate("s1", 3, 2, as_of_ms=100).first()
    assert (done.summarized, done.created, done.archived) == (3, 1, 3)
    made = lake.memories().where("tier = 'long_term'").first()
    assert len(made.embedding) == 64 and len(made.content_hash) == 16 and made.consolidated_from and made.role == "system"
    assert lake.recall("s1", "fact", 10).where("tier = 'long_term'").first().similarity > 0.3
    tiers = {r.tier: r.n for r in stats.by_tier(lake.memories()).collect()}
    assert tiers == {"working": 3, "archived": 3, "long_term": 1}
    assert lake.handle_sleep("s1", "nobody") == []


def test_graph(spark, lake):
    lake.relate(spark.createDataFrame([("s1", " Ann ", "Knows", "Bob", 0.9, "m1", 1), ("s1", "ann", "knows", "bob", 0.9, "m2", 2), ("s1", "", "x", "y", 0.9, "m3", 3)], "session_id string, from_entity string, relation string, to_entity string, confidence double, memory_id string, seq long"))
    links, _ = lake.graph("s1", " BOB ")
    assert rows(links, "type", "relation", "target", "memory_id") == [("incoming", "knows", "ann", "m2")]


def test_detects_contradiction(lake):
    lake.remember("s1", "User prefers TypeScript", as_of_ms=1)
    hit = lake.detect_contradictions("s1", "User doesn't prefer TypeScript anymore").collect()
    assert [r.similarity for r in hit] == [0.4]
    assert lake.detect_contradictions("s2", "User doesn't prefer TypeScript anymore").isEmpty()


def test_reflect(lake):
    lake.remember("s1", "alpha beta", as_of_ms=1)
    insights, used = lake.reflect("s1", "alpha")
    assert insights.first().insights == ["alpha beta"] and used.count() == 1


def test_model_replies(spark, tmp_path):
    said = {"importance": "0.91", "facts": 'so: [{"from":"Ann","relation":"Likes","to":"Tea"},{"from":"","relation":"x","to":"y"}]'}
    reply = lambda rows: rows.withColumn("reply", F.when(F.col("prompt").startswith("Rate"), said["importance"]).otherwise(said["facts"]))
    lake = MemoryLake(spark, str(tmp_path / "m"), S.Config(importance_scoring=True, graph_memory=True), generator=reply)
    assert lake.remember("s1", "hello there", as_of_ms=1).first().importance == 0.91
    assert rows(lake.graph("s1", "ann")[0], "relation", "target") == [("likes", "tea")]


def test_fold_equals_replay(spark):
    ops = [("reinforce", None), ("contradict", None), ("reinforce", 0.9), ("contradict", None), ("invalidate", None), ("reinforce", None)]
    df = spark.createDataFrame([("o", "m", op, amount, k, k) for k, (op, amount) in enumerate(ops)], S.OPERATIONS)
    certainty = 0.5
    for op, amount in ops:
        certainty = min(1.0, certainty + (amount or 0.15)) if op == "reinforce" else max(0.0, certainty - 0.25) if op == "contradict" else certainty
    got = belief.fold(df.repartition(3)).first()
    assert (got.certainty, got.reinforcement_count, got.status) == (certainty, 3, "superseded")


def test_full_scan_reaches_old_rows(spark):
    data = [("s", f"{k:02d}", "needle here" if k == 0 else "hay", "user", k, "working", "active", 0.5, 0.5) for k in range(40)]
    mem = spark.createDataFrame(data, "owner_id string, id string, content string, role string, ts_ms long, tier string, status string, importance double, certainty double")
    near = {r.id for r in recall.recall(mem, "needle", 3).collect()}
    far = {r.id for r in recall.recall(mem, "needle", 3, full_scan=True).collect()}
    assert "00" not in near and "00" in far


def test_percentiles_are_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [5, 1, 9, 9, 2]], "g string, v double")
    got = stats.percentiles(df, "v", "g").first()
    assert (got.n, got.p50, got.p95, got.p99, got.least, got.largest) == (5, 5.0, 9.0, 9.0, 1.0, 9.0)


def test_percentiles_over_ranges_are_exact(spark):
    import random

    rng = random.Random(4)
    data = [("a", rng.gauss(0, 1)) for _ in range(700)] + [("a", 0.5)] * 300 + [(None, float(k % 7)) for k in range(200)] + [("one", 3.0), ("none", None)]
    got = {r.g: r for r in stats.percentiles(spark.createDataFrame(data, "g string, v double"), "v", "g", cells=8).collect()}
    assert set(got) == {"a", None, "one"}
    for g, r in got.items():
        own = sorted(v for k, v in data if k == g and v is not None)
        at = lambda q: own[min(int(len(own) * q), len(own) - 1)]
        assert (r.n, r.p50, r.p95, r.p99, r.least, r.largest) == (len(own), at(0.5), at(0.95), at(0.99), own[0], own[-1])
    plain = stats.percentiles(spark.createDataFrame(data, "g string, v double"), "v").first()
    assert plain.n == 1201


def test_consolidation_limits_before_it_counts(spark):
    mem = spark.createDataFrame([("s", str(k), k, "working", 0.5) for k in range(15)], "owner_id string, id string, ts_ms long, tier string, importance double")
    found = lifecycle.consolidation_candidates(mem, 4, 3)
    assert {r.id for r in found.collect()} == {"0", "1", "2", "3"}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_important_rows_are_kept(spark):
    mem = spark.createDataFrame([("s", str(k), k, "working", 0.9 if k < 3 else 0.5) for k in range(15)], "owner_id string, id string, ts_ms long, tier string, importance double")
    assert {r.id for r in lifecycle.consolidation_candidates(mem, 15, 0).collect()} == {str(k) for k in range(3, 15)}


def test_agents(spark, tmp_path):
    agents = AgentStore(spark, str(tmp_path / "agents"))
    a = agents.store("x", "red green blue", as_of_ms=1).first()
    agents.store("y", "one two three", as_of_ms=2)
    assert agents.search("red green blue", 1).first().id == a.id
    assert agents.get(a.id, 5).first().access_count == 1
    assert [r.owner_id for r in agents.list("y").collect()] == ["y"]
    agents.store("y", "one two three four", metadata='{"lang": "en", "n": 3}', as_of_ms=3)
    assert [r.content for r in agents.search("one two three", 5, metadata={"lang": "en"}).collect()] == ["one two three four"]
    agents.wake(100)
    assert agents.sleep(160) == 60 and agents.sleep(170) is None
    agents.forget(a.id)
    assert agents.get(a.id).isEmpty()


def test_missing_columns_get_defaults(spark):
    row = S.with_defaults(spark.createDataFrame([("session", "s", "i", "c", 5)], "scope string, owner_id string, id string, content string, ts_ms long")).first()
    assert (row.importance, row.certainty, row.tier, row.status, row.last_verified_ms, row.memory_type) == (0.5, 0.5, "working", "active", 5, "episodic")


def test_stream_equals_batch(spark):
    from memlake.sources import tables
    from memlake.streaming import ingest

    d = "/root/testdata/sf0.001"
    batch = belief.fold(tables.operations(spark, d)).select("owner_id", "certainty", "reinforcement_count")
    assert sorted(map(tuple, ingest.replay(spark, d).collect())) == sorted(map(tuple, batch.collect()))
