"""Registered queries of the store's verbs, of model replies and of evaluation runs; their SQL is in ``verbs_sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake import schema as S
from memlake.api import AgentStore, MemoryLake
from memlake.functions import text as T
from memlake.operators import belief, claims, evaluate, graph, lifecycle, recall, stats
from memlake.plans.queries import QUERY, Query
from memlake.providers import EXTRACTION_RULES, Generator, extract_claims, first_sentences, hash_embedder, model_summariser, no_reply, parsed_strings, parsed_triples
from memlake.sources import synthetic, tables
from memlake.sources.store import scratch

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def replying(reply: Column) -> Generator:
    """A model that gives each row a reply by rule."""
    return lambda rows: rows.withColumn("reply", reply)


# writing


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.session_memories(spark, d).select("id", "owner_id", "ts_ms", "role")
    said = tables.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("owner_id"), (tables.EPOCH_MS + F.col("conv_id") * 1_000_000 + F.col("turn") * 1000).alias("ts_ms"), F.col("text").alias("content"))
    return rows.drop("id").join(said, ["owner_id", "ts_ms"])


@query
def remember_rows(spark, d):
    new = S.remembered(_turns(spark, d), "session", S.Config(importance_scoring=True, max_context_length=300))
    return new.select("scope", "owner_id", "id", "content", "content_hash", "importance", "certainty", "tier", "status", "memory_type", "last_verified_ms")


@query
def remember_user_rows(spark, d):
    rows = tables.table(spark, d, "documents").select(F.col("source").alias("owner_id"), F.col("text").alias("content"), F.lit("user").alias("role"), (tables.EPOCH_MS + F.col("doc_id") * 1000).alias("ts_ms"))
    new = S.remembered(rows, "user")
    return new.select("owner_id", "id", F.length("content").cast("long").alias("stored"), "content_hash", "importance", "scope")


@query
def row_defaults(spark, d):
    """Rows as an older table has them: fields missing or null."""
    rows = tables.session_memories(spark, d).select("owner_id", "id", "content", "ts_ms", F.when(F.col("importance") > 0.4, F.col("importance")).alias("importance"), F.when(F.col("role") == "user", F.col("status")).alias("status"))
    full = S.with_defaults(rows)
    return full.select("id", "importance", "certainty", "reinforcement_count", "last_verified_ms", "tier", "memory_type", "status")


def lake_of(spark: SparkSession, d: str, **config) -> MemoryLake:
    """A store with the conversations as session memories, in the state that the table gives them."""
    lake = MemoryLake(spark, scratch(spark, "lake"), S.Config(**config))
    lake.store.append("memories", S.with_defaults(tables.session_memories(spark, d).drop("vec_id").withColumn("scope", F.lit("session"))))
    return lake


@query
def store_roundtrip(spark, d):
    lake = lake_of(spark, d)
    lake.close()
    return lake.memories().select("id", "owner_id", "content", "tier", "status", "importance", "certainty")


@query
def owner_rows(spark, d):
    return lake_of(spark, d).memories(owner="3").select("id", "tier", "status")


def _state(lake: MemoryLake) -> DataFrame:
    return lake.memories().select("id", "certainty", "importance", "reinforcement_count", "status", "last_verified_ms")


@query
def api_reinforce(spark, d):
    lake = lake_of(spark, d)
    for ms in (5, 5, 5):
        lake.apply(lake.memories(), "reinforce", belief.BOOST, ms)
    return _state(lake)


@query
def api_contradict(spark, d):
    """Three boosts reach the upper bound; what follows shows their order, though all have one time."""
    lake = lake_of(spark, d)
    for op, amount in (("reinforce", 0.15), ("reinforce", 0.9), ("contradict", belief.DROP), ("reinforce", 0.15), ("contradict", belief.DROP)):
        lake.apply(lake.memories(), op, amount, 9, "session")
    return _state(lake)


@query
def api_set_importance(spark, d):
    lake = lake_of(spark, d)
    for amount in (1.7, -0.5, 0.35):
        lake.apply(lake.memories(), "importance", amount, 3)
    return _state(lake)


@query
def api_invalidate(spark, d):
    lake = lake_of(spark, d)
    lake.apply(lake.memories().where("role = 'user'"), "invalidate", None, 77)
    return _state(lake)


@query
def api_forget(spark, d):
    """The oldest session's unarchived rows go, by the verb."""
    lake = lake_of(spark, d)
    lake.forget("1", as_of_ms=4)
    return lake.memories().select("id", "owner_id", "tier")


@query
def forget_user(spark, d):
    kept, gone = belief.forget(tables.user_memories(spark, d), before=tables.EPOCH_MS + 400_000, include_long_term=True)
    return kept.select("id", F.lit(False).alias("gone")).unionByName(gone.select("id", F.lit(True).alias("gone")))


@query
def both_tables_by_id(spark, d):
    session = tables.session_memories(spark, d).select("id", "certainty")
    return session.unionByName(tables.user_memories(spark, d).select("id", "certainty")).distinct()


def _consolidated(memories: DataFrame, summariser, batch: int, keep: int) -> DataFrame:
    after, _ = lifecycle.consolidate(memories, summariser, tables.EPOCH_MS, batch, keep, embedder=hash_embedder(), max_content=120)
    new = after.where("consolidated_from IS NOT NULL")
    return new.select("owner_id", "id", "content", "content_hash", "tier", F.size("embedding").alias("dimensions"), F.size("consolidated_from").alias("sources"))


@query
def consolidate_rows(spark, d):
    return _consolidated(tables.session_memories(spark, d), first_sentences, 3, 2)


@query
def consolidate_user_rows(spark, d):
    return _consolidated(tables.user_memories(spark, d), first_sentences, 5, 3)


@query
def consolidate_by_model(spark, d):
    summariser = model_summariser(replying(F.lit('Here: ["first fact", " ", "second fact"]')))
    return _consolidated(tables.session_memories(spark, d), summariser, 3, 2).select("owner_id", "content", "content_hash", "sources")


# replies of models


@query
def importance_by_model(spark, d):
    rows = tables.session_memories(spark, d).withColumn("k", F.length("content") % 6)
    said = ["0.87 or so", "1.0", "1", " .25", "7.5!", "no number"]
    reply = F.get(F.array(*map(F.lit, said)), F.col("k").cast("int"))
    return rows.select("id", T.parsed_importance(reply, T.importance(F.col("content"))).alias("importance"))


@query
def contradictions_by_model(spark, d):
    said = tables.session_memories(spark, d).select("owner_id").distinct().withColumns({"statement_id": F.lit("new"), "statement": F.lit("it isn't so")})
    reply = F.lit('<think>two</think> {"contradictions": [{"index": 1}, {"index": 3}, {"index": 99}]}')
    found = belief.contradictions_by_model(said, tables.session_memories(spark, d), replying(reply))
    return found.select("owner_id", "memory_id", "similarity", "certainty")


@query
def triples_by_model(spark, d):
    start = F.concat(F.lit('facts: [{"from": " '), "role", F.lit(' ", "relation": "Speaks", "to": "Turn '), F.col("ts_ms").cast("string"))
    reply = F.concat(start, F.lit('"}, {"from": "", "relation": "x", "to": "y"}]'))
    rows = tables.session_memories(spark, d).select(F.col("owner_id").alias("session_id"), F.col("id").alias("memory_id"), F.col("ts_ms").alias("seq"), F.posexplode(parsed_triples(reply)).alias("pos", "t"))
    return graph.upsert_edges(rows.select("session_id", "t.*", "memory_id", "seq", "pos")).select("session_id", "id", "from_entity", "relation", "to_entity", "memory_id")


@query
def strings_of_replies(spark, d):
    reply = F.concat(F.lit('so ["'), "owner_id", F.lit('", "  ", "'), "role", F.lit('"] it is'))
    return tables.session_memories(spark, d).select("id", F.array_join(parsed_strings(reply), "/").alias("strings"))


@query
def reflect_insights(spark, d):
    rows = recall.reflect_order(recall.recall(tables.session_memories(spark, d), QUERY, 4))
    found = lifecycle.insights(rows, QUERY, no_reply)
    return found.select("owner_id", F.array_join("insights", "\n").alias("insights"))


@query
def extract_by_model(spark, d):
    """One claim a window, by a model that reads the prompt's anchor time and first turn."""
    assert EXTRACTION_RULES
    turns = tables.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("window_id"), "turn", "role", F.lit("hello").alias("content"))
    first = F.get_json_object("prompt", "$.turns[0].role")
    anchor = F.get_json_object("prompt", "$.anchor_conversation_time")
    claim = F.concat(F.lit('```json\n{"entities": [{"id": "e1", "name": "speaker"}], "claims": [{"id": "c1", "canonical_text": "The '), first, F.lit(" spoke first at "), anchor, F.lit('", "subject_entity_id": "e1", "predicate": "spoke", "object_text": "first", "explicitness": "stated", "extraction_confidence": 0.9}]}\n```'))
    found, entities = extract_claims(turns, replying(claim), "2024-05-01T00:00:00Z")
    return claims.validate(found, entities).select("window_id", "id", "canonical_text", "reason")


@query
def embedded_rows(spark, d):
    rows = hash_embedder()(tables.session_memories(spark, d).select("id", "content"))
    size = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 9)
    return rows.select("id", F.size("embedding").alias("dimensions"), size.alias("size"))


# claims of whole tables


def table_claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim a turn: its whole text, its first words as subject and predicate, the third to sixth as object."""
    t = F.col("turn")
    words = F.split("text", " ", -1)
    rows = tables.table(spark, d, "conversations").withColumn("w", words)
    word = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(""))
    text = F.when(t % 9 == 4, F.substring("text", 1, 8)).when(t % 5 == 3, F.concat(word(0), F.lit(" said this and "), word(1))).otherwise(F.col("text"))
    full = rows.select(
        F.col("conv_id").cast("string").alias("window_id"), t.cast("int").alias("pos"), F.concat(F.lit("c"), t.cast("string")).alias("id"), text.alias("canonical_text"),
        F.when(t % 4 == 3, "nobody").otherwise(F.concat(F.lit("e"), (t % 4).cast("string"))).alias("subject_entity_id"), F.when(t % 7 == 5, "They").otherwise(word(0)).alias("subject_text"),
        word(1).alias("predicate"), F.when(t % 8 == 6, "something").otherwise(F.array_join(F.slice("w", 3, 4), " ")).alias("object_text"),
        F.when(t % 2 == 1, "e1").alias("object_entity_id"), F.when(t % 3 == 0, "stated").when(t % 3 == 1, "implied").otherwise("inferred").alias("explicitness"),
        ((t % 10).cast("double") / 10).alias("extraction_confidence"),
        F.struct(F.when(t % 6 == 2, "2024-02-01").alias("normalized_start"), F.when(t % 6 == 2, "2024-01-01").alias("normalized_end"), F.lit(None).cast("string").alias("relation_type"), F.lit(None).cast("string").alias("relation_to_event")).alias("temporal"),
    )
    return spark.createDataFrame([], S.CLAIMS).drop("temporal").unionByName(full, allowMissingColumns=True)


def table_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("window_id")).distinct()
    return rows.select("window_id", F.explode(F.array(*[F.lit(f"e{k}") for k in range(3)])).alias("id"))


@query
def table_claims_validated(spark, d):
    found = claims.validate(table_claims(spark, d), table_entities(spark, d))
    return found.select("window_id", "id", "canonical_text", "reason")


@query
def table_claims_known(spark, d):
    """All claims of assistants' turns are known from before."""
    rows = claims.start(table_claims(spark, d))
    known = rows.where("pos % 2 = 1").select(claims.claim_hash().alias("hash"))
    return claims.duplicates(rows, known).select("window_id", "id", "reason")


@query
def eval_claim_index(spark, d):
    return evaluate.claim_index(claims.validate(table_claims(spark, d), table_entities(spark, d)))


# evaluation runs


def _signals(spark: SparkSession, n: int = 100) -> DataFrame:
    k = F.col("id").cast("string")
    return spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("code"), k, F.lit("x")).alias("term"), F.concat(F.lit("the secret of Code"), k, F.lit("x is "), (F.col("id") * 37).cast("string")).alias("content"))


@query
def eval_noise(spark, d):
    signals = _signals(spark)
    noise = tables.table(spark, d, "conversations").select(F.col("text").alias("content"))
    expected = signals.select("query_id", (F.col("query_id") * 37).cast("string").alias("expected"))
    return evaluate.top1_contains(evaluate.noise_test(signals, noise), expected)


@query
def eval_noise_words(spark, d):
    """Questions for common stretches of words: the best turn of each."""
    asked = spark.createDataFrame([(k, t, "") for k, t in enumerate(["tion", "the", "and", "que", "ing"])], "query_id long, term string, content string")
    noise = tables.table(spark, d, "conversations").select(F.col("text").alias("content"))
    return evaluate.noise_test(asked, noise).select("query_id", "content")


@query
def eval_retention(spark, d):
    """Signals aged by 30, 60 and 90 days among all turns; every third has a newer row that contradicts it."""
    days = F.explode(F.array(*[F.lit(n).cast("long") for n in (30, 60, 90)])).alias("days")
    signals = _signals(spark, 60).select("*", days)
    owner = F.concat(F.lit("aged"), F.col("days").cast("string"))
    old = signals.select(owner.alias("owner_id"), "content", (tables.EPOCH_MS - F.col("days").cast("long") * synthetic.DAY_MS).alias("ts_ms"), F.concat(F.lit("s"), F.col("query_id").cast("string")).alias("id"))
    newer = signals.where("query_id % 3 = 0").select(owner.alias("owner_id"), F.concat(F.col("term"), F.lit(" is nothing")).alias("content"), F.lit(tables.EPOCH_MS).alias("ts_ms"), F.concat(F.lit("n"), F.col("query_id").cast("string")).alias("id"))
    noise = tables.session_memories(spark, d).select("owner_id", "content", "ts_ms", "id")
    asked = signals.select(owner.alias("owner_id"), F.col("query_id").alias("question_id"), "days", "term", (F.col("query_id") * 37).cast("string").alias("expected"))
    results = evaluate.retention(old.unionByName(newer).unionByName(noise), asked)
    return stats.accuracy(results, "correct", "days")


@query
def eval_model_judge(spark, d):
    """Answers that don't match exactly go to a judge who likes texts of even length."""
    answers = tables.session_memories(spark, d).select("id", F.col("content").alias("answer"), F.lit("the").alias("expected"))
    judge = replying(F.when(F.length("answer") % 2 == 0, " Yes.").when(F.length("answer") % 5 == 0, F.lit(None).cast("string")).otherwise("no"))
    return evaluate.judged(answers, judge).select("id", "correct")


@query
def eval_report_files(spark, d):
    """The written report, read back."""
    path = scratch(spark, "report")
    results = tables.session_memories(spark, d).select(F.col("role").alias("mode"), (F.length("content") % 3 == 0).alias("correct"))
    evaluate.write_report(results, path)
    return spark.read.schema("mode string, total long, score double").json(f"{path}/json")


@query
def throughput_by_type(spark, d):
    span = (F.unix_millis(F.max(F.col("ts").cast("timestamp"))) - F.unix_millis(F.min(F.col("ts").cast("timestamp")))) / 1000.0
    runs = tables.table(spark, d, "events").groupBy("event_type").agg((F.count("*") * 1000).alias("stored"), span.alias("seconds"))
    return stats.throughput(runs, "stored", "seconds").select("event_type", "stored", "per_second")


@query
def synthetic_stacks(spark, d):
    made = synthetic.stacks(spark, 600)
    return made.select("stack_id", "category", "question", "expected", F.size("sessions").alias("sessions"))


@query
def question_set(spark, d):
    return synthetic.question_set(spark)


# agents and filters


@query
def agent_accesses(spark, d):
    rows = tables.agent_memories(spark, d).drop("id", "vec_id").withColumn("content", F.col("ts_ms").cast("string"))
    agents = AgentStore(spark, scratch(spark, "agents"), lambda x: x)
    agents.wake(1)
    agents.store_many(rows)
    seen = agents.data.read("agent_memories", AgentStore.SCHEMA).where("owner_id = '1'").agg(F.min("id")).first()[0]
    for ms in (50, 40):
        agents.get(seen, tables.EPOCH_MS * 2 + ms)
    agents.sleep(2)
    return agents.all().select("owner_id", "id", "importance", "access_count", "accessed_ms")


@query
def metadata_filter(spark, d):
    rows = tables.table(spark, d, "events").select("event_id", F.col("props").alias("metadata"))
    return recall.with_metadata(rows, {"k": "26"}).select("event_id")
