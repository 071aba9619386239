"""The registered queries of the memory operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions import vectors as V
from memlake.operators import belief, claims, evaluate, graph, lifecycle, recall, stats
from memlake.plans import fixtures
from memlake.providers import first_sentences
from memlake.sources import tables
from memlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERY = "the tion and"
USER_QUERY = "haha en_"
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _placed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("owner_id", "id", F.col("position").cast("long").alias("position"), *more)


@query
def keyword_score(spark, d):
    rows = tables.session_memories(spark, d).withColumn("words", T.words(F.col("content")))
    return rows.select("id", F.round(T.keyword_score(F.col("words"), QUERY), 12).alias("score"))  # logarithms differ in the last bit


@query
def recency_topn(spark, d):
    return _placed(recall.newest(recall.eligible(tables.session_memories(spark, d)), 3), "ts_ms")


@query
def history(spark, d):
    return _placed(recall.history(tables.session_memories(spark, d), 5), "content", "certainty", "status")


@query
def recall_keyword_recency(spark, d):
    return _placed(recall.recall(tables.session_memories(spark, d), QUERY, 3), "score")


@query
def recall_no_query(spark, d):
    return _placed(recall.recall(tables.session_memories(spark, d), "  ", 4))


@query
def importance_heuristic(spark, d):
    return tables.user_memories(spark, d).select("id", T.importance(F.col("content")).alias("importance"))


@query
def importance_cases(spark, d):
    rows = spark.createDataFrame(list(enumerate(fixtures.TEXTS)), "n int, content string")
    return rows.select(F.col("n").cast("long").alias("n"), T.importance(F.col("content")).alias("importance"))


def _with_query(spark, d, rows):
    return rows.crossJoin(F.broadcast(tables.query_vector(spark, d)))


@query
def cosine_topk(spark, d):
    scored = _with_query(spark, d, tables.embeddings(spark, d)).select("vec_id", V.cosine(F.col("query_vector"), F.col("embedding")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query
def euclidean_topk(spark, d):
    scored = _with_query(spark, d, tables.embeddings(spark, d)).select("vec_id", V.euclidean(F.col("query_vector"), F.col("embedding")).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(10)


@query
def vector_threshold_search(spark, d):
    found = recall.vector_search(tables.agent_memories(spark, d), tables.query_vector(spark, d), 25, 0.1)
    return found.select("owner_id", "vec_id", "score")


@query
def agent_list(spark, d):
    return _placed(recall.newest(tables.agent_memories(spark, d), 5))


@query
def semantic_rank_blend(spark, d):
    rows = _with_query(spark, d, tables.session_memories(spark, d, vectors=True))
    similarity = F.coalesce(V.cosine(F.col("query_vector"), F.col("embedding")), F.lit(0.0))
    return rows.select("id", recall.semantic_score(similarity).alias("blend"))


@query
def recall_hybrid_rrf(spark, d):
    return _placed(recall.recall(tables.session_memories(spark, d, vectors=True), QUERY, 3, tables.query_vector(spark, d)), "score", "similarity")


@query
def recall_filtered(spark, d):
    rows = recall.recall(tables.session_memories(spark, d), QUERY, 2, tiers=("working",), role="user", after=tables.EPOCH_MS + 1000, before=tables.EPOCH_MS + 400_000_000)
    return _placed(rows, "score")


@query
def recall_user_keyword(spark, d):
    return _placed(recall.recall_user(tables.user_memories(spark, d), USER_QUERY, 4))


@query
def recall_user_vector(spark, d):
    users = tables.user_memories(spark, d).join(tables.embeddings(spark, d), F.col("doc_id") == F.col("vec_id"), "left")
    return _placed(recall.recall_user(users, "anything", 4, tables.query_vector(spark, d)), "similarity")


@query
def recall_blend_user(spark, d):
    session = recall.recall(tables.session_memories(spark, d), QUERY, 6)
    users = recall.recall_user(tables.user_memories(spark, d), USER_QUERY, 3)
    return _placed(recall.blend(session, users, tables.session_users(spark, d), 6), "user_memory")


@query
def reflect_order(spark, d):
    rows = recall.recall(tables.session_memories(spark, d, vectors=True), QUERY, 5, tables.query_vector(spark, d))
    return recall.reflect_order(rows).select("owner_id", "id", F.col("reflect_position").cast("long").alias("position"), "weight")


@query
def belief_fold(spark, d):
    return belief.fold(tables.operations(spark, d)).select("owner_id", "certainty", "reinforcement_count")


@query
def belief_status(spark, d):
    state = belief.fold(tables.operations(spark, d))
    return state.groupBy("status").agg(F.count("*").alias("n"))


@query
def timeline_events(spark, d):
    rows = belief.timeline(tables.session_memories(spark, d), 6)
    return rows.select("owner_id", "memory_id", F.col("position").cast("long").alias("position"), "event", "event_ms", "certainty", "importance")


@query
def contradiction_cases(spark, d):
    rows = spark.createDataFrame(fixtures.STATEMENTS, "id string, old string, new string").withColumns({"a": T.tokens(F.col("new")), "b": T.tokens(F.col("old"))})
    return rows.select("id", T.overlap(F.col("a"), F.col("b")).alias("similarity"), T.contradicts(F.col("new"), F.col("old"), F.col("a"), F.col("b")).alias("detected"))


@query
def contradiction_heuristic(spark, d):
    mem = tables.session_memories(spark, d)
    said = mem.where("content <> ''").groupBy("owner_id").agg(F.max_by("content", F.struct("ts_ms", "id")).alias("said")).select("owner_id", F.lit("new").alias("statement_id"), F.concat(F.lit("I don't hate that: "), F.col("said")).alias("statement"))
    found = belief.find_contradictions(said, mem)
    return found.select("owner_id", "memory_id", "similarity", "certainty")


@query
def forget_before(spark, d):
    kept, gone = belief.forget(tables.session_memories(spark, d), before=tables.EPOCH_MS + 50_003_000)
    return kept.select("id", F.lit(False).alias("gone")).unionByName(gone.select("id", F.lit(True).alias("gone")))


def _edges(spark, d):
    return graph.upsert_edges(tables.triples(spark, d))


@query
def graph_upsert_edges(spark, d):
    return _edges(spark, d).select("session_id", "id", "from_entity", "relation", "to_entity", "confidence", "memory_id")


@query
def graph_upsert_nodes(spark, d):
    return graph.upsert_nodes(tables.triples(spark, d)).select("session_id", "id", "entity", "created_ms")


def _asked(spark, d):
    return tables.triples(spark, d).select("session_id").distinct().withColumn("entity", F.lit(" Nation_3 "))


@query
def graph_lookup(spark, d):
    return graph.lookup(_edges(spark, d), _asked(spark, d)).select("session_id", "entity", "type", "relation", "target", "confidence")


@query
def graph_related_memories(spark, d):
    return graph.related_memories(_edges(spark, d), _asked(spark, d), tables.graph_memories(spark, d)).select("session_id", "id", "content")


@query
def graph_augment(spark, d):
    mem = tables.graph_memories(spark, d)
    top = recall.newest(mem.withColumn("ts_ms", F.col("c_acctbal")), 4)
    return _placed(graph.augment(top, _edges(spark, d), mem, 9), "from_graph")


@query
def graph_counts(spark, d):
    return stats.graph_counts(graph.upsert_nodes(tables.triples(spark, d)), _edges(spark, d))


@query
def session_stats(spark, d):
    return stats.session_stats(tables.session_memories(spark, d, vectors=True))


@query
def stats_by_role(spark, d):
    return stats.by_role(tables.session_memories(spark, d))


@query
def stats_by_tier(spark, d):
    return stats.by_tier(tables.session_memories(spark, d))


@query
def user_stats(spark, d):
    return stats.session_stats(tables.user_memories(spark, d).withColumn("embedding", F.lit(None).cast("array<double>"))).drop("with_embeddings")


@query
def working_over_threshold(spark, d):
    return lifecycle.over_threshold(tables.session_memories(spark, d), 3)


@query
def consolidation_candidates(spark, d):
    rows = lifecycle.consolidation_candidates(tables.session_memories(spark, d), 3, 2)
    return rows.select("owner_id", "id", F.col("place").cast("long").alias("place"))


@query
def consolidate_report(spark, d):
    mem = tables.session_memories(spark, d)
    after, report = lifecycle.consolidate(mem, first_sentences, tables.EPOCH_MS, 3, 2)
    tiers = after.groupBy("owner_id").agg(F.count_if(F.col("tier") == "archived").alias("archived_rows"), F.count("*").alias("rows"))
    return tiers.join(report.drop("previews"), "owner_id", "left")


@query
def wake_briefing(spark, d):
    return lifecycle.briefing(recall.recall_user(tables.user_memories(spark, d), None, 3))


@query
def latency_percentiles(spark, d):
    rows = stats.percentiles(tables.table(spark, d, "events"), "value", "event_type")
    return rows.withColumn("n", F.col("n").cast("long"))


@query
def accuracy_by_category(spark, d):
    rows = tables.table(spark, d, "labels").join(tables.table(spark, d, "documents"), "doc_id").select(F.col("lang").alias("category"), (F.col("quality") == 1).alias("right"))
    return stats.accuracy(rows, "right", "category")


def _claims(spark):
    return claims.start(fixtures.claims(spark))


def _verdicts(rows):
    return rows.select("id", "reason")


@query
def claims_pronoun(spark, d):
    return _verdicts(claims.pronouns(_claims(spark)))


@query
def claims_temporal(spark, d):
    return _verdicts(claims.temporal(_claims(spark)))


@query
def claims_duplicate(spark, d):
    return _verdicts(claims.duplicates(_claims(spark)))


@query
def claims_vague(spark, d):
    return _verdicts(claims.vague(_claims(spark)))


@query
def claims_atomic_split(spark, d):
    return claims.atomic(_claims(spark)).select("id", "canonical_text", "object_text", "reason")


@query
def claims_entity_ref(spark, d):
    return _verdicts(claims.entity_references(_claims(spark), fixtures.entities(spark)))


@query
def claims_inference(spark, d):
    return _verdicts(claims.inferences(_claims(spark)))


@query
def claims_pipeline(spark, d):
    return claims.validate(fixtures.claims(spark), fixtures.entities(spark)).select("id", "canonical_text", "reason")


@query
def claim_confidence(spark, d):
    return fixtures.claims(spark).select("id", claims.confidence().alias("confidence"))


@query
def eval_chunk_index(spark, d):
    turns = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("window_id"), "turn", "role", F.col("text").alias("content"))
    return evaluate.chunk_index(turns)


@query
def eval_topk_context(spark, d):
    vectors = tables.embeddings(spark, d)
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_vector"))
    rows = evaluate.top_contexts(asked, vectors.withColumnRenamed("vec_id", "context_id"), 3)
    return rows.withColumn("position", F.col("position").cast("long"))


@query
def eval_exact_match(spark, d):
    return evaluate.report(evaluate.judged(spark.createDataFrame(fixtures.ANSWERS, "mode string, answer string, expected string")))


@query
def temporal_questions(spark, d):
    rows = spark.createDataFrame([(q,) for q in fixtures.QUESTIONS], "question string")
    return rows.select("question", T.temporal_question(F.col("question")).alias("temporal"))


@query
def streaming_belief(spark, d):
    return ingest.replay(spark, d)
