"""Evaluation runs, generated stacks, model replies, bucketed tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake import schema as S
from memlake.api import MemoryLake
from memlake.functions import vectors as V
from memlake.operators import claims, evaluate, recall, stats
from memlake.plans import fixtures
from memlake.providers import extracted, hash_embedder, no_reply, parsed_conflicts, parsed_strings
from memlake.sources import synthetic, tables
from memlake.sources.store import save_bucketed


def test_stacks_repeat(spark):
    a, b = synthetic.stacks(spark, 30), synthetic.stacks(spark, 30).repartition(3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r.category for r in a.collect()} == set(synthetic.CATEGORIES)
    assert all(r.expected in str(r.sessions) for r in a.collect())


def test_stacks_are_recalled(spark, tmp_path):
    stacks = synthetic.stacks(spark, 12)
    lake = MemoryLake(spark, str(tmp_path / "stacks"))
    lake.remember_all(synthetic.turns(stacks))
    found = recall.recall(lake.memories(), "where live prefer suggest comes", 3).groupBy("owner_id").agg(F.array_join(F.collect_list("content"), "\n").alias("text"))
    both = stacks.join(found, F.concat(F.lit("stack-"), F.col("stack_id").cast("string")) == F.col("owner_id"))
    results = both.select("category", F.col("text").contains(F.col("expected")).alias("correct"))
    assert all(r.accuracy == 1.0 for r in stats.accuracy(results, "correct", "category").collect())
    assert synthetic.aged(synthetic.turns(stacks), 30).agg(F.max("ts_ms")).first()[0] == synthetic.turns(stacks).agg(F.max("ts_ms")).first()[0] - 30 * synthetic.DAY_MS


def test_noise(spark):
    signals = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("code"), F.col("id").cast("string")).alias("term"), F.concat(F.lit("the secret of code"), F.col("id").cast("string"), F.lit(" is "), (F.col("id") * 37).cast("string")).alias("content"))
    noise = tables.table(spark, "/root/testdata/sf0.001", "conversations").select(F.col("text").alias("content"))
    expected = signals.select("query_id", (F.col("query_id") * 37).cast("string").alias("expected"))
    got = evaluate.top1_contains(evaluate.noise_test(signals, noise), expected)
    assert got.where("correct").count() == 40
    assert not evaluate.top1_contains(evaluate.noise_test(signals.limit(0), noise), expected).first().correct


def test_noise_meets_questions_where_it_is_read(spark):
    """Repeated rows count once, and what is exchanged doesn't grow with the rows' stretches."""
    asked = spark.createDataFrame([(0, "The", ""), (1, "ab", ""), (2, "b c", ""), (3, "zz", "Zz"), (4, "the", None)], "query_id long, term string, content string")
    noise = spark.createDataFrame([("the then x y z w v u t s",)] * 4 + [("THE the a b c d e f g",), ("abab ab cab",), ("x ab",), (None,)], "content string")
    want = [(0, "THE the a b c d e f g"), (1, "abab ab cab"), (3, "Zz"), (4, "THE the a b c d e f g")]
    found = evaluate.noise_test(asked, noise)
    assert sorted((r.query_id, r.content) for r in found.collect()) == want
    assert sorted((r.query_id, r.content) for r in evaluate.noise_test(asked, noise, max_questions=2).collect()) == want
    repeated = spark.createDataFrame([("the" + " x" * 29,)] * 2 + [("the" + " y" * 19,)], "content string")  # 1 of 30, 1 of 20
    assert [r.content for r in evaluate.noise_test(asked.where("query_id = 0"), repeated).collect()] == ["the" + " y" * 19]
    many = noise.crossJoin(spark.range(50)).select(F.concat("content", F.lit(" more"), "id").alias("content"))
    exchanged = evaluate.noise_test(asked, many)
    exchanged.collect()
    written = _exchanged_rows(exchanged)
    assert written and sum(written) <= 5 * many.rdd.getNumPartitions() + 20


def _exchanged_rows(df) -> list[int]:
    """Rows that each shuffle of an executed plan wrote."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "ShuffleExchangeExec":
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_ab_test(spark):
    turns = spark.createDataFrame([("w1", 0, "user", "Alice works at Acme"), ("w2", 0, "user", "the weather is fine")], "window_id string, turn int, role string, content string")
    valid = claims.validate(fixtures.claims(spark), fixtures.entities(spark))
    asked = spark.createDataFrame([(1, "Alice works at Acme", "acme"), (2, "nothing", "zebra")], "question_id int, question string, expected string")
    echo = lambda rows: rows.withColumn("reply", F.split("prompt", "\nQuestion: ")[0])
    got = {r.mode: r.score for r in evaluate.report(evaluate.ab_test(turns, valid, asked, hash_embedder(16), echo)).collect()}
    assert got == {"chunks": 0.5, "claims": 0.5}
    assert {r.score for r in evaluate.report(evaluate.ab_test(turns, valid, asked, hash_embedder(16), no_reply)).collect()} == {0.0}


def test_extraction_reply(spark):
    said = '<think>hm</think>```json\n{"entities":[{"id":"e1","name":"Ann","type":"person"}],"claims":[{"id":"c1","canonical_text":"Ann likes green tea","subject_entity_id":"e1","subject_text":"Ann","predicate":"likes","object_text":"green tea","explicitness":"stated","extraction_confidence":0.9}]}\n```'
    found, entities = extracted(spark.createDataFrame([("w", said), ("x", "sorry")], "window_id string, reply string"))
    got = claims.validate(found, entities).collect()
    assert [(r.window_id, r.id, r.reason) for r in got] == [("w", "c1", None)]


def test_replies(spark):
    rows = spark.createDataFrame([('so ["a", " ", "b"] there',), ("none",), (None,), ('{"contradictions":[{"index":2}]}',)], "r string")
    got = rows.select(parsed_strings(F.col("r")).alias("s"), parsed_conflicts(F.col("r")).alias("c")).collect()
    assert [r.s for r in got[:3]] == [["a", "b"], [], []]
    assert [r.c for r in got] == [[], [], None, [2]]


def test_known_hashes_are_duplicates(spark):
    rows = claims.start(fixtures.claims(spark))
    known = rows.where("id = 'c18'").select(claims.claim_hash().alias("hash"))
    assert {r.id for r in claims.duplicates(rows, known).where("reason = 'duplicate'").collect()} == {"c6", "c9", "c18"}


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    save_bucketed(tables.session_memories(spark, "/root/testdata/sf0.001"), "bucketed_memories", 4, path=str(tmp_path / "b"))
    plan = recall.newest(spark.table("bucketed_memories"), 3)._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_memories")
    assert "Exchange" not in plan


def test_collisions(spark):
    rows = spark.createDataFrame([("s", "x", "user", 1), ("s", "x", "user", 1), ("s", "x", "user", 2)], "owner_id string, content string, role string, ts_ms long")
    assert S.collisions(S.remembered(rows, "session")).count() == 1


def test_top_contexts_in_blocks(spark):
    vectors = tables.embeddings(spark, "/root/testdata/sf0.001").limit(60).localCheckpoint()
    asked = vectors.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_vector"))
    contexts = vectors.withColumnRenamed("vec_id", "context_id")
    whole = sorted(evaluate.top_contexts(asked, contexts, 3).collect())
    assert len(whole) == 180 and sorted(evaluate.top_contexts(asked, contexts, 3, max_questions=25).collect()) == whole


def _by_cosine(asked, contexts, k):
    """The k best by the column expression over all pairs."""
    pairs = contexts.crossJoin(asked).select("question_id", "context_id", V.cosine(F.col("question_vector"), F.col("embedding")).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "context_id")
    return pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _texts(df) -> list[str]:
    return sorted(str((r.question_id, r.context_id, r.score, r.position)) for r in df.collect())


def test_top_contexts_are_those_of_all_pairs(spark):
    """Copies, nulls, other dimensions, numbers at the ends of the doubles; no rows for pairs."""
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None, 2.0], [nan, 1.0], [inf, 1.0], [-inf, 2.0], [1e200, 1e200], [1e-200, 1e-200], [5e-162, 7e-162], [-1.0], [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0]]
    plain = tables.embeddings(spark, "/root/testdata/sf0.001").limit(300).collect()
    near = [[1.0, 1e-9 * k] for k in range(12)]  # equal in single precision
    some = [r.embedding for r in plain] + [plain[0].embedding] * 30 + near
    for vectors in (some, odd, odd + some):
        rows = [(f"v{k * 7919 % 1009:04}", v) for k, v in enumerate(vectors)]
        contexts = spark.createDataFrame(rows, "context_id string, embedding array<double>").repartition(3).localCheckpoint()
        asked = contexts.where("substr(context_id, 5) IN ('0', '5') OR size(embedding) < 5 OR embedding IS NULL").select(F.xxhash64("context_id").alias("question_id"), F.col("embedding").alias("question_vector"))
        for k in (1, 3, 40):
            assert _texts(evaluate.top_contexts(asked, contexts, k)) == _texts(_by_cosine(asked, contexts, k))
    plan = evaluate.top_contexts(asked, contexts, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not evaluate.top_contexts(asked.limit(0), contexts, 3).count() and not evaluate.top_contexts(asked, contexts.limit(0), 3).count()
