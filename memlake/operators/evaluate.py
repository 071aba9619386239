"""Evaluation: context indexes, retrieval of contexts, answer matching."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import exact_match
from memlake.operators.nearest import nearest
from memlake.providers import Embedder, Generator


def chunk_index(turns: DataFrame) -> DataFrame:
    """One chunk a conversation window: ``role: content`` lines in order (columns window_id, turn, role, content)."""
    packed = turns.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("rows"))
    return packed.select("window_id", F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(": "), r["content"])), "\n").alias("chunk"))


def claim_index(validated: DataFrame) -> DataFrame:
    """The canonical text of each valid claim."""
    return validated.where("reason IS NULL").select("window_id", "id", F.col("canonical_text").alias("chunk"))


def _blocks(questions: DataFrame, key: str, at_most: int) -> list[DataFrame]:
    """The questions; if there are more than ``at_most``, dealt by a hash of the key into blocks of half as many on average."""
    if questions.limit(at_most + 1).count() <= at_most:
        return [questions]
    blocks = 2 * questions.count() // at_most + 1
    of = F.pmod(F.xxhash64(key), F.lit(blocks))
    return [questions.where(of == b) for b in range(blocks)]


def top_contexts(questions: DataFrame, contexts: DataFrame, k: int = 3, max_questions: int = 10_000) -> DataFrame:
    """The k most similar contexts (context_id, embedding) of each question (question_id, question_vector).

    Every question meets every context, in matrix products (``nearest``): up to ``max_questions`` go to all tasks at
    once; more are dealt by a hash of their id into blocks of half as many on average, which go one by one."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "context_id")

    def best(block: DataFrame) -> DataFrame:
        return nearest(block, contexts, k).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)

    return reduce(DataFrame.unionByName, map(best, _blocks(questions, "question_id", max_questions)))


#: What the model is told when it answers and when it judges.
STRICT_ANSWER = "Answer the question from the memories alone, in as few words as possible. If they don't say, reply: I don't know.\n"
STRICT_JUDGE = "Does the answer state the expected fact? Other facts, refusals and guesses are wrong. Reply yes or no.\n"


def judged(answers: DataFrame, judge: Generator | None = None) -> DataFrame:
    """``correct`` by exact match of answer and expected; what doesn't match is asked of the judge, if there is one,
    and is correct if its reply starts with yes."""
    exact = F.coalesce(exact_match(F.col("answer"), F.col("expected")), F.lit(False))
    if judge is None:
        return answers.withColumn("correct", exact)
    said = [F.lit(STRICT_JUDGE + "Expected: "), F.col("expected"), F.lit("\nAnswer: "), F.coalesce("answer", F.lit(""))]
    rows = answers.withColumn("correct", exact)
    asked = judge(rows.where("NOT correct").withColumn("prompt", F.concat(*said)))
    right = F.coalesce(F.startswith(F.lower(F.trim("reply")), F.lit("yes")), F.lit(False))
    return rows.where("correct").unionByName(asked.withColumn("correct", right).select(*rows.columns))


def report(results: DataFrame) -> DataFrame:
    """Share of correct answers per mode."""
    return results.groupBy("mode").agg(F.count("*").alias("total"), F.avg(F.col("correct").cast("int")).alias("score"))


def top1_contains(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each query's first result contains the expected text (query_id, expected); no result: no."""
    first = results.where(F.col("position") == 1).select("query_id", "content")
    hit = F.coalesce(F.contains(F.lower("content"), F.lower("expected")), F.lit(False))
    return expected.join(first, "query_id", "left").select("query_id", hit.alias("correct"))


def noise_test(signals: DataFrame, noise: DataFrame, max_questions: int = 100_000) -> DataFrame:
    """Top-1 results of each signal's question among all signals and noise rows, by keyword score.

    ``signals``: query_id, term, content; ``noise``: content; repeated rows count once. A term counts in every word
    that contains it, as in recall. A row meets only the questions whose term it holds: its words are cut into all
    their stretches of the terms' lengths (few: one each a place), which probe the broadcast terms in the task that
    read the row; there its hits are counted, and only a task's best row of each question is exchanged. More than
    ``max_questions`` are broadcast in blocks."""
    rows = signals.select("content").unionByName(noise.select("content"))
    asked = signals.select("query_id", F.lower("term").alias("term"))
    sizes = F.broadcast(asked.agg(F.array_sort(F.collect_set(F.length("term"))).alias("sizes")))
    words = rows.withColumn("words", F.split(F.lower("content"), r"\s+", -1)).crossJoin(sizes)  # one row
    stretches = "flatten(transform(filter(sizes, k -> k <= length(word)), k -> transform(sequence(1, length(word) - k + 1), i -> substring(word, i, k))))"
    held = words.select("content", "words", F.explode(F.expr(f"array_distinct(flatten(transform(array_distinct(words), word -> {stretches})))")).alias("term"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "content")

    def best(block: DataFrame) -> DataFrame:
        hits = F.size(F.filter("words", lambda word: word.contains(F.col("term"))))
        found = held.join(F.broadcast(block), "term").select("query_id", "content", (hits / F.size("words")).alias("tf"))
        scored = found.select("query_id", "content", F.least(F.lit(1.0), F.col("tf") * F.log(1 + F.lit(10.0) / (1 + F.col("tf") * 10)) * 5).alias("score"))
        return scored.withColumn("position", F.row_number().over(order)).where("position = 1").select("query_id", "content", "position")

    return reduce(DataFrame.unionByName, map(best, _blocks(asked, "query_id", max_questions)))


def answered(questions: DataFrame, index: DataFrame, embedder: Embedder, generator: Generator, k: int, mode: str, judge: Generator | None = None) -> DataFrame:
    """Questions (question_id, question, expected) answered from their k best chunks of an index (chunk)."""
    contexts = embedder(index.select(F.xxhash64("chunk").alias("context_id"), F.col("chunk").alias("content")).distinct())
    asked = embedder(questions.withColumn("content", F.col("question"))).select("question_id", F.col("embedding").alias("question_vector"))
    best = top_contexts(asked, contexts.select("context_id", "embedding"), k).join(contexts.select("context_id", "content"), "context_id")
    packed = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("rows"))
    context = F.array_join(F.transform("rows", lambda r: r["content"]), "\n---\n")
    prompts = questions.join(packed, "question_id", "left").withColumn("prompt", F.concat(F.lit(STRICT_ANSWER), F.coalesce(context, F.lit("")), F.lit("\nQuestion: "), F.col("question")))
    replies = generator(prompts).withColumn("answer", F.col("reply"))
    return judged(replies.select("question_id", F.lit(mode).alias("mode"), "answer", "expected"), judge)


def ab_test(turns: DataFrame, validated: DataFrame, questions: DataFrame, embedder: Embedder, generator: Generator, judge: Generator | None = None) -> DataFrame:
    """Raw chunks (3 contexts) against validated claims (5): answers of both modes, for ``report``."""
    a = answered(questions, chunk_index(turns), embedder, generator, 3, "chunks", judge)
    return a.unionByName(answered(questions, claim_index(validated), embedder, generator, 5, "claims", judge))


def retention(rows: DataFrame, questions: DataFrame, judge: Generator | None = None) -> DataFrame:
    """Whether the first row recalled for each question answers it: (question_id, days, correct).

    ``rows``: memories of owners that end in the days they were aged by; ``questions``: owner_id, question_id,
    days, term, expected. Rows without a hit count as wrong."""
    held = rows.select("owner_id", "content", "ts_ms", "id", F.explode(F.array_distinct(F.split(F.lower("content"), r"[^a-z0-9_]+"))).alias("term"))
    hits = questions.select("owner_id", "question_id", "days", F.lower("term").alias("term"), "expected").join(held, ["owner_id", "term"], "left")
    order = Window.partitionBy("question_id", "days").orderBy(F.desc("ts_ms"), "id")
    first = hits.withColumn("position", F.row_number().over(order)).where("position = 1").withColumn("answer", F.coalesce("content", F.lit("-")))
    return judged(first.select("question_id", "days", "answer", "expected"), judge).select("question_id", "days", "correct")


def scale_test(rows: DataFrame, queries: list[str], run: Callable[[DataFrame, str], DataFrame], at_most: int = 100) -> DataFrame:
    """Latencies of up to ``at_most`` queries, one after the other: (query, ms)."""
    return _timed(rows, queries[:at_most], run, 1)


def concurrency_test(rows: DataFrame, queries: list[str], run: Callable[[DataFrame, str], DataFrame], concurrency: int) -> DataFrame:
    """Latencies of ``concurrency`` queries that run at the same time, taken in turn from those given: (query, ms)."""
    return _timed(rows, [queries[k % len(queries)] for k in range(concurrency)], run, concurrency)


def _timed(rows: DataFrame, queries: list[str], run: Callable[[DataFrame, str], DataFrame], threads: int) -> DataFrame:
    def one(query: str) -> tuple[str, float]:
        began = time.perf_counter()
        run(rows, query).write.format("noop").mode("overwrite").save()
        return query, 1000 * (time.perf_counter() - began)

    with ThreadPoolExecutor(max_workers=min(threads, 64)) as pool:
        return rows.sparkSession.createDataFrame(list(pool.map(one, queries)), "query string, ms double")


def write_report(results: DataFrame, path: str) -> None:
    """The share of correct answers per mode as JSON and as a Markdown table, in folders below ``path``."""
    scores = report(results)
    scores.write.mode("overwrite").json(f"{path}/json")
    line = F.concat_ws(" | ", F.lit("|"), "mode", F.format_number("score", 3), F.col("total").cast("string"), F.lit("|"))
    table = scores.agg(F.array_join(F.concat(F.array(F.lit("| mode | score | total |"), F.lit("|-|-|-|")), F.array_sort(F.collect_list(line))), "\n").alias("value"))
    table.write.mode("overwrite").text(f"{path}/markdown")
