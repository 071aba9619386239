"""Generated evaluation stacks: sessions of messages with a question, its answer and a category.

Rows are made by column expressions from a range of numbers, so any number of stacks is made in parallel and
the same number always gives the same stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["single-session-info", "single-session-preference", "single-session-assistant", "multi-session", "temporal", "knowledge-update"]
TOWNS = ["Oslo", "Lima", "Pune", "Bern", "Quito", "Hanoi", "Turin"]
DISHES = ["ramen", "paella", "dal", "pierogi", "tacos", "fondue", "pho"]
NAMES = ["Ada", "Ben", "Cleo", "Dan", "Eve"]
DAY_MS = 86_400_000


def _pick(words: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))).cast("int"))


def stacks(spark: SparkSession, n: int, start_ms: int = 1_700_000_000_000) -> DataFrame:
    """stack_id, category, sessions array<struct<ts_ms, messages array<struct<role, content>>>>, question, expected."""
    k = F.col("id")
    name, old, new, dish = _pick(NAMES, k), _pick(TOWNS, k), _pick(TOWNS, k + 3), _pick(DISHES, k * 5 + 2)
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    at = lambda day, *messages: F.struct((F.lit(start_ms) + k * 1000 + day * DAY_MS).alias("ts_ms"), F.array(*messages).alias("messages"))
    small = say("assistant", F.lit("Noted, thank you."))
    said = [
        (F.array(at(0, say("user", F.concat(F.lit("My friend "), name, F.lit(" lives in "), old)), small)), F.concat(F.lit("Where does "), name, F.lit(" live?")), old),
        (F.array(at(0, say("user", F.concat(F.lit("I always prefer "), dish, F.lit(" for dinner"))), small)), F.lit("Which dinner do I prefer?"), dish),
        (F.array(at(0, say("user", F.lit("What should I cook?")), say("assistant", F.concat(F.lit("I suggest "), dish)))), F.lit("What did you suggest to cook?"), dish),
        (F.array(at(0, say("user", F.concat(name, F.lit(" is visiting me")))), at(1, say("user", F.concat(F.lit("My visitor comes from "), old)))), F.concat(F.lit("Where does "), name, F.lit(" come from?")), old),
        (F.array(at(0, say("user", F.concat(F.lit("Yesterday I was in "), old))), at(7, say("user", F.concat(F.lit("Today I am in "), new)))), F.lit("Where was I most recently?"), new),
        (F.array(at(0, say("user", F.concat(F.lit("I live in "), old))), at(30, say("user", F.concat(F.lit("I moved and live in "), new, F.lit(" now"))))), F.lit("Where do I live now?"), new),
    ]
    case = F.pmod(k, F.lit(len(said)))
    column = lambda j: F.coalesce(*[F.when(case == c, x[j]) for c, x in enumerate(said)])
    return spark.range(n).select(k.alias("stack_id"), _pick(CATEGORIES, k).alias("category"), column(0).alias("sessions"), column(1).alias("question"), column(2).alias("expected"))


def turns(stacks_: DataFrame) -> DataFrame:
    """Messages of stacks as rows to remember: owner_id, content, role, ts_ms (a millisecond apart)."""
    sessions = stacks_.select(F.concat(F.lit("stack-"), F.col("stack_id").cast("string")).alias("owner_id"), F.explode("sessions").alias("s"))
    return sessions.select("owner_id", F.col("s.ts_ms").alias("from_ms"), F.posexplode("s.messages").alias("k", "m")).select("owner_id", "m.content", "m.role", (F.col("from_ms") + F.col("k")).alias("ts_ms"))


def aged(rows: DataFrame, days: int) -> DataFrame:
    """The same rows, so many days older."""
    return rows.withColumn("ts_ms", F.col("ts_ms") - days * DAY_MS)


def question_set(spark: SparkSession) -> DataFrame:
    """Twenty questions, two for each of ten windows: id, window_index, question, expected."""
    return stacks(spark, 20).select(F.col("stack_id").alias("id"), F.floor(F.col("stack_id") / 2).alias("window_index"), "question", "expected")
