"""Scores on literal rows, with values worked out by hand."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions import vectors as V


def one(spark, columns: dict, expression):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in columns.items())).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("text", "score"), [("Something happened", 0.37), ("Thanks!", 0.37), ("ok", 0.37), ("I always prefer TypeScript over JavaScript", 0.66), ("Deadline is 2026-04-01 for the launch", 0.70), ("mañmay is no month, nor is it a word", 0.57)])
def test_importance(spark, text, score):
    assert one(spark, {"t": text}, T.importance(F.col("t"))) == score


def test_importance_stays_in_bounds(spark):
    rows = spark.createDataFrame([("thanks ok sure hello hi hey bye lol haha got it sounds good",), ("prefer always never important remember critical must need to goal decision decided agreed",)], "t string")
    assert [r.x for r in rows.select(T.importance(F.col("t")).alias("x")).collect()] == [0.0, 1.0]


def keyword(query: str, content: str) -> float:
    terms = [t for t in query.lower().split() if len(t) > 2]
    words = __import__("re").split(r"[ \t\n\x0b\f\r]+", content.lower())
    total = 0.0
    for t in terms:
        tf = sum(t in w for w in words) / len(words)
        total += tf * math.log(1 + 10 / (1 + tf * 10))
    return min(1.0, total * 5)


@given(query=st.text("abc de", max_size=12), content=st.text("abcde  ", max_size=40))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_keyword_score(spark, query, content):
    got = one(spark, {"t": content}, T.keyword_score(T.words(F.col("t")), query))
    assert got == pytest.approx(keyword(query, content), abs=1e-12) and 0 <= got <= 1


def test_cosine(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, {"a": [1.0, 2.0], "b": [1.0, 2.0]}, V.cosine(a, b)) == pytest.approx(1)
    assert one(spark, {"a": [1.0, 0.0], "b": [0.0, 1.0]}, V.cosine(a, b)) == 0
    assert one(spark, {"a": [1.0, 0.0], "b": [-1.0, 0.0]}, V.cosine(a, b)) == -1
    assert one(spark, {"a": [0.0, 0.0], "b": [1.0, 0.0]}, V.cosine(a, b)) == 0
    assert one(spark, {"a": [0.0, 3.0], "b": [4.0, 0.0]}, V.euclidean(a, b)) == 5
    with pytest.raises(PySparkException):
        one(spark, {"a": [1.0], "b": [1.0, 0.0]}, V.cosine_strict(a, b))


@pytest.mark.parametrize(("old", "new", "similarity", "hit"), [("User prefers TypeScript", "User doesn't prefer TypeScript anymore", 0.4, True), ("User prefers TypeScript", "The weather is nice today", 0.0, False), ("We use Go", "We use Go", 0.0, False)])
def test_contradiction(spark, old, new, similarity, hit):
    row = {"o": old, "n": new}
    a, b = T.tokens(F.col("n")), T.tokens(F.col("o"))
    assert one(spark, row, T.overlap(a, b)) == similarity
    assert one(spark, row, T.contradicts(F.col("n"), F.col("o"), a, b)) is hit


def test_like_keeps_wildcards(spark):
    assert one(spark, {"t": "saxbx"}, T.like_any(F.col("t"), "a_b"))
    assert not one(spark, {"t": "plain"}, T.like_any(F.col("t"), "a\\b"))
    assert T.like_any(F.col("t"), "a b") is None


@pytest.mark.parametrize(("reply", "value"), [("0.85", 0.85), (" .5 or so", 0.5), ("1.0", 1.0), ("7.3", 1.0), ("1", 0.4), ("0", 0.4), ("none", 0.4), (None, 0.4)])
def test_parsed_importance(spark, reply, value):
    assert one(spark, {"t": reply}, T.parsed_importance(F.col("t"), F.lit(0.4))) == value


def test_trim_takes_all_white_space(spark):
    assert one(spark, {"t": "\t a ,;\n"}, T.trimmed(F.col("t"), ",;")) == "a"
