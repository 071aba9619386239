"""Literal rows for what the benchmark tables never hold: one set of rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.schema import CLAIMS

#: Existing statement, new statement.
STATEMENTS = [
    ("s1", "User prefers TypeScript", "User doesn't prefer TypeScript anymore"),
    ("s2", "User prefers TypeScript", "The weather is nice today"),
    ("s3", "I love long walks outside", "I never love long walks outside now"),
    ("s4", "We use Postgres for storage", "We use Postgres for storage daily"),
    ("s5", "Team wants weekly reports sent", "Team no longer wants weekly reports sent"),
    ("s6", "", "Nothing to see"),
]

TEXTS = [
    "Something happened", "Thanks!", "ok", "I always prefer TypeScript over JavaScript", "Deadline is 2026-04-01 for the launch",
    "Hello, thank you, sounds good", "The password and api key are secret", "In May we pay $1,200 or 15%", "mañmay is no month here at all", "", "order 12345 confirmed, remember this " * 8,
]

ANSWERS = [("a", "Paris", "The capital is paris."), ("a", "It is in London", "london"), ("b", "", "anything"), ("b", "blue", "red"), ("b", "Red wine", "red"), ("c", "42", "24")]

QUESTIONS = ["What is my current favourite restaurant?", "Where do I live now?", "Who is Ann?", "Latest release", "knowledge"]

MORE = dict(object_entity_id=None, explicitness="stated", start=None, end=None, relation_type=None, event=None, extraction=0.9, entity=0.8, temporal=0.7, support=2, directness=1.0)


def _claim(window, pos, text, subject, subject_text, predicate, object_text, **more):
    m = MORE | more
    return (window, pos, f"c{pos}", text, subject, subject_text, predicate, object_text, m["object_entity_id"], m["explicitness"], m["start"], m["end"], m["relation_type"], m["event"], m["extraction"], m["entity"], m["temporal"], m["support"], m["directness"])


COLUMNS = ["window_id", "pos", "id", "canonical_text", "subject_entity_id", "subject_text", "predicate", "object_text", "object_entity_id", "explicitness", "normalized_start", "normalized_end", "relation_type", "relation_to_event", "extraction_confidence", "entity_resolution_confidence", "temporal_resolution_confidence", "support_count", "source_directness"]
KINDS = ["string", "int", "string", "string", "string", "string", "string", "string", "string", "string", "string", "string", "string", "string", "double", "double", "double", "bigint", "double"]

CLAIM_ROWS = [
    _claim("w1", 0, "She likes coffee a lot", "e1", " She ", "likes", "coffee"),
    _claim("w1", 1, "Alice knows no one here", "e1", "Alice", "knows", "No One"),
    _claim("w1", 2, "Alice moved to Boston", "e1", "Alice", "moved to", "Boston", start="2024-05-02", end="2024-05-01"),
    _claim("w1", 3, "Alice moved to Berlin", "e1", "Alice", "moved to", "Berlin", start="not a date", end="2024-05-01"),
    _claim("w1", 4, "Alice left before it", "e1", "Alice", "left", "work", relation_type="before"),
    _claim("w1", 5, "Alice works at Acme", "e1", "Alice", "works at", "Acme", object_entity_id="e2"),
    _claim("w1", 6, "Alice works at Acme", "e1", "Alice", "works at", "Acme Corp", support=7),
    _claim("w2", 7, "Alice works at Acme", "e1", "Alice", "works at", "Acme"),
    _claim("w1", 8, "Bob likes stuff", "e3", "Bob", "likes", "Stuff"),
    _claim("w1", 9, "Bob likes stuff", "e3", "Bob", "likes", "music", explicitness="implied"),
    _claim("w1", 10, "Bob ran.", "e3", "Bob", "ran", "home"),
    _claim("w1", 11, "Bob owns several cars", "e3", "Bob", "  ", "cars"),
    _claim("w1", 12, "Bob likes tea and coffee and milk", "e3", "Bob", "likes", "tea and coffee and milk"),
    _claim("w1", 13, "Alice works at Acme and lives in Boston", "e1", "Alice", "works at", "Acme"),
    _claim("w1", 14, "Alice sings and Alice dances", "e1", "Alice", "sings", "well"),
    _claim("w1", 15, "A and Bob share a flat", "e3", "Bob", "shares", "flat"),
    _claim("w1", 16, "Bob reads as well as writes and paints", "e3", "Bob", "reads", "books"),
    _claim("w1", 17, "Bob likes x and tea today", "e3", "Bob", "likes", "x and tea"),
    _claim("w1", 18, "Carol lives in Rome", "e9", "Carol", "lives in", "Rome"),
    _claim("w1", 19, "Alice visited Rome", "e1", "Alice", "visited", "Rome", object_entity_id="e8"),
    _claim("w1", 20, "Alice may like opera", "e1", "Alice", "likes", "opera", explicitness="inferred", extraction=0.59),
    _claim("w1", 21, "Alice may like ballet", "e1", "Alice", "likes", "ballet", explicitness="inferred", extraction=0.6),
    _claim("w1", 22, "Alice may like theatre", "e1", "Alice", "likes", "theatre", explicitness="inferred", extraction=None),
    _claim("w1", 23, "Bob plays chess, and also go", "e3", "Bob", "plays", "chess, and also go"),
]
ENTITY_ROWS = [("w1", "e1"), ("w1", "e2"), ("w1", "e3"), ("w2", "e1")]


def claims(spark: SparkSession) -> DataFrame:
    flat = spark.createDataFrame(CLAIM_ROWS, ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, KINDS, strict=True)))
    nested = flat.selectExpr("*", "named_struct('raw_text', CAST(NULL AS STRING), 'normalized_start', normalized_start, 'normalized_end', normalized_end, 'granularity', CAST(NULL AS STRING), 'relation_type', relation_type, 'relation_to_event', relation_to_event) AS temporal")
    return nested.drop("normalized_start", "normalized_end", "relation_type", "relation_to_event").unionByName(spark.createDataFrame([], CLAIMS), allowMissingColumns=True)


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITY_ROWS, "window_id string, id string")


def values(rows: list[tuple], columns: list[str], kinds: list[str]) -> str:
    """The rows as a SQL subquery."""
    names = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}

    def literal(x, kind: str) -> str:
        said = "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
        return f"CAST({said} AS {names[kind]})"

    body = ", ".join("(" + ", ".join(literal(x, k) for x, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"
