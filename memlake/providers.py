"""Model calls behind functions on DataFrames, with deterministic offline defaults.

A provider takes a DataFrame and returns it with a column more. The defaults touch no network; ``http_embedder`` and
``http_generator`` call a service from the executors, a batch of rows a task (``mapInPandas``)."""

from __future__ import annotations

import json
import urllib.request
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: DataFrame with ``content`` to the same with ``embedding`` (null where there is none).
Embedder = Callable[[DataFrame], DataFrame]
#: DataFrame (owner_id, contents, ids) to the same with ``summaries``.
Summariser = Callable[[DataFrame], DataFrame]
#: DataFrame with ``prompt`` to the same with ``reply`` (null on failure).
Generator = Callable[[DataFrame], DataFrame]


def hash_embedder(dimensions: int = 64) -> Embedder:
    """Unit vectors from hashes of the words: equal texts have equal vectors, shared words bring them closer."""

    def embed(rows: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower("content"), r"\s+"), lambda w: w != "")
        places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
        size = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x))
        return rows.withColumn("_counts", counts).withColumn("embedding", F.when(size > 0, F.transform("_counts", lambda x: x / size))).drop("_counts")

    return embed


def _post(url: str, body: dict, timeout: float, headers: dict[str, str] | None = None) -> dict:
    data = json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as reply:  # raises on a status that isn't 2xx
        return json.loads(reply.read())


def _mapped(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], column: str, kind: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column]
    return rows.drop(column).mapInPandas(run, ", ".join([*names, f"`{column}` {kind}"]))


def http_embedder(url: str, model: str, timeout: float = 5.0) -> Embedder:
    """Vectors from POST ``{url}/api/embeddings``; null on any failure, with one warning a task."""

    def embed(rows: DataFrame) -> DataFrame:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            found = []
            for text in frame["content"]:
                try:
                    found.append(_post(f"{url}/api/embeddings", {"model": model, "prompt": text}, timeout).get("embedding"))
                except (OSError, ValueError) as e:
                    warnings.warn(f"no vectors from {url}: {e}", stacklevel=1)
                    found.append(None)
            return frame.assign(embedding=found)

        return _mapped(rows, run, "embedding", "array<double>")

    return embed


def http_generator(url: str, model: str, key: str = "", system: str = "", json_mode: bool = False, strict: bool = False, timeout: float = 60.0) -> Generator:
    """Replies from POST ``{url}/chat/completions`` to each ``prompt``, at temperature 0. A failed call or an empty
    reply is null, or an error with ``strict``."""

    def generate(rows: DataFrame) -> DataFrame:
        def ask(prompt: str) -> str | None:
            messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
            body = {"model": model, "temperature": 0, "messages": messages} | ({"response_format": {"type": "json_object"}} if json_mode else {})
            try:
                reply = _post(f"{url}/chat/completions", body, timeout, {"Authorization": f"Bearer {key}"})["choices"][0]["message"]["content"]
                if not (reply or "").strip():
                    raise ValueError("the reply is empty")
                return reply
            except (OSError, ValueError, LookupError):
                if strict:
                    raise
                return None

        return _mapped(rows, lambda frame: frame.assign(reply=[ask(p) for p in frame["prompt"]]), "reply", "string")

    return generate


def first_sentences(rows: DataFrame) -> DataFrame:
    """Offline summariser: one summary, the first 80 characters of each row joined."""
    return rows.withColumn("summaries", F.array(F.array_join(F.transform("contents", lambda c: F.substring(c, 1, 80)), " | ")))


def model_summariser(generator: Generator) -> Summariser:
    """Summaries by a model: the rows as a numbered list, its JSON array of strings back; none if the call fails."""

    def summarise(rows: DataFrame) -> DataFrame:
        lines = F.array_join(F.transform("contents", lambda c, k: F.concat((k + 1).cast("string"), F.lit(". "), c)), "\n")
        asked = generator(rows.withColumn("prompt", F.concat(F.lit("Sum up these memories as a JSON array of short facts.\n"), lines)))
        return asked.withColumn("summaries", parsed_strings(F.col("reply"))).drop("prompt", "reply")

    return summarise


def no_reply(rows: DataFrame) -> DataFrame:
    """Offline generator: every call fails, so callers take their fallback."""
    return rows.withColumn("reply", F.lit(None).cast("string"))


def json_span(reply: Column, kind: str = "[]") -> Column:
    """The first span from an opening to the last closing bracket; null without one."""
    found = F.regexp_extract(reply, r"(?s)\[.*\]" if kind == "[]" else r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def unfenced(reply: Column) -> Column:
    """A reply without think tags and code fences."""
    plain = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(plain, r"(?i)```(?:json)?", ""))


def parsed_strings(reply: Column) -> Column:
    """Non-blank strings of a reply's JSON array; empty if there is none."""
    return F.filter(F.coalesce(F.from_json(json_span(reply), "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s) != "")


def parsed_triples(reply: Column) -> Column:
    """Valid triples of a reply's JSON array, lower-case and trimmed, confidence 0.9."""
    rows = F.coalesce(F.from_json(json_span(reply), "array<struct<from:string,relation:string,to:string>>"), F.array().cast("array<struct<from:string,relation:string,to:string>>"))
    whole = F.filter(rows, lambda t: (F.coalesce(t["from"], F.lit("")) != "") & (F.coalesce(t["relation"], F.lit("")) != "") & (F.coalesce(t["to"], F.lit("")) != ""))
    return F.transform(whole, lambda t: F.struct(F.trim(F.lower(t["from"])).alias("from_entity"), F.trim(F.lower(t["relation"])).alias("relation"), F.trim(F.lower(t["to"])).alias("to_entity"), F.lit(0.9).alias("confidence")))


def parsed_conflicts(reply: Column) -> Column:
    """1-based numbers of the statements that a reply's JSON object names; empty if the text has no
    object, null if it can't be read (callers then use the heuristic)."""
    span = json_span(reply, "{}")
    found = F.from_json(span, "contradictions array<struct<index:int>>")["contradictions"]
    return F.when(span.isNull() & reply.isNotNull(), F.array().cast("array<int>")).otherwise(F.transform(found, lambda x: x["index"]))


#: What an extraction reply holds.
EXTRACTION = """entities array<struct<id:string,name:string,type:string,aliases:array<string>>>,
    claims array<struct<id:string,canonical_text:string,subject_entity_id:string,subject_text:string,predicate:string,object_text:string,
    object_entity_id:string,memory_type:string,explicitness:string,polarity:string,status:string,confidence:double,
    temporal:struct<raw_text:string,normalized_start:string,normalized_end:string,granularity:string,relation_type:string,relation_to_event:string>,
    source_turn_index:int,linked_claim_ids:array<string>,extraction_confidence:double,entity_resolution_confidence:double,
    temporal_resolution_confidence:double,support_count:bigint,source_directness:double>>, anchor_conversation_time string"""


#: What the extraction model is told to do.
EXTRACTION_RULES = """You turn a conversation into atomic claims. Reply with one JSON object: entities (id, name, type, aliases)
and claims (id, canonical_text, subject_entity_id, subject_text, predicate, object_text, object_entity_id, memory_type,
explicitness, polarity, status, confidence, temporal, source_turn_index, linked_claim_ids and the confidences).
One fact a claim. Name people and things; no pronouns. Resolve relative times against anchor_conversation_time. Mark what
is stated, implied or inferred. Keep negations as polarity. Link claims that correct others. Invent nothing."""


def extraction_prompts(turns: DataFrame, anchor: str | None = None) -> DataFrame:
    """(window_id, prompt) of each window's turns (window_id, turn, role, content), with the time that relative ones
    refer to: ``anchor``, or now."""
    row = F.struct(F.col("turn").alias("index"), "role", "content")
    packed = turns.groupBy("window_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    time = F.lit(anchor) if anchor is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return packed.select("window_id", F.to_json(F.struct(time.alias("anchor_conversation_time"), "turns")).alias("prompt"))


def extract_claims(turns: DataFrame, generator: Generator, anchor: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims and entities of conversations by a model (``http_generator`` with EXTRACTION_RULES, json_mode and strict)."""
    return extracted(generator(extraction_prompts(turns, anchor)))


def extracted(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (with window_id and pos) and entities of extraction replies (window_id, reply)."""
    read = replies.select("window_id", F.from_json(unfenced(F.col("reply")), EXTRACTION).alias("x"))
    claims = read.select("window_id", F.posexplode("x.claims").alias("pos", "c")).select("window_id", "pos", "c.*")
    return claims, read.select("window_id", F.explode("x.entities").alias("e")).select("window_id", "e.*")
