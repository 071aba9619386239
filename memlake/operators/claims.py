"""Claim validation: seven stages in a fixed order, each over the survivors of those before.

A claim carries ``reason`` and ``detail``, null while it is valid. Stages are projections; only the duplicate
stage shuffles (by hash) and the entity stage joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import phrases
from memlake.functions.text import trimmed

MIN_CANONICAL, MIN_INFERENCE, MIN_FRAGMENT = 10, 0.6, 2


def start(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"reason": F.lit(None).cast("string"), "detail": F.lit(None).cast("string"), "part": F.lit(0)})


def _reject(rows: DataFrame, *rules: tuple[Column, str, Column]) -> DataFrame:
    """Reject valid claims by the first rule that holds; a rule that is null doesn't."""
    reason, detail = F.col("reason"), F.col("detail")
    chain_r = chain_d = None
    for cond, name, text in rules:
        holds = F.coalesce(cond, F.lit(False))
        chain_r = F.when(holds, F.lit(name)) if chain_r is None else chain_r.when(holds, F.lit(name))
        chain_d = F.when(holds, text) if chain_d is None else chain_d.when(holds, text)
    return rows.withColumns({"detail": F.when(reason.isNull(), chain_d).otherwise(detail), "reason": F.when(reason.isNull(), chain_r).otherwise(reason)})


def _normal(column: str) -> Column:
    return F.lower(trimmed(F.col(column)))


def pronouns(rows: DataFrame) -> DataFrame:
    said = lambda c: F.concat(F.lit(f'{c} "'), F.col(c), F.lit('" is a pronoun'))
    return _reject(rows, (_normal("subject_text").isin(phrases.PRONOUNS), "pronoun_subject", said("subject_text")), (_normal("object_text").isin(phrases.PRONOUNS), "pronoun_object", said("object_text")))


def temporal(rows: DataFrame) -> DataFrame:
    a, b = F.col("temporal.normalized_start"), F.col("temporal.normalized_end")
    early = (a != "") & (b != "") & (F.try_to_timestamp(b) < F.try_to_timestamp(a))
    kind, event = F.coalesce("temporal.relation_type", F.lit("")), F.coalesce("temporal.relation_to_event", F.lit(""))
    return _reject(rows, (early, "temporal_invalid", F.concat(F.lit("end ("), b, F.lit(") precedes start ("), a, F.lit(")"))), ((kind != "") & (event == ""), "temporal_invalid", F.concat(F.lit('relation_type "'), kind, F.lit('" without relation_to_event'))))


def claim_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce("canonical_text", F.lit("")), F.coalesce("subject_entity_id", F.lit("")), F.coalesce("predicate", F.lit(""))), 256)


def duplicates(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first valid claim of a hash in its window stays; all of known hashes (column ``hash``) go."""
    rows = rows.withColumn("hash", claim_hash())
    order = Window.partitionBy("window_id", "hash", F.col("reason").isNull()).orderBy("pos", "part")
    seen = F.row_number().over(order) > 1
    if known is not None:
        rows = rows.join(known.select("hash").distinct().withColumn("known", F.lit(True)), "hash", "left")
        seen = seen | F.coalesce("known", F.lit(False))
    rows = rows.withColumn("seen", seen)
    return _reject(rows, (F.col("seen"), "duplicate", F.concat(F.lit("hash "), F.substring("hash", 1, 12), F.lit(" was seen before")))).drop("hash", "seen", "known")


def vague(rows: DataFrame) -> DataFrame:
    short = F.length("canonical_text") < MIN_CANONICAL
    blank = trimmed(F.coalesce("predicate", F.lit(""))) == ""
    filler = _normal("object_text").isin(phrases.FILLERS)
    return _reject(rows, (short, "vague_claim", F.concat(F.lit("canonical_text has "), F.length("canonical_text").cast("string"), F.lit(" characters"))), (blank, "vague_claim", F.lit("predicate is empty")), (filler, "vague_claim", F.concat(F.lit('object_text "'), F.col("object_text"), F.lit('" says nothing'))))


def atomic(rows: DataFrame) -> DataFrame:
    """Split compounds. The connector is the first of the list that the text has anywhere. An object with
    it splits at all places, else the text splits at the first; fragments aren't checked again."""
    low, obj = F.lower("canonical_text"), F.lower(F.coalesce("object_text", F.lit("")))
    rows = rows.withColumn("connector", F.coalesce(*[F.when(low.contains(c), F.lit(c)) for c in phrases.CONNECTORS]))
    c = F.col("connector")
    # One split expression per connector, since a pattern must be constant.
    parts = F.coalesce(*[F.when(c == x, F.split("object_text", f"(?i){x}", -1)) for x in phrases.CONNECTORS])
    fragments = F.filter(F.transform(parts, lambda p: trimmed(p, ",;")), lambda p: F.length(p) >= MIN_FRAGMENT)
    at = F.expr("locate(lower(object_text), lower(canonical_text))")
    head, tail = F.expr("substring(canonical_text, 1, locate(lower(object_text), lower(canonical_text)) - 1)"), F.expr("substring(canonical_text, locate(lower(object_text), lower(canonical_text)) + length(object_text))")
    rebuilt = lambda p: F.when(at > 0, F.concat(head, p, tail)).otherwise(F.col("canonical_text"))
    by_object = F.transform("fragments", lambda p, k: F.struct(k.alias("k"), p.alias("object_text"), rebuilt(p).alias("canonical_text")))
    left = trimmed(F.expr("substring(canonical_text, 1, instr(lower(canonical_text), connector) - 1)"), ",;")
    right = trimmed(F.expr("substring(canonical_text, instr(lower(canonical_text), connector) + length(connector))"), ",;")
    subject = F.coalesce("subject_text", F.lit(""))
    full = F.when(F.startswith(F.lower("right"), F.lower(subject)) & F.col("subject_text").isNotNull(), F.col("right")).otherwise(F.concat(F.when(subject != "", F.concat(subject, F.lit(" "))).otherwise(""), F.col("right")))
    by_text = F.array(F.struct(F.lit(0).alias("k"), F.col("left").alias("object_text"), F.col("left").alias("canonical_text")), F.struct(F.lit(1).alias("k"), F.col("right").alias("object_text"), full.alias("canonical_text")))
    rows = rows.withColumns({"fragments": fragments, "left": left, "right": right, "in_object": F.coalesce(obj.contains(c), F.lit(False))})
    open_ = F.col("reason").isNull() & c.isNotNull()
    short = open_ & ~F.col("in_object") & ((F.length("left") < MIN_FRAGMENT) | (F.length("right") < MIN_FRAGMENT))
    rows = _reject(rows, (short, "compound_claim", F.concat(F.lit('cannot split "'), F.col("canonical_text"), F.lit('" on "'), F.trim(c), F.lit('"'))))
    open_ = F.col("reason").isNull() & c.isNotNull()
    kind = "array<struct<k:int,object_text:string,canonical_text:string>>"
    pieces = F.when(open_ & F.col("in_object") & (F.size("fragments") >= 2), by_object.cast(kind)).when(open_ & ~F.col("in_object"), by_text.cast(kind)).otherwise(F.array(F.struct(F.lit(-1).alias("k"), F.col("object_text"), F.col("canonical_text"))).cast(kind))
    rows = rows.withColumn("piece", F.explode(pieces)).drop("connector", "fragments", "left", "right", "in_object")
    k = F.col("piece.k")
    return rows.withColumns({"id": F.when(k >= 0, F.concat("id", F.lit("_split"), k.cast("string"))).otherwise(F.col("id")), "part": F.greatest(k, F.lit(0)), "object_text": F.col("piece.object_text"), "canonical_text": F.col("piece.canonical_text")}).drop("piece")


def entity_references(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Subject, and object if it names one, must be entities of the claim's window."""
    known = entities.select("window_id", "id").distinct()
    subject = known.select("window_id", F.col("id").alias("subject_entity_id"), F.lit(True).alias("has_subject"))
    object_ = known.select("window_id", F.col("id").alias("object_entity_id"), F.lit(True).alias("has_object"))
    rows = rows.join(subject, ["window_id", "subject_entity_id"], "left").join(object_, ["window_id", "object_entity_id"], "left")
    lost = lambda c: F.concat(F.lit(f'{c} "'), F.coalesce(c, F.lit("")), F.lit('" is no entity'))
    return _reject(rows, (F.col("has_subject").isNull(), "dangling_entity", lost("subject_entity_id")), (F.col("object_entity_id").isNotNull() & F.col("has_object").isNull(), "dangling_entity", lost("object_entity_id"))).drop("has_subject", "has_object")


def inferences(rows: DataFrame) -> DataFrame:
    weak = (F.col("explicitness") == "inferred") & (F.col("extraction_confidence") < MIN_INFERENCE)
    return _reject(rows, (weak, "low_confidence_inference", F.concat(F.lit("inferred with confidence "), F.col("extraction_confidence").cast("string"))))


def validate(claims: DataFrame, entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All stages; valid claims have a null reason."""
    rows = atomic(vague(duplicates(temporal(pronouns(start(claims))), known)))
    return inferences(entity_references(rows, entities))


def confidence() -> Column:
    """Weighted confidence of a claim, in the order of the weights."""
    said = F.coalesce(*[F.when(F.col("explicitness") == k, F.lit(v)) for k, v in phrases.EXPLICITNESS.items()])
    parts = {"explicitness": said, "support": F.least(F.col("support_count").cast("double") / 5, F.lit(1.0))}
    return reduce(Column.__add__, [F.lit(w) * (parts[c] if c in parts else F.col(c)) for c, w in phrases.CONFIDENCE.items()])
