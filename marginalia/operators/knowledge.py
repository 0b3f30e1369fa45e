"""Post-processing of entities and triples that models return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, CONFIDENCE = 0.5, 0.8
ENTITY = "struct<id string, value string, type string, confidence double, start int, end int>"
TRIPLE = "struct<subject string, predicate string, object string, confidence double>"


def ner(spans: DataFrame, note: str, length: Column, threshold: float = THRESHOLD, order: str = "start") -> DataFrame:
    """Valid spans, once each (the first), at or above the threshold; a threshold of 0 means the default, and a
    confidence of 0 or none never passes."""
    ok = (F.length("value") > 0) & (F.length("type") > 0) & (F.col("start") >= 0) & (F.col("end") <= length) & (F.col("start") < F.col("end"))
    ok = ok & (F.col("confidence").isNull() | F.col("confidence").between(0, 1))
    first = F.row_number().over(Window.partitionBy(note, "value", "type", "start", "end").orderBy(order))
    once = spans.where(ok).withColumn("__r", first).where("__r = 1").drop("__r")
    return once.where((F.col("confidence") > 0) & (F.col("confidence") >= (threshold or THRESHOLD)))


def processed(raw: DataFrame, note: str, json: str) -> DataFrame:
    """(note, entities, triples) of raw JSON: an object with both lists, or a bare list of entities; what isn't JSON is
    empty. Entities need a value and a type, triples a predicate and both ends; a confidence of 0 or none becomes the
    default, a missing id a hash of value and type."""
    whole = F.from_json(json, f"entities array<{ENTITY}>, triples array<{TRIPLE}>")
    bare = F.from_json(json, f"array<{ENTITY}>")
    entities = F.when(F.ltrim(json).startswith("["), bare).otherwise(whole["entities"])
    valid = F.filter(F.coalesce(entities, F.array()), lambda x: (F.length(x["value"]) > 0) & (F.length(x["type"]) > 0))
    full = F.transform(
        valid,
        lambda x: F.struct(
            F.coalesce(x["id"], F.substring(F.sha2(F.concat_ws(":", x["value"], x["type"]), 256), 1, 16)).alias("id"), x["value"].alias("value"), x["type"].alias("type"), F.coalesce(F.nullif(x["confidence"], F.lit(0.0)), F.lit(CONFIDENCE)).alias("confidence")
        ),
    )
    triples = F.filter(F.coalesce(whole["triples"], F.array()), lambda x: (F.length(x["subject"]) > 0) & (F.length(x["predicate"]) > 0) & (F.length(x["object"]) > 0))
    return raw.select(note, full.alias("entities"), F.coalesce(triples, F.expr(f"cast(array() as array<{TRIPLE}>)")).alias("triples"))


def fact_sheet(graph: DataFrame, note: str, entity: str) -> DataFrame:
    """(note, role, predicate, other) of the triples in which an entity stands, by id or value."""
    ids = F.exists("entities", lambda x: (x["id"] == entity) | (x["value"] == entity))
    t = graph.where(ids).select(note, F.explode("triples").alias("t"))
    a = t.where(F.col("t.subject") == entity).select(note, F.lit("subject").alias("role"), F.col("t.predicate").alias("predicate"), F.col("t.object").alias("other"))
    return a.union(t.where(F.col("t.object") == entity).select(note, F.lit("object"), F.col("t.predicate"), F.col("t.subject"))).distinct()


def checked_text(c: Column) -> Column:
    """Why a text is not fit for entity search, in order: empty, short, few words; null if it is fit."""
    from ..functions import text as T

    return F.when(F.length(F.trim(c)) == 0, "empty").when(F.length(F.trim(c)) < 10, "short").when(T.word_count(c) < 3, "few words").when(T.text_confidence(c) < 0.4, "low confidence")
