"""Command histories, retrying queues, imports of older stores and the registry of attribute kinds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY, RETRIES = 50, 3


class History:
    """A linear history: doing drops what could be redone and, beyond `most`, the oldest."""

    def __init__(self, most: int = HISTORY):
        self.done: list = []
        self.undone: list = []
        self.most = most

    def apply(self, action: str, command) -> None:
        if action == "do":
            self.undone.clear()
            self.done.append(command)
            del self.done[: max(0, len(self.done) - self.most)]
        elif action == "undo" and self.done:
            self.undone.append(self.done.pop())
        elif action == "redo" and self.undone:
            self.done.append(self.undone.pop())


def histories(log: DataFrame, key: str, seq: str, action: Column, most: int = HISTORY) -> DataFrame:
    """(key, undo, redo, last) after all of a key's do, undo and redo rows in order. Rows come sorted by key, so a task
    holds one bounded history at a time, however many rows a key has."""
    kind = dict(log.dtypes)[key]
    given = log.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), action.alias("action")).where("action is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, schema = None, None, [], None

        def told() -> list:
            return [now, len(state.done), len(state.undone), state.done[-1] if state.done else None]

        for batch in batches:
            schema = batch.schema
            for k, s, a in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or k != now:
                    if state is not None:
                        out.append(told())
                    now, state = k, History(most)
                state.apply(a, s)
        if state is not None:
            out.append(told())
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], schema.field("key").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["key", "undo", "redo", "last"])

    ordered = given.repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInArrow(run, f"key {kind}, undo int, redo int, last long").withColumnRenamed("key", key)


def queue_runs(items: DataFrame, key: str, seq: str, rank: Column, fails: Column, retries: int = RETRIES) -> DataFrame:
    """(key, seq, attempt, priority, outcome) of every attempt in a serial queue: items start by priority, first come
    first; one that fails goes to the end one priority lower, up to `retries` times. All of an attempt's number come
    before any of the next, in their first order, so no queue has to be run."""
    rows = items.select(key, seq, rank.alias("rank"), fails.alias("fails"))
    tries = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.least("fails", F.lit(retries)))))
    outcome = F.when(F.col("attempt") == F.col("fails"), "done").when(F.col("attempt") == retries, "dropped").otherwise("again")
    return tries.select(key, seq, "attempt", F.least(F.col("rank") + F.col("attempt"), F.lit(2)).alias("priority"), outcome.alias("outcome"))


def imported(raw: DataFrame, column: str) -> DataFrame:
    """Notes and folders of an older store's JSON: items of other types are left out, missing content is an empty
    document; JSON that can't be read gives nothing."""
    schema = "items array<struct<id string, type string, title string, content string, parentId string>>"
    items = raw.select(F.inline(F.coalesce(F.from_json(column, schema)["items"], F.array())))
    return items.where("type in ('note', 'folder') and id is not null").select("id", "type", "title", F.when(F.col("type") == "note", F.coalesce("content", F.lit("{}"))).otherwise("").alias("content"), F.col("parentId").alias("parent_id"))


# The attributes of each kind of entity, as kind|name|type|default|unit. Links default to no
# entity of a kind; the date of an event defaults to the time of asking.
REGISTRY = """CHARACTER|level|Number|1|
CHARACTER|class|Text||
CHARACTER|race|Text||
CHARACTER|alignment|Text|Neutral|
CHARACTER|health|ProgressBar|{"current":100,"maximum":100}|
CHARACTER|mana|ProgressBar|{"current":50,"maximum":50}|
CHARACTER|stats|StatBlock|{"strength":10,"dexterity":10,"constitution":10,"intelligence":10,"wisdom":10,"charisma":10}|
CHARACTER|background|Text||
CHARACTER|occupation|Text||
CHARACTER|faction|EntityLink|{"id":"","label":"","kind":"FACTION"}|
NPC|role|Text||
NPC|attitude|Text|Neutral|
NPC|importance|Number|5|
NPC|location|EntityLink|{"id":"","label":"","kind":"LOCATION"}|
NPC|faction|EntityLink|{"id":"","label":"","kind":"FACTION"}|
NPC|relationships|List|[]|
NPC|secrets|List|[]|
NPC|goals|Text||
NPC|description|Text||
LOCATION|type|Text||
LOCATION|size|Text|Medium|
LOCATION|population|Number|0|
LOCATION|danger_level|Number|1|
LOCATION|climate|Text||
LOCATION|terrain|Text||
LOCATION|notable_features|List|[]|
LOCATION|resources|List|[]|
LOCATION|controlling_faction|EntityLink|{"id":"","label":"","kind":"FACTION"}|
LOCATION|connected_locations|List|[]|
SCENE|type|Text|Roleplay|
SCENE|difficulty|Number|1|
SCENE|duration|Number|30|minutes
SCENE|location|EntityLink|{"id":"","label":"","kind":"LOCATION"}|
SCENE|participants|List|[]|
SCENE|objectives|List|[]|
SCENE|rewards|List|[]|
SCENE|consequences|Text||
SCENE|mood|Text||
SCENE|tension|Number|5|
ITEM|type|Text|Miscellaneous|
ITEM|rarity|Text|Common|
ITEM|value|Number|0|gold
ITEM|weight|Number|1|lbs
ITEM|magical|Boolean|false|
ITEM|damage|Text||
ITEM|armor_class|Number|0|
ITEM|properties|List|[]|
ITEM|attunement|Boolean|false|
ITEM|owner|EntityLink|{"id":"","label":"","kind":"CHARACTER"}|
ITEM|location|EntityLink|{"id":"","label":"","kind":"LOCATION"}|
FACTION|type|Text|Organization|
FACTION|alignment|Text|Neutral|
FACTION|influence|ProgressBar|{"current":50,"maximum":100}|
FACTION|resources|ProgressBar|{"current":50,"maximum":100}|
FACTION|territory|List|[]|
FACTION|leader|EntityLink|{"id":"","label":"","kind":"NPC"}|
FACTION|goals|List|[]|
FACTION|enemies|List|[]|
FACTION|allies|List|[]|
FACTION|reputation|Number|0|
EVENT|type|Text|Plot|
EVENT|status|Text|Planned|
EVENT|date|Date||
EVENT|location|EntityLink|{"id":"","label":"","kind":"LOCATION"}|
EVENT|participants|List|[]|
EVENT|consequences|List|[]|
EVENT|triggers|List|[]|
EVENT|importance|Number|5|
EVENT|related_events|List|[]|
EVENT|outcome|Text||""".split("\n")


def registry(spark) -> DataFrame:
    rows = [tuple(x.split("|")) for x in REGISTRY]
    return spark.createDataFrame(rows, "kind string, name string, type string, fallback string, unit string")


def with_defaults(values: DataFrame, spark) -> DataFrame:
    """(entity, kind, name, value, origin) of entities' own attributes (entity, kind, name, value), and of those that
    their kind has besides, with the default; attributes that the kind doesn't have are custom."""
    entities = values.select("entity", "kind").distinct()
    wanted = entities.join(F.broadcast(registry(spark)), "kind").select("entity", "kind", "name", "fallback")
    both = values.join(wanted, ["entity", "kind", "name"], "full_outer")
    origin = F.when(F.col("fallback").isNull(), "custom").when(F.col("value").isNull(), "default").otherwise("own")
    return both.select("entity", "kind", "name", F.coalesce("value", "fallback").alias("value"), origin.alias("origin"))
