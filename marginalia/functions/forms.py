"""Attribute values as JSON text: their types, how they are shown, changed and named; objects as JSON; prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType


def _text(raw: Column) -> Column:
    """What a JSON string says; null for other values."""
    return F.when(raw.rlike('^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))


def is_date(c: Column) -> Column:
    """Begins as a date does, or can be read as a time."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False)) | F.try_to_timestamp(c).isNotNull()


def kind_of(raw: Column) -> Column:
    """The type as a form would show it."""
    s = _text(raw)
    return (
        F.when(raw.isin("true", "false"), "Boolean")
        .when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "Number")
        .when(raw.startswith("["), "List")
        .when(F.get_json_object(raw, "$.current").isNotNull(), "ProgressBar")
        .when(F.get_json_object(raw, "$.strength").isNotNull(), "StatBlock")
        .when(is_date(s), "Date")
        .when(s.rlike("^https?://"), "URL")
        .otherwise("Text")
    )


def shown(raw: Column, kind: Column) -> Column:
    """A value as one line of text."""
    part = lambda path, other: F.coalesce(F.nullif(F.get_json_object(raw, path), F.lit("0")), F.lit(other))
    return (
        F.when(raw.isNull() | (raw == "null"), "")
        .when(kind == "List", F.array_join(F.from_json(raw, "array<string>"), ", "))
        .when(kind == "ProgressBar", F.concat(part("$.current", "0"), F.lit("/"), part("$.maximum", "100")))
        .when(kind == "StatBlock", F.concat(F.lit("STR:"), part("$.strength", "10")))
        .when(kind == "EntityLink", part("$.label", "No link"))
        .otherwise(F.coalesce(_text(raw), raw))
    )


def summary(raw: Column, kind: Column) -> Column:
    """The short form of a card: True or False, how many items, objects as their JSON."""
    return (
        F.when(kind == "Boolean", F.initcap(raw))
        .when(kind == "List", F.concat(F.size(F.from_json(raw, "array<string>")).cast("string"), F.lit(" items")))
        .otherwise(F.coalesce(_text(raw), raw))
    )


def attributes(raw: Column) -> Column:
    """Attributes kept as text to a map: an object's members, other text under `text`; lists and nothing to no members."""
    none = F.expr("cast(map() as map<string, string>)")
    whole = F.from_json(raw, "map<string, string>")
    broken = ~raw.rlike(r"^\s*[\[{]")
    return F.when(raw.isNull() | raw.rlike(r"^\s*\["), none).when(broken, F.create_map(F.lit("text"), raw)).otherwise(F.coalesce(whole, F.create_map(F.lit("text"), raw)))


def with_key(m: Column, key: Column, value: Column) -> Column:
    """A map with a trimmed, non-blank key added or replaced."""
    k = F.trim(key)
    return F.when(k == "", m).otherwise(F.map_concat(F.map_filter(m, lambda a, _: a != k), F.map_from_arrays(F.array(k), F.array(value))))


def without_key(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda a, _: a != key)


def appended(a: Column, item: Column) -> Column:
    """A list with a trimmed item at its end, unless that is blank."""
    return F.when(F.trim(item) == "", a).otherwise(F.array_append(a, F.trim(item)))


def without_index(a: Column, index: Column) -> Column:
    return F.filter(a, lambda _, i: i != index)


def highest(stats: Column) -> Column:
    """The names of a map of numbers that have its largest value, sorted."""
    top = F.array_max(F.map_values(stats))
    return F.array_sort(F.map_keys(F.map_filter(stats, lambda _, v: v == top)))


def section(kind: Column, layout: str) -> Column:
    """Where a layout puts an attribute of a type."""
    if layout == "character":
        return F.when(kind == "StatBlock", "stats").when(kind == "ProgressBar", "bars").otherwise("rest")
    if layout == "faction":
        return F.when(kind == "Relationship", "relations").when(kind == "ProgressBar", "bars").when(kind.isin("Text", "Number", "Boolean"), "facts").when(kind == "List", "lists")
    raise ValueError(f"no layout {layout}")


def percent(current: Column, maximum: Column) -> tuple[Column, Column]:
    """Whole percent of a bar and its colour band."""
    p = F.round(F.try_divide(current.cast("double"), maximum.cast("double")) * 100).cast("int")
    return p, F.when(p > 66, "green").when(p > 33, "yellow").otherwise("red")


def snake(key: str) -> str:
    return re.sub("[A-Z]", lambda m: f"_{m[0].lower()}", key)


def camel(key: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), key)


def renamed_type(kind: DataType, name, aliases: dict[str, str]) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(name(aliases.get(f.name, f.name)), renamed_type(f.dataType, name, aliases), f.nullable) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(renamed_type(kind.elementType, name, aliases), kind.containsNull)
    return kind


def renamed(df: DataFrame, name=snake, aliases: dict[str, str] | None = None) -> DataFrame:
    """Columns, and fields of structs and of lists of structs in them, under other names: a change of schema alone."""
    kind = renamed_type(df.schema, name, aliases or {})
    return df.select(*[F.col(f"`{f.name}`").cast(g.dataType).alias(g.name) for f, g in zip(df.schema.fields, kind.fields, strict=True)])


def serialised(df: DataFrame, namespace: list[str], secrets: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """(json): each row as a constructor call, keys in snake case, and columns that are secrets as a reference to their
    names, never their values. A row of secrets alone is one too."""
    hidden = {c: F.struct(F.lit(1).alias("ns"), F.lit("secret").alias("type"), F.array(F.lit(n)).alias("id")) for c, n in (secrets or {}).items()}
    safe = df.select(*[F.when(F.col(c).isNotNull(), hidden[c]).alias(c) if c in hidden else F.col(c) for c in df.columns])
    kwargs = renamed(safe, snake, aliases)
    return kwargs.select(F.to_json(F.struct(F.lit(1).alias("ns"), F.lit("constructor").alias("type"), F.array(*[F.lit(x) for x in namespace]).alias("id"), F.struct(*kwargs.columns).alias("kwargs"))).alias("json"))


# Prompts for models that a provider calls; {text} and {command} are filled in.
PROMPTS = {
    "entities": "Mark the named entities of this text in the BIO scheme with the labels {labels}. Give value, type, start, end and confidence of each.\n\nText: {text}",
    "knowledge": "Give the entities of this text and the triples (subject, predicate, object) that it states, as JSON with the lists entities and triples.\n\nText: {text}",
    "continue": "Go on from the end of this text in at most 200 characters of whole sentences: {text}",
    "improve": "Improve this text in at most 200 characters of whole sentences: {text}",
    "shorter": "Shorten this text: {text}",
    "longer": "Lengthen this text: {text}",
    "fix": "Correct grammar and spelling of this text in at most 200 characters of whole sentences: {text}",
    "zap": "Change this text as the command says. Command: {command}\nText: {text}",
}


def prompt(kind: str, text: Column, command: Column | None = None, labels: list[str] | None = None) -> Column:
    parts = re.split(r"(\{\w+\})", PROMPTS[kind])
    values = {"{text}": text, "{command}": F.lit("") if command is None else command, "{labels}": F.lit(", ".join(labels or []))}
    return F.concat(*[values.get(x, F.lit(x)) for x in parts if x])
