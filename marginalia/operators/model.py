"""The graph of a collection: folders, notes, their entities and tags as vertices, and the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import shared_dir
from .knowledge import CONFIDENCE
from .trees import descendants

# The kinds of vertices and edges.
VERTICES, EDGES = ("folder", "note", "entity", "tag"), ("contains", "relates", "mentions", "links", "references")
#: A title between the marks of a cross link; titles hold neither of the marks' characters.
CROSS = r"<<([^<>]+)>>"


def connections(notes: DataFrame) -> DataFrame:
    """(id, tags, mentions, links, crosses) of each note's content, once each in the order of their first places."""
    found = {"tags": T.TAG, "mentions": T.MENTION, "links": T.WIKI, "crosses": CROSS}
    return notes.select("id", *[F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias(n) for n, p in found.items()])


def backlinks(notes: DataFrame) -> DataFrame:
    """(id, other, label): the notes `other` whose content has <<title>> of note `id`; its own doesn't count. Titles are
    extracted and joined by equality, so nothing compares every note with every other."""
    said = notes.select(F.col("id").alias("other"), F.col("title").alias("label"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CROSS), F.lit(1)))).alias("title"))
    return notes.select("id", "title").join(said, "title").where("id <> other").select("id", "other", "label")


def full_notes(notes: DataFrame, kg: DataFrame) -> DataFrame:
    """Notes beside their entities and triples, and their connections; those without any have nulls."""
    return notes.join(kg, "id", "left").join(connections(notes), "id", "left")


def vertices(folders: DataFrame, full: DataFrame) -> DataFrame:
    """(id, type, label, parent, confidence). Tags are one vertex each; entities belong to their note, and are not merged."""
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    entity = full.select(F.col("id").alias("parent"), F.explode("entities").alias("e"))
    tags = full.select(F.explode("tags").alias("tag")).distinct()
    return (
        folders.select("id", F.lit("folder").alias("type"), F.col("title").alias("label"), F.col("parent_id").alias("parent"), no_number.alias("confidence"))
        .unionByName(full.select("id", F.lit("note").alias("type"), F.col("title").alias("label"), F.col("parent_id").alias("parent"), no_number.alias("confidence")))
        .unionByName(entity.select(F.col("e.id").alias("id"), F.lit("entity").alias("type"), F.col("e.value").alias("label"), "parent", F.col("e.confidence").alias("confidence")))
        .unionByName(tags.select(F.concat(F.lit("tag-"), "tag").alias("id"), F.lit("tag").alias("type"), F.concat(F.lit("#"), "tag").alias("label"), none.alias("parent"), no_number.alias("confidence")))
    )


def edges(full: DataFrame) -> DataFrame:
    """(source, target, type, label, confidence). A wiki link leads to the first note with its title, by id, or nowhere; a
    reference leads from a note to each note with a cross link to it."""
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    inside = full.select("id", F.explode("entities").alias("e"))
    triples = full.select(F.explode("triples").alias("t"))
    tags = full.select("id", F.explode("tags").alias("tag"))
    links = full.select(F.col("id").alias("source"), F.explode("links").alias("title"))
    first = full.groupBy("title").agg(F.min("id").alias("target"))
    return (
        inside.select(F.col("id").alias("source"), F.col("e.id").alias("target"), F.lit("contains").alias("type"), F.col("e.type").alias("label"), F.col("e.confidence").alias("confidence"))
        .unionByName(triples.select(F.col("t.subject").alias("source"), F.col("t.object").alias("target"), F.lit("relates").alias("type"), F.col("t.predicate").alias("label"), F.coalesce(F.nullif("t.confidence", F.lit(0.0)), F.lit(CONFIDENCE)).alias("confidence")))
        .unionByName(tags.select(F.col("id").alias("source"), F.concat(F.lit("tag-"), "tag").alias("target"), F.lit("mentions").alias("type"), F.col("tag").alias("label"), no_number.alias("confidence")))
        .unionByName(links.join(first, "title").select("source", "target", F.lit("links").alias("type"), F.col("title").alias("label"), no_number.alias("confidence")))
        .unionByName(backlinks(full).select(F.col("id").alias("source"), F.col("other").alias("target"), F.lit("references").alias("type"), "label", no_number.alias("confidence")))
        .withColumn("label", F.coalesce("label", none))
    )


def note_graph(full: DataFrame, note: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of one note alone: itself, its entities, relations and tags."""
    one = full.where(F.col("id") == note)
    kinds = edges(one).where("type in ('contains', 'relates', 'mentions')")
    return vertices(one.limit(0).select("id", "title", "parent_id"), one), kinds


def elements(v: DataFrame, e: DataFrame) -> DataFrame:
    """(part, json) of a graph: an element a line, as an exchange format for graph viewers has them."""
    node = F.to_json(F.struct(F.struct("id", "type", "label", "parent").alias("data")))
    edge = F.to_json(F.struct(F.struct("source", "target", "type", "label").alias("data")))
    return v.select(F.lit("nodes").alias("part"), node.alias("json")).unionByName(e.select(F.lit("edges").alias("part"), edge.alias("json")))


def exported(v: DataFrame, e: DataFrame, name: str) -> str:
    """Writes the elements as JSON lines, a folder each for nodes and edges, and returns where: no row holds the graph."""
    import uuid

    path = f"{shared_dir(v.sparkSession)}/{name}-{uuid.uuid4().hex}"
    elements(v, e).write.partitionBy("part").text(path)
    return path


def moved(nodes: DataFrame, ids: list[str], parent: str | None) -> DataFrame:
    """Nodes with those ids under another parent; one moved under itself, or under what is below it, stays."""
    below = descendants(nodes, F.col("id").isin(ids)).where("depth >= 0")
    into = below.where(F.col("id") == F.lit(parent)).select(F.col("root").alias("id"), F.lit(True).alias("__inside"))
    out = nodes.join(into, "id", "left")
    goes = F.col("id").isin(ids) & F.col("__inside").isNull()
    return out.withColumn("parent_id", F.when(goes, F.lit(parent)).otherwise(F.col("parent_id"))).select(*nodes.columns)


def subtree(nodes: DataFrame, start) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, depth) of the subtrees that start there, and the (source, target) edges from parents within them."""
    found = descendants(nodes, start).groupBy("id").agg(F.min("depth").alias("depth"))
    inside = nodes.where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"))
    within = inside.join(found.select(F.col("id").alias("source")), "source", "left_semi").join(found.select(F.col("id").alias("target")), "target", "left_semi")
    return found, within.select("source", "target")


def related(kg: DataFrame) -> DataFrame:
    """(id, entity, related): for each entity of a note the others that a triple joins it with, by id or by value."""
    t = kg.select("id", "entities", F.explode("triples").alias("t"))
    both = t.select("id", F.col("t.subject").alias("a"), F.col("t.object").alias("b")).union(t.select("id", "t.object", "t.subject"))
    e = kg.select("id", F.explode("entities").alias("e")).select("id", F.col("e.id").alias("eid"), F.col("e.value").alias("value"))
    mine = both.join(e, "id").where("a = eid or a = value").select("id", F.col("eid").alias("entity"), "b")
    other = e.select("id", F.col("eid").alias("related"))
    return mine.join(other, (mine["id"] == other["id"]) & (mine["b"] == other["related"])).where("entity <> related").select(mine["id"], "entity", "related").distinct()
