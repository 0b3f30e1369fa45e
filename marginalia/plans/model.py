"""Queries of the collection's graph model, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import knowledge as N
from ..operators import model as M
from ..sources.tables import folders, forest, table
from .graphs import _parts
from .graphs import _vertices as _kinds


def _notes(spark, d):
    """Documents as notes titled `note 7`, whose texts end with links, cross links, a tag and a mention."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.col("doc_id")
    tail = F.concat(F.lit(" [[note "), (k * 7 % n).cast("string"), F.lit("]] [[nowhere]] <<note "), (k * 3 % n).cast("string"), F.lit(">> <<note "), k.cast("string"), F.lit(">> #"), "lang", F.lit(" @"), "source")
    return docs.select(k.cast("string").alias("id"), F.concat(F.lit("note "), k.cast("string")).alias("title"), F.concat("text", tail).alias("content"), F.col("source").alias("parent_id"), "lang")


def _kg(spark, d, every=3):
    """Canned model output for every third note, or for all: two entities (one without a confidence) and a triple."""
    k = F.col("doc_id").cast("string")
    raw = F.format_string('{"entities":[{"id":"e%sa","value":"%s","type":"ORG","confidence":0},{"id":"e%sb","value":"%s","type":"LANG","confidence":0.5}],"triples":[{"subject":"e%sa","predicate":"speaks","object":"e%sb"}]}', k, F.col("source"), k, F.col("lang"), k, k)
    return N.processed(table(spark, d, "documents").where(f"doc_id % {every} = 0").select(k.alias("id"), raw.alias("json")), "id", "json")


def _full(spark, d):
    return M.full_notes(_notes(spark, d), _kg(spark, d))


def note_connections(spark, d):
    c = M.connections(_notes(spark, d))
    return c.select("id", *[F.sha2(F.concat_ws("|", x), 256).alias(x) for x in ("tags", "mentions", "links", "crosses")])


def crosslinks(spark, d):
    return M.backlinks(_notes(spark, d))


def note_counters(spark, d):
    """What a note's panel counts: its entities, and the notes with a cross link to it."""
    n = _notes(spark, d)
    b = M.backlinks(n).groupBy("id").agg(F.count(F.lit(1)).alias("crosslinks"))
    return n.select("id").join(_kg(spark, d).select("id", F.size("entities").alias("entities")), "id", "left").join(b, "id", "left").select("id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("crosslinks", F.lit(0)).alias("crosslinks"))


def system_vertices(spark, d):
    return M.vertices(folders(table(spark, d, "documents")), _full(spark, d))


def system_edges(spark, d):
    return M.edges(_full(spark, d))


def note_graph(spark, d):
    v, e = M.note_graph(_full(spark, d), "6")
    return v.select(F.lit("vertex").alias("kind"), "id", "type", "label").union(e.select(F.lit("edge"), F.concat_ws(" > ", "source", "target"), "type", "label"))


def graph_export(spark, d):
    """The graph of folders, notes and contained entities written as JSON lines and read again."""
    v = M.vertices(folders(table(spark, d, "documents")), _full(spark, d)).where("type <> 'tag'")
    e = M.edges(_full(spark, d)).where("type = 'contains'")
    lines = spark.read.text(M.exported(v, e, "graph")).select("part", *[F.get_json_object("value", f"$.data.{x}").alias(x) for x in ("id", "source", "target", "type", "label")])
    return lines


def _forest(spark, d):
    return forest(*(table(spark, d, t) for t in ("region", "nation", "customer", "supplier")))


def move_node(spark, d):
    """Two nations go to region r4; r1 can't go below its own nation."""
    once = M.moved(_forest(spark, d), ["n1", "n2"], "r4")
    return M.moved(once, ["r1"], "n6")


def subtree_graph(spark, d):
    v, e = M.subtree(_forest(spark, d), "id in ('r1', 'n0')")
    return v.select(F.lit(None).cast("string").alias("source"), F.col("id").alias("target"), "depth").union(e.select("source", "target", F.lit(None).cast("int")))


def related_entities(spark, d):
    return M.related(_kg(spark, d, 1))


def entities_by_type(spark, d):
    """The distinct values of each type of all entities, with how many entities have them, in order."""
    e = _kg(spark, d, 1).select(F.explode("entities").alias("e"))
    return e.groupBy(F.col("e.type").alias("type"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("type", "value")


def entity_filter(spark, d):
    """Entities whose value or type has the words asked for, in any case."""
    e = _kg(spark, d, 1).select("id", F.explode("entities").alias("e")).select("id", F.col("e.value").alias("label"), F.col("e.type").alias("kind"))
    q = F.lit("Or".lower())
    return e.where(F.contains(F.lower("label"), q) | F.contains(F.lower("kind"), q))


def promoted_entities(spark, d):
    """Tags as CONCEPT and mentions as MENTION entities."""
    c = M.connections(_notes(spark, d))
    t = F.transform("tags", lambda x: F.struct(F.lit("CONCEPT").alias("kind"), x.alias("label")))
    m = F.transform("mentions", lambda x: F.struct(F.lit("MENTION").alias("kind"), x.alias("label")))
    return c.select("id", F.inline(F.concat(t, m)))


def _model_rank(spark, d):
    v, e = system_vertices(spark, d), system_edges(spark, d)
    ends = v.select("id").union(e.select("source")).union(e.select("target")).distinct()
    return G.pagerank(ends, e.select("source", "target").distinct(), 0.85, 3)


def central_nodes(spark, d):
    r = _model_rank(spark, d).select("id", F.round("rank", 8).alias("rank"))
    return r.orderBy(F.desc("rank"), "id").limit(20)


def influential_in_folder(spark, d):
    """Notes of one folder whose rank is at least the mean."""
    r = _model_rank(spark, d)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    v = system_vertices(spark, d).where("type = 'note' and parent = 'src1'").select("id")
    return r.withColumn("n", n.scalar()).where("round(rank * n, 6) >= 1").join(v, "id").select("id", F.round("rank", 8).alias("rank"))


def shortest_path_nodes(spark, d):
    return G.path_nodes(G.shortest_paths(_parts(spark, d), "p1"), "p100")


def centrality_report(spark, d):
    """Degree, rank, betweenness and closeness over regions, nations, customers and suppliers; the twenty of highest rank."""
    e = _forest(spark, d).where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"))
    v = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    c = G.centralities(e).join(G.pagerank(v, e, 0.85, 10), "id").join(G.degree(e), "id")
    r = c.select("id", "degree", F.round("rank", 8).alias("rank"), F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 8).alias("closeness"))
    return r.orderBy(F.desc("rank"), "id").limit(20)


def communities(spark, d):
    """Groups by type, and then those by structure."""
    e = _parts(spark, d)
    by_type = _kinds(spark, d).select(F.concat(F.lit("type-"), "type").alias("community"), "id")
    return by_type.union(G.structural_clusters(e.select(F.col("source").alias("id")), e, 0.1).select(F.concat(F.lit("cluster-"), "cluster"), "id"))


QUERIES = {f.__name__: f for f in (note_connections, crosslinks, note_counters, system_vertices, system_edges, note_graph, graph_export, move_node, subtree_graph, related_entities, entities_by_type, entity_filter, promoted_entities, central_nodes, influential_in_folder, shortest_path_nodes, centrality_report, communities)}

from .graphs import _PE, _UN  # noqa: E402
from .store import _FOREST, _down  # noqa: E402

_N = """k as (select count(*) as n from documents), notes as (select cast(doc_id as varchar) as id, 'note ' || doc_id as title, text || ' [[note ' || (doc_id * 7 % n) || ']] [[nowhere]] <<note ' || (doc_id * 3 % n) || '>> <<note ' || doc_id || '>> #' || lang || ' @' || source as content, source as parent_id, doc_id, lang from documents, k),
kg as (select cast(doc_id as varchar) as id, 'e' || doc_id || 'a' as a, source as va, 'e' || doc_id || 'b' as b, lang as vb from documents where doc_id % 3 = 0),
ents as (select id as note, a as id, va as value, 'ORG' as type, cast(0.8 as double) as confidence from kg union all select id, b, vb, 'LANG', 0.5 from kg),
tags as (select distinct id, unnest(regexp_extract_all(content, '#(\\w+)', 1)) as tag from notes),
cross_ as (select n.id, o.id as other, o.title as label from notes o, (select id as oid, unnest(regexp_extract_all(content, '<<([^<>]+)>>', 1)) as t from notes) x join notes n on n.title = x.t where o.id = x.oid and n.id <> o.id),
crosses as (select distinct * from cross_),
lk as (select distinct id, unnest(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1)) as title from notes), firsts as (select title, min(id) as target from notes group by 1),
sv as (select source as id, 'folder' as type, source as label, cast(null as varchar) as parent, cast(null as double) as confidence from documents group by 1 union all select id, 'note', title, parent_id, null from notes union all select id, 'entity', value, note, confidence from ents union all select distinct 'tag-' || tag, 'tag', '#' || tag, null, null from tags),
se as (select note as source, id as target, 'contains' as type, type as label, confidence from ents union all select a, b, 'relates', 'speaks', 0.8 from kg union all select id, 'tag-' || tag, 'mentions', tag, null from tags union all select lk.id, target, 'links', title, null from lk join firsts using (title) union all select id, other, 'references', label, null from crosses)"""


def _model_rank_sql(n: int) -> str:
    out = f"with {_N}, pe as (select distinct source, target from se), vs as (select id from sv union select source from se union select target from se), m as (select count(*) as n from vs), deg as (select source, count(*) as d from pe group by 1), r0 as (select id, cast(1 as double) / m.n as rank from vs, m)"
    for i in range(1, n + 1):
        out += f", l{i} as (select coalesce(sum(rank), 0) as l from r{i - 1} where id not in (select source from deg)), g{i} as (select pe.target as id, sum(rank / d) as g from r{i - 1} r join pe on r.id = pe.source join deg on deg.source = pe.source group by 1), r{i} as (select vs.id, 0.15 / m.n + 0.85 * (coalesce(g, 0) + l / m.n) as rank from vs left join g{i} using (id), m, l{i})"
    return out


def _once(column: str, pattern: str) -> str:
    """Matches once each, in the order of their first places, joined."""
    found = f"regexp_extract_all({column}, '{pattern}', 1)"
    return f"sha256(array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), '|'))"


_EVERY = _N.replace(" where doc_id % 3 = 0", "")

ORACLE_SQL = {
    "note_connections": f"with {_N} select id, {_once('content', '#(\\w+)')} as tags, {_once('content', '@(\\w+)')} as mentions, {_once('content', '\\[\\[([^\\]]+)\\]\\]')} as links, {_once('content', '<<([^<>]+)>>')} as crosses from notes",
    "crosslinks": f"with {_N} select n.id, o.id as other, o.title as label from notes n join notes o on n.id <> o.id and contains(o.content, '<<' || n.title || '>>')",
    "note_counters": f"with {_N}, c as (select id, count(*) as c from crosses group by 1) select notes.id, case when doc_id % 3 = 0 then 2 else 0 end as entities, coalesce(c, 0) as crosslinks from notes left join c using (id)",
    "system_vertices": f"with {_N} select * from sv",
    "system_edges": f"with {_N} select * from se",
    "note_graph": f"with {_N} select 'vertex' as kind, id, type, label from sv where id = '6' or parent = '6' or (type = 'tag' and id in (select 'tag-' || tag from tags where id = '6')) union all select 'edge', source || ' > ' || target, type, label from se where (source = '6' or source = 'e6a') and type in ('contains', 'relates', 'mentions')",
    "graph_export": f"with {_N} select 'nodes' as part, id, cast(null as varchar) as source, cast(null as varchar) as target, type, label from sv where type <> 'tag' union all select 'edges', null, source, target, type, label from se where type = 'contains'",
    "move_node": f"with {_FOREST} select id, case when id in ('n1', 'n2') then 'r4' else parent_id end as parent_id from f",
    "subtree_graph": f"{_down("id in ('r1', 'n0')")}, v as (select id, min(depth) as depth from t group by 1) select cast(null as varchar) as source, id as target, depth from v union all select parent_id, id, null from f where parent_id in (select id from v) and id in (select id from v)",
    "related_entities": f"with {_EVERY} select id, a as entity, b as related from kg union all select id, b, a from kg",
    "entities_by_type": f"with {_EVERY} select type, value, count(*) as n from ents group by 1, 2",
    "entity_filter": f"with {_EVERY} select note as id, value as label, type as kind from ents where contains(lower(value), 'or') or contains(lower(type), 'or')",
    "promoted_entities": f"with {_N} select id, 'CONCEPT' as kind, tag as label from tags union all select distinct id, 'MENTION', unnest(regexp_extract_all(content, '@(\\w+)', 1)) from notes",
    "central_nodes": f"{_model_rank_sql(3)} select id, round(rank, 8) as rank from r3 order by round(rank, 8) desc, id limit 20",
    "influential_in_folder": f"{_model_rank_sql(3)} select r3.id, round(rank, 8) as rank from r3 join sv on sv.id = r3.id and sv.type = 'note' and sv.parent = 'src1', m where round(rank * m.n, 6) >= 1",
    "shortest_path_nodes": f"with recursive {_PE}, {_UN}, t(id, depth) as (select 'p1', 0 union select un.target, t.depth + 1 from t join un on t.id = un.source where t.depth < 8), b as (select id, min(depth) as depth from t group by id), up as (select b.id, b.depth, min(un.source) as parent from b left join un on un.target = b.id and exists (select 1 from b c where c.id = un.source and c.depth = b.depth - 1) group by 1, 2), w(step, id, parent) as (select depth, id, parent from up where id = 'p100' union all select up.depth, up.id, up.parent from w join up on up.id = w.parent and w.step > 0) select cast(step as integer) as step, id from w",
}
