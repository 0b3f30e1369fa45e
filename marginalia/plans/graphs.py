"""Queries of property graphs and of knowledge-graph post-processing, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import knowledge as N
from ..sources.tables import table


def _vertices(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    o = table(spark, d, "orders")
    return (
        n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("folder").alias("type"), F.col("n_name").alias("label"))
        .union(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("note"), F.col("c_name")))
        .union(o.select("o_orderpriority").distinct().select(F.concat(F.lit("t"), F.substring("o_orderpriority", 1, 1)), F.lit("tag"), F.col("o_orderpriority")))
    )


def _edges(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    inside = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("target"), F.lit("contains").alias("type"))
    return inside.union(o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("t"), F.substring("o_orderpriority", 1, 1)), F.lit("mentions")).distinct())


def graph_vertices(spark, d):
    return _vertices(spark, d)


def graph_edges(spark, d):
    return _edges(spark, d)


def graph_metadata(spark, d):
    return G.metadata(_vertices(spark, d), _edges(spark, d))


def connected_edges(spark, d):
    return G.touching(_edges(spark, d), _vertices(spark, d).where("id in ('c1', 'c2', 'n3', 't5')").select("id"))


def parents_children(spark, d):
    """Of every vertex the number of its parents and children and the smallest of each, by type of edge."""
    e = _edges(spark, d)
    up = G.parents(e).groupBy("id", "type").agg(F.count(F.lit(1)).alias("parents"), F.min("parent").alias("first_parent"))
    down = G.children(e).groupBy("id", "type").agg(F.count(F.lit(1)).alias("children"), F.min("child").alias("first_child"))
    both = up.join(down, ["id", "type"], "full_outer")
    return both.select("id", "type", F.coalesce("parents", F.lit(0)).alias("parents"), "first_parent", F.coalesce("children", F.lit(0)).alias("children"), "first_child")


def wiki_link_join(spark, d):
    """Customers linked with the first nation of their nation's name."""
    links = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("title"))
    targets = table(spark, d, "nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("target"))
    return G.first_match(links, targets, "title", "target").select("c_custkey", "target")


def _parts(spark, d):
    """Every part with its suppliers, and with the next part by key; the last leads to the first (keys have no gaps)."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).distinct()
    part = table(spark, d, "part")
    low, n = part.agg(F.min("p_partkey"), F.count(F.lit(1))).first()
    after = (F.col("p_partkey") - F.lit(low) + 1) % F.lit(n) + F.lit(low)
    near = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"), F.concat(F.lit("p"), after.cast("string")).alias("target"))
    return li.union(near)


def degree(spark, d):
    return G.degree(_parts(spark, d))


def common_neighbor_ratio(spark, d):
    return G.common_ratio(_parts(spark, d)).select("a", "b", F.round("ratio", 6).alias("ratio"))


def _rank(spark, d, n):
    e = _parts(spark, d)
    v = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return G.pagerank(v, e, 0.85, n)


def pagerank_fixed(spark, d):
    return _rank(spark, d, 4).select("id", F.round("rank", 8).alias("rank"))


def influential_notes(spark, d):
    """Vertices of the part kind with a rank above a share of the mean, 1 / n: what 0.008 is among 71 vertices."""
    r = _rank(spark, d, 4)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("n", n.scalar()).where("id like 'p%' and rank >= 0.568D / n").select("id", F.round("rank", 8).alias("rank"))


def shortest_path(spark, d):
    return G.shortest_paths(_parts(spark, d), "p1").select("id", "depth")


def betweenness(spark, d):
    return G.centralities(_parts(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


def closeness(spark, d):
    return G.closenesses(_parts(spark, d)).select("id", F.round("closeness", 6).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))


def closeness_sketched(spark, d):
    """Closeness of every vertex by counting sketches of the balls around it."""
    return G.sketched_closeness(_parts(spark, d)).select("id", F.round("closeness", 8).alias("closeness"), F.round("harmonic", 4).alias("harmonic"))


def type_communities(spark, d):
    return _vertices(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def structural_clusters(spark, d):
    e = _parts(spark, d)
    return G.structural_clusters(e.select(F.col("source").alias("id")), e, 0.1).select("cluster", "id")


def _entities(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("user_id").alias("note_id"), F.concat(F.lit("v"), k.cast("string")).alias("value"), F.when(k % 11 == 0, "").otherwise(F.col("event_type")).alias("type"), (k % 40).alias("start"), (k % 40 + k % 5).alias("end"), (k % 10 / 9).alias("confidence"))


def ner_postprocess(spark, d):
    n = N.ner(_entities(spark, d), "note_id", F.lit(42), 0.5, "event_id")
    return n.select("note_id", "value", "type", "start", "end", F.round("confidence", 6).alias("confidence"))


def entity_type_counts(spark, d):
    return N.ner(_entities(spark, d), "note_id", F.lit(42), 0.5, "event_id").groupBy("note_id", "type").agg(F.count(F.lit(1)).alias("n"))


def _raw(spark, d):
    """Canned model output as JSON: some good, some without a predicate, some broken, some a bare array."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    good = F.format_string('{"entities":[{"value":"a%s","type":"T1","confidence":0},{"value":"","type":"T2"},{"value":"b%s","type":"T2","confidence":0.25}],"triples":[{"subject":"a%s","predicate":"knows","object":"b%s"},{"subject":"a%s","object":"c"}]}', k, k, k, k, k)
    bare = F.format_string('[{"value":"z%s","type":"T3"}]', k)
    return e.select(F.col("event_id").alias("note_id"), F.when(F.col("event_id") % 70 == 0, "{oops").when(F.col("event_id") % 30 == 0, bare).otherwise(good).alias("json"))


def text_checks(spark, d):
    """Why texts are not fit for entity search: each document's first words by its number, and its whole text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 4
    short = F.when(k == 0, F.lit("  ")).when(k == 1, F.element_at(F.split("text", " "), 1)).when(k == 2, F.lit("antidisestablishmentarianism")).otherwise(F.col("text"))
    return docs.select("doc_id", N.checked_text(short).alias("reason"), N.checked_text(F.col("text")).alias("whole"))


def kg_process(spark, d):
    return N.processed(_raw(spark, d), "note_id", "json").select("note_id", F.size("entities").alias("entities"), F.size("triples").alias("triples"), F.array_join(F.transform("entities", lambda x: F.concat_ws("|", x["value"], x["type"], F.round(x["confidence"], 3).cast("string"))), ",").alias("listed"))


def fact_sheet(spark, d):
    return N.fact_sheet(N.processed(_raw(spark, d), "note_id", "json"), "note_id", "a1")


QUERIES = {f.__name__: f for f in (graph_vertices, graph_edges, graph_metadata, connected_edges, parents_children, wiki_link_join, degree, common_neighbor_ratio, pagerank_fixed, influential_notes, shortest_path, betweenness, closeness, closeness_sketched, type_communities, structural_clusters, ner_postprocess, entity_type_counts, text_checks, kg_process, fact_sheet)}

_VX = "vx as (select 'n' || n_nationkey as id, 'folder' as type, n_name as label from nation union all select 'c' || c_custkey, 'note', c_name from customer union all select distinct 't' || o_orderpriority[1], 'tag', o_orderpriority from orders)"
_EX = "ex as (select 'n' || c_nationkey as source, 'c' || c_custkey as target, 'contains' as type from customer union all select distinct 'c' || o_custkey, 't' || o_orderpriority[1], 'mentions' from orders)"
_PE = "pe as (select distinct 'p' || l_partkey as source, 's' || l_suppkey as target from lineitem union all select 'p' || p_partkey, 'p' || ((p_partkey - (select min(p_partkey) from part) + 1) % (select count(*) from part) + (select min(p_partkey) from part)) from part)"
_UN = "un as (select source, target from pe where source <> target union select target, source from pe where source <> target)"


def _rank_sql(n: int) -> str:
    out = f"with {_PE}, vs as (select source as id from pe union select target from pe), n as (select count(*) as n from vs), deg as (select source, count(*) as d from pe group by 1), r0 as (select id, cast(1 as double) / n as rank from vs, n)"
    for i in range(1, n + 1):
        out += f", l{i} as (select coalesce(sum(rank), 0) as l from r{i - 1} where id not in (select source from deg)), g{i} as (select pe.target as id, sum(rank / d) as g from r{i - 1} r join pe on r.id = pe.source join deg on deg.source = pe.source group by 1), r{i} as (select vs.id, 0.15 / n + 0.85 * (coalesce(g, 0) + l / n) as rank from vs left join g{i} using (id), n, l{i})"
    return out


_NER = "e as (select event_id, user_id as note_id, cast(json_extract(props, '$.k') as integer) as k, event_type from events), f as (select event_id, note_id, 'v' || k as value, case when k % 11 = 0 then '' else event_type end as type, k % 40 as start, k % 40 + k % 5 as \"end\", k % 10 / 9.0 as confidence from e), g as (select *, row_number() over (partition by note_id, value, type, start, \"end\" order by event_id) as r from f where value <> '' and type <> '' and start >= 0 and \"end\" <= 42 and start < \"end\" and confidence between 0 and 1), h as (select * from g where r = 1 and confidence > 0 and confidence >= 0.5)"



def _checked_sql(t: str) -> str:
    return f"case when length(trim({t})) = 0 then 'empty' when length(trim({t})) < 10 then 'short' when len(regexp_extract_all({t}, '\\w+')) < 3 then 'few words' end"


ORACLE_SQL = {
    "graph_vertices": f"with {_VX} select * from vx",
    "graph_edges": f"with {_EX} select * from ex",
    "graph_metadata": f"with {_VX}, {_EX} select 'vertex' as kind, type, count(*) as n from vx group by 2 union all select 'edge', type, count(*) from ex group by 2",
    "connected_edges": f"with {_EX} select distinct * from ex where source in ('c1', 'c2', 'n3', 't5') or target in ('c1', 'c2', 'n3', 't5')",
    "parents_children": f"with {_EX}, up as (select target as id, type, count(*) as parents, min(source) as first_parent from ex group by 1, 2), down as (select source as id, type, count(*) as children, min(target) as first_child from ex group by 1, 2) select coalesce(up.id, down.id) as id, coalesce(up.type, down.type) as type, coalesce(parents, 0) as parents, first_parent, coalesce(children, 0) as children, first_child from up full join down on up.id = down.id and up.type = down.type",
    "wiki_link_join": "with t as (select n_name, min(n_nationkey) as target from nation group by 1) select c_custkey, target from customer join nation n on c_nationkey = n.n_nationkey join t on t.n_name = n.n_name",
    "degree": f"with {_PE} select id, count(*) as degree from (select source as id from pe where source <> target union all select target from pe where source <> target) group by id",
    "common_neighbor_ratio": f"with {_PE}, {_UN}, d as (select source, count(*) as d from un group by 1), c as (select a.source as a, b.source as b, count(*) as c from un a join un b on a.target = b.target group by 1, 2) select un.source as a, un.target as b, round(coalesce(c, 0) / cast(greatest(da.d, db.d) as double), 6) as ratio from un left join c on c.a = un.source and c.b = un.target join d da on da.source = un.source join d db on db.source = un.target where un.source < un.target",
    "pagerank_fixed": f"{_rank_sql(4)} select id, round(rank, 8) as rank from r4",
    "influential_notes": f"{_rank_sql(4)} select id, round(rank, 8) as rank from r4, n where id like 'p%' and rank >= 0.568 / n",
    "shortest_path": f"with recursive {_PE}, {_UN}, t(id, depth) as (select 'p1', 0 union select un.target, t.depth + 1 from t join un on t.id = un.source where t.depth < 8) select id, min(depth) as depth from t group by id",
    "type_communities": f"with {_VX} select type, count(*) as n, min(id) as first, max(id) as last from vx group by 1",
    "ner_postprocess": f"with {_NER} select note_id, value, type, start, \"end\", round(cast(confidence as double), 6) as confidence from h",
    "entity_type_counts": f"with {_NER} select note_id, type, count(*) as n from h group by 1, 2",
    "text_checks": f"with t as (select doc_id, coalesce(text, '') as text from documents), s as (select *, case doc_id % 4 when 0 then '  ' when 1 then string_split(text, ' ')[1] when 2 then 'antidisestablishmentarianism' else text end as short from t) select doc_id, {_checked_sql('short')} as reason, {_checked_sql('text')} as whole from s",
    "kg_process": "with e as (select event_id as note_id, json_extract_string(props, '$.k') as k, case when event_id % 70 = 0 then 0 when event_id % 30 = 0 then 1 else 2 end as kind from events) select note_id, cast(kind as integer) as entities, cast(case when kind = 2 then 1 else 0 end as integer) as triples, case kind when 0 then '' when 1 then 'z' || k || '|T3|0.8' else 'a' || k || '|T1|0.8,b' || k || '|T2|0.25' end as listed from e",
    "fact_sheet": "select event_id as note_id, 'subject' as role, 'knows' as predicate, 'b1' as other from events where json_extract_string(props, '$.k') = '1' and event_id % 70 <> 0 and event_id % 30 <> 0",
}
