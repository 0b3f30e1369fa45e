"""Queries of the retrieval life cycle: chunks, nodes, edges, saved indexes and search, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical as L
from ..operators import retrieval as R
from ..operators import vectors as V
from ..sources.tables import table, written

QUESTION = "the work of the people and their time"
COMPARED = 0  # vectors of a block that are compared with another's at once; 0: as many as usual


def _notes(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))


def _doc(spark, d):
    return _notes(spark, d).select("id", "title", "content", T.preprocess(F.concat_ws(" ", "title", "content")).alias("doc"))


def note_chunks(spark, d):
    """Windows over title and text, with how many a note has."""
    c = R.note_chunks(_notes(spark, d))
    return c.select("id", "chunk", "total", "start", "end", F.sha2("text", 256).alias("sha"))


def chunk_kinds(spark, d):
    """How many chunks each note has by each way of cutting."""
    return R.chunk_counts(_notes(spark, d), ("original", "sentences", "basic", "semantic"))


def _nodes(spark, d):
    return written(R.nodes_of(_notes(spark, d), R.Providers().current()), "nodes")


def note_nodes(spark, d):
    """Nodes of all notes: their names, and that each vector has length 1 or none."""
    n = _nodes(spark, d)
    return n.select("node", "note", "title", (F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6)).alias("norm2"))


def note_sequence(spark, d):
    n = _nodes(spark, d).select("note", "chunk", "node")
    return V.sequential_edges(n, "note", "chunk", "node").select("source", "target", "weight")


def node_sync(spark, d):
    """Every second note was indexed before, some of these with another text; one is added, one removed, then all synced."""
    n = _notes(spark, d)
    p = R.Providers().current()
    old = n.where("id % 2 = 0").withColumn("content", F.when(F.col("id") % 6 == 0, F.lit("an older text")).otherwise(F.col("content")))
    nodes = R.nodes_of(old, p)
    nodes = R.added(nodes, n.where("id = 0 or id = 1"), p)
    nodes = R.removed(nodes, spark.createDataFrame([("4",)], "note string"))
    return R.synced(nodes, n.where("id % 5 <> 4"), p).select("node", "note", F.sha2("text", 256).alias("sha"), F.size("vec").alias("dim"))


def _alike(vectors, queries, k):
    """Neighbours above 0.7: all vectors are compared with one another, however many there are."""
    return V.alike(vectors, k, 0.7, block=COMPARED or V.BLOCK)


def semantic_search(spark, d):
    """Ten chunks for a question, by similarity and a walk over the chunks' edges (_alike())."""
    p = R.Providers()
    p.switch("hashing-asymmetric")
    n = _nodes(spark, d)
    e = R.edges_of(n, 0.7, 10, index=_alike, named=False)
    return R.search(n, e, QUESTION, p.current(), 10, 20).select("note", "title", F.sha2("content", 256).alias("sha"), F.round("score", 6).alias("score"))


def search_palette(spark, d):
    return R.searched(_doc(spark, d), "the thing with that").select("id", "title", "preview", F.round("score", 6).alias("score"))


def search_sorted(spark, d):
    """Another order than by score: the first notes that match at all."""
    return R.searched(_doc(spark, d), "the thing with that", 7, sort=[F.col("id").desc()]).select("id", F.round("score", 6).alias("score"))


def blank_search(spark, d):
    """Nothing asked, or nothing there: nothing found, whichever index is asked."""
    c, q = _doc(spark, d), "  "
    index = L.postings(c.select("id", F.col("content").alias("doc")).limit(5))
    none = L.bm25(c, q).select("id").union(L.bm25(c.limit(0), "the").select("id")).union(L.positional_search(index, q).select("id")).union(L.positional_search(index.limit(0), "the").select("id"))
    return none.agg(F.count(F.lit(1)).alias("found"))


def index_lifecycle(spark, d):
    """Three lexical indexes are saved, one again with more in it, one deleted, the store being opened anew each time; what
    is there is loaded and counted."""
    p = written(R.postings(_doc(spark, d)), "postings")  # so that texts are split once
    path = R.IndexStore(spark).path
    R.IndexStore(spark, path).save("all", p.where("id % 2 = 0"))
    R.IndexStore(spark, path).save("odd", p.where("id % 2 = 1"))
    R.IndexStore(spark, path).save("gone", p.where("id % 3 = 1"))
    R.IndexStore(spark, path).save("all", p)
    R.IndexStore(spark, path).delete("gone")
    store = R.IndexStore(spark, path)
    found = []
    for i in ("all", "odd"):
        if (rows := store.load(i)) is not None:
            tokens = rows.select("token").distinct().agg(F.count(F.lit(1)).alias("tokens"))
            docs = rows.groupBy("id").agg(F.sum("tf").alias("words")).agg(F.lit(i).alias("index_id"), F.count("id").alias("docs"), F.sum("words").alias("words"))
            found.append(docs.crossJoin(tokens).select("index_id", "docs", "tokens", "words"))
    return found[0].union(found[1])


def notes_only_index(spark, d):
    """The positional index takes notes with content alone; then two notes are taken out."""
    c = _doc(spark, d).withColumn("type", F.when(F.col("id") % 9 == 0, "folder").otherwise("note")).withColumn("content", F.when(F.col("id") % 10 == 1, F.lit("  ")).otherwise(F.col("content")))
    index = L.postings(c.where("type = 'note' and trim(content) <> ''").select("id", F.col("content").alias("doc")))
    left = index.join(spark.createDataFrame([(2,), (3,)], "id long"), "id", "left_anti")
    return left.groupBy("id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("freq").alias("words"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _near(spark, d):
    near = V.knn(_vectors(spark, d), 4).where("source <> target")
    return near.groupBy(F.col("source").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("near"))


def snapshot_roundtrip(spark, d):
    """Vectors with their neighbours as binary records, saved with a checksum, loaded, verified and read again."""
    nodes = _vectors(spark, d).join(_near(spark, d), "id").select("id", "vec", F.array("near").alias("near"))
    store = R.IndexStore(spark)
    store.save("snapshot", R.packed_nodes(nodes, 64))
    back = R.unpacked_nodes(store.load("snapshot"))
    return back.select("id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.array_join(F.get("near", 0), ",").alias("near"))


def index_json(spark, d):
    """The same as JSON and back."""
    nodes = _vectors(spark, d).join(_near(spark, d), "id").select(F.to_json(F.struct("id", "vec", F.array("near").alias("near"))).alias("json"))
    back = nodes.select(F.from_json("json", "id long, vec array<double>, near array<array<bigint>>").alias("n")).select("n.*")
    return back.select("id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.array_join(F.get("near", 0), ",").alias("near"))


def index_prune(spark, d):
    """Every seventh vector is deleted: it and its places in neighbour lists go."""
    gone = _vectors(spark, d).where("id % 7 = 0").select("id")
    links = _near(spark, d).select("id", F.explode("near").alias("target"))
    left = links.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    alive = _vectors(spark, d).join(gone, "id", "left_anti").select("id")
    return alive.join(left.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("neighbours"))


def index_rebuild(spark, d):
    """Vectors of a wrong dimension are left out, of several with one id the first; a query of another finds nothing."""
    v = _vectors(spark, d).withColumn("vec", F.when(F.col("id") % 8 == 0, F.slice("vec", 1, 10)).otherwise(F.col("vec")))
    v = v.union(v.where("id < 20").withColumn("vec", F.transform("vec", lambda x: x + 100)))
    kept = V.guarded(v, 64)
    return kept.select("id", F.round(F.get("vec", 0), 6).alias("first"))


def knn_adapter(spark, d):
    """The ten nearest as distances."""
    v = _vectors(spark, d)
    return V.knn(v, 10, queries=v.where("id % 20 = 0")).select("source", "target", F.round(1 - F.col("score"), 6).alias("distance"))


def micro_batches(spark, d):
    """Requests in batches of five, in order; the last may be smaller."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return e.groupBy("user_id", F.floor(F.col("n") / 5).alias("batch")).agg(F.count(F.lit(1)).alias("size"), F.min("event_id").alias("first"))


QUERIES = {f.__name__: f for f in (note_chunks, chunk_kinds, note_nodes, note_sequence, node_sync, semantic_search, search_palette, search_sorted, blank_search, index_lifecycle, notes_only_index, snapshot_roundtrip, index_json, index_prune, index_rebuild, knn_adapter, micro_batches)}

from .search import _CORPUS  # noqa: E402
from .vectors import _ALL, _V  # noqa: E402


def windows_sql(source: str, key: str = "id") -> str:
    """CTEs (with recursive) from a table w0 (key, t): w (key, chunk, start, end, text), fixed windows of 500 by 50."""
    return f"""w0 as ({source}), step(k, s, e, n) as (select {key}, cast(0 as bigint), cast(null as bigint), 0 from w0 where length(t) > 0
union all select k, greatest(s + 450, en), en, n + 1 from (select k, s, n, len, case when len <= 500 then len when s + 500 >= len then len when regexp_matches(part, '[. \\n]') and s + length(regexp_extract(part, '(?s)^(.*)[. \\n]', 1)) > s + 350 then s + length(regexp_extract(part, '(?s)^(.*)[. \\n]', 1)) + 1 else s + 500 end as en from (select step.k, step.s, step.n, length(t) as len, substring(t, step.s + 1, 501) as part from step join w0 on w0.{key} = step.k where step.s < length(t) and (step.n = 0 or length(t) > 500)))),
cuts as (select a.k, a.s, b.e, a.n from step a join step b on a.k = b.k and b.n = a.n + 1),
parts as (select k as {key}, s, e, n, regexp_replace(substring(t, s + 1, e - s), '^\\s+|\\s+$', '', 'g') as text from cuts join w0 on w0.{key} = cuts.k),
w as (select {key}, cast(row_number() over (partition by {key} order by n) - 1 as integer) as chunk, cast(s as integer) as start, cast(e as integer) as "end", text from parts where text <> '')"""


_EMBED = "select doc_id as id, trim(regexp_replace(regexp_replace(source || '-' || doc_id || chr(10) || chr(10) || text, '\\s+', ' ', 'g'), '[^\\w\\s.,!?;:-]', '', 'g')) as t, source || '-' || doc_id as title from documents"
_NODES = f"with recursive {windows_sql(_EMBED)}"
_BM = """stats as (select count(*) as n, avg(length(regexp_extract_all(doc, '\\w+'))) as mean, sum(case when contains(doc, 'the') then 1 else 0 end) as df0, sum(case when contains(doc, 'thing') then 1 else 0 end) as df1, sum(case when contains(doc, 'with') then 1 else 0 end) as df2, sum(case when contains(doc, 'that') then 1 else 0 end) as df3 from corpus),
parts as (select id, title, content, length(regexp_extract_all(doc, '\\w+')) as len, (length(doc) - length(replace(doc, 'the', ''))) / 3 as tf0, (length(doc) - length(replace(doc, 'thing', ''))) / 5 as tf1, (length(doc) - length(replace(doc, 'with', ''))) / 4 as tf2, (length(doc) - length(replace(doc, 'that', ''))) / 4 as tf3 from corpus),
scored as (select id, title, content, """ + " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(4)) + " as score from parts, stats)"
_NEAR = f"with {_V}, {_ALL}, near as (select source as id, target, rank from k where rank <= 4 and source <> target)"
_LISTED = f"{_NEAR}, l as (select id, string_agg(cast(target as varchar), ',' order by rank) as near from near group by 1) select id, cast(len(vec) as integer) as dim, round(list_sum(vec), 4) as total, near from v join l using (id)"

ORACLE_SQL = {
    "note_chunks": f"{_NODES}, tot as (select id, cast(count(*) as integer) as total from w group by 1) select w.id, chunk, total, start, \"end\", sha256(text) as sha from w join tot using (id)",
    "note_nodes": f"{_NODES} select w.id || '_chunk_' || chunk as node, cast(w.id as varchar) as note, title, cast(1 as double) as norm2 from w join w0 using (id)",
    "note_sequence": f"{_NODES} select id || '_chunk_' || chunk as source, id || '_chunk_' || (chunk + 1) as target, cast(1 as double) as weight from w where exists (select 1 from w x where x.id = w.id and x.chunk = w.chunk + 1)",
    "node_sync": f"{_NODES} select id || '_chunk_' || chunk as node, cast(id as varchar) as note, sha256(text) as sha, 64 as dim from w where id % 5 <> 4",
    "search_palette": f"with {_CORPUS}, {_BM} select id, title, substring(content, 1, 100) || '...' as preview, round(score, 6) as score from scored where score > 0 order by scored.score desc, id limit 5",
    "search_sorted": f"with {_CORPUS}, {_BM} select id, round(score, 6) as score from scored where score > 0 order by id desc limit 7",
    "blank_search": "select cast(0 as bigint) as found",
    "index_lifecycle": f"with {_CORPUS}, t as (select id, unnest(regexp_extract_all(doc, '\\w+')) as token from corpus) select 'all' as index_id, count(distinct id) as docs, count(distinct token) as tokens, count(*) as words from t union all select 'odd', count(distinct id), count(distinct token), count(*) from t where id % 2 = 1",
    "notes_only_index": "with t as (select doc_id as id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) as token from documents where doc_id % 9 <> 0 and doc_id % 10 <> 1 and doc_id not in (2, 3)) select id, count(distinct token) as tokens, count(*) as words from t group by 1",
    "snapshot_roundtrip": _LISTED,
    "index_json": _LISTED,
    "index_prune": f"{_NEAR} select v.id, count(n.target) as neighbours from v left join near n on n.id = v.id and n.target % 7 <> 0 where v.id % 7 <> 0 group by 1",
    "index_rebuild": f"with {_V} select id, round(vec[1], 6) as first from v where id % 8 <> 0",
    "knn_adapter": f"with {_V}, {_ALL} select source, target, round(1 - score, 6) as distance from k where rank <= 10 and source % 20 = 0",
    "micro_batches": "with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as n from events) select user_id, n // 5 as batch, count(*) as size, min(event_id) as first from e group by 1, 2",
}
