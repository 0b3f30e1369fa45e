"""Queries of histories, queues, imports and attribute defaults, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as C
from ..operators import sync as S
from ..sources.tables import table


def command_history(spark, d):
    action = F.when(F.col("event_type") == "click", "do").when(F.col("event_type") == "view", "undo").when(F.col("event_type") == "purchase", "redo")
    return S.histories(table(spark, d, "events"), "user_id", "event_id", action)


def sync_queue(spark, d):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return S.queue_runs(table(spark, d, "events"), "user_id", "event_id", rank, (F.col("event_id") % 6).cast("int"))


def legacy_import(spark, d):
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 40 == 0, "folder").when(F.col("doc_id") % 40 == 10, "sketch").otherwise("note")
    item = F.struct(F.col("doc_id").cast("string").alias("id"), kind.alias("type"), F.col("source").alias("title"), F.when(F.col("doc_id") % 40 != 20, F.col("text")).alias("content"), F.col("lang").alias("parentId"))
    return S.imported(docs.select(F.when(F.col("doc_id") % 70 == 0, "{oops").otherwise(F.to_json(F.struct(F.array(item).alias("items")))).alias("raw")), "raw")


_KIND_NAMES = ("CHARACTER", "NPC", "LOCATION", "SCENE", "ITEM", "FACTION", "EVENT")


def attribute_registry(spark, d):
    """How many attributes of each type the events' entities have, by the kind that the user's number tells."""
    kind = F.element_at(F.array(*[F.lit(x) for x in _KIND_NAMES]), (F.col("user_id") % 7 + 1).cast("int"))
    has = S.registry(spark).groupBy("kind", "type").agg(F.count(F.lit(1)).alias("each"))
    entities = table(spark, d, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("entities"))
    return entities.join(F.broadcast(has), "kind").select("kind", "type", (F.col("each") * F.col("entities")).alias("n"))


def attribute_defaults(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("user_id") % 2 == 0, "ITEM").otherwise("SCENE")
    name = F.when(F.col("event_id") % 100 == 0, "type").otherwise("colour")
    v = e.select(F.col("event_id").alias("entity"), kind.alias("kind"), name.alias("name"), F.col("event_type").alias("value"))
    return S.with_defaults(v, spark)


def command_events(spark, d):
    """Events as commands on notes: what each writes to the log, and what takes it back."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "create").when(t == "click", "rename").when(t == "view", "write").when(t == "error", "delete").otherwise("select")
    c = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("value"))
    return C.event_pairs(c)


def _canned(prompts):
    """A provider without a model: answers from the prompt alone, and fails on batches with a prompt about number 13."""
    if any(p.endswith(" 13") for p in prompts):
        raise ConnectionError("no answer")
    return [None if p.endswith(" 7") else '[{"value":"' + p.split()[-1] + '","type":"CARDINAL"}]' for p in prompts]


def model_answers(spark, d):
    """Prompts answered one at a time by a provider: a failure or no answer is an empty list."""
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("about "), (F.col("c_custkey") % 20).cast("string")).alias("prompt"))
    return C.answered(asked, "c_custkey", "prompt", _canned, batch=1)


def graph_file_stats(spark, d):
    """Saved graphs, one for each order with its parts, and the system's own: how many, their elements as counted, the
    newest."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("created"))
    each = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count_distinct("l_partkey") + 1).alias("nodes"), F.count(F.lit(1)).alias("edges"))
    files = o.join(each, "o_orderkey").select("nodes", "edges", "created")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    system = nation.agg((F.count(F.lit(1)) + region.agg(F.count(F.lit(1))).scalar()).alias("nodes"), F.count("n_regionkey").alias("edges"), F.lit("1990-01-01").alias("created"))
    return files.union(system).agg(F.count(F.lit(1)).alias("files"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), F.max("created").alias("newest"))


QUERIES = {f.__name__: f for f in (command_history, sync_queue, legacy_import, attribute_registry, attribute_defaults, command_events, model_answers, graph_file_stats)}

_ROWS = ", ".join("('" + "', '".join(x.split("|")) + "')" for x in S.REGISTRY)

ORACLE_SQL = {
    "sync_queue": "with t as (select user_id, event_id, case event_type when 'error' then 0 when 'click' then 1 else 2 end as rank, cast(event_id % 6 as integer) as fails from events) select user_id, event_id, cast(a.attempt as integer) as attempt, cast(least(rank + a.attempt, 2) as integer) as priority, case when a.attempt = fails then 'done' when a.attempt = 3 then 'dropped' else 'again' end as outcome from t join (values (0), (1), (2), (3)) a(attempt) on a.attempt <= least(fails, 3)",
    "legacy_import": "with t as (select doc_id, case when doc_id % 40 = 0 then 'folder' when doc_id % 40 = 10 then 'sketch' else 'note' end as type, source, lang, text from documents where doc_id % 70 <> 0) select cast(doc_id as varchar) as id, type, source as title, case when type = 'folder' then '' when doc_id % 40 = 20 then '{}' else text end as content, lang as parent_id from t where type <> 'sketch'",
    "attribute_registry": f"with e as (select list_value('" + "', '".join(_KIND_NAMES) + f"')[user_id % 7 + 1] as kind, count(*) as entities from events group by 1), r as (select kind, type, count(*) as each_ from (values {_ROWS}) r(kind, name, type, fallback, unit) group by 1, 2) select kind, type, each_ * entities as n from e join r using (kind)",
    "attribute_defaults": f"with r(kind, name, type, fallback, unit) as (values {_ROWS}), v as (select event_id as entity, case when user_id % 2 = 0 then 'ITEM' else 'SCENE' end as kind, case when event_id % 100 = 0 then 'type' else 'colour' end as name, event_type as value from events), w as (select entity, r.kind, r.name, fallback from v join r using (kind)) select coalesce(v.entity, w.entity) as entity, coalesce(v.kind, w.kind) as kind, coalesce(v.name, w.name) as name, coalesce(value, fallback) as value, case when fallback is null then 'custom' when value is null then 'default' else 'own' end as origin from v full outer join w on v.entity = w.entity and v.kind = w.kind and v.name = w.name",
    "command_events": """with c as (select user_id as id, event_id as seq, case event_type when 'signup' then 'create' when 'click' then 'rename' when 'view' then 'write' when 'error' then 'delete' else 'select' end as kind, json_extract_string(props, '$.k') as value from events),
l as (select *, sum(case when kind in ('create', 'delete') then 1 else 0 end) over (partition by id order by seq rows unbounded preceding) as life from c)
select id, seq, case kind when 'create' then 'NoteCreated' when 'delete' then 'NoteDeleted' when 'select' then 'UiStateSet' else 'NoteUpdated' end as event, case kind when 'rename' then 'title' when 'write' then 'content' end as field, case when kind in ('rename', 'write') then value end as value,
case kind when 'create' then 'NoteDeleted' when 'delete' then 'NoteCreated' when 'select' then null else 'NoteUpdated' end as undo, case when kind in ('rename', 'write') then (select arg_max(p.value, p.seq) from l p where p.id = l.id and p.life = l.life and p.kind = l.kind and p.seq < l.seq) end as undo_value from l""",
    "model_answers": """select c_custkey, case when c_custkey % 20 in (7, 13) then '[]' else '[{"value":"' || c_custkey % 20 || '","type":"CARDINAL"}]' end as json from customer""",
    "graph_file_stats": "with e as (select l_orderkey, count(distinct l_partkey) + 1 as nodes, count(*) as edges from lineitem group by 1), f as (select nodes, edges, cast(o_orderdate as varchar) as created from orders join e on o_orderkey = l_orderkey union all select (select count(*) from nation) + (select count(*) from region), (select count(*) from nation), '1990-01-01') select count(*) as files, cast(sum(nodes) as bigint) as nodes, cast(sum(edges) as bigint) as edges, max(created) as newest from f",
}
