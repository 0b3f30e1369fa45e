"""Queries of the note store, its event log and ordered operators, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import log as G
from ..operators import trees
from ..sources.tables import folders, forest, new_path, notes, table
from ..sources.versions import VersionedTable


def _items(spark, d):
    docs = table(spark, d, "documents")
    n = notes(docs).select("id", "title", "content", "parent_id", "created_at", F.lit("note").alias("type"))
    return n.unionByName(folders(docs).select("id", "title", F.lit("").alias("content"), "parent_id", "created_at", F.lit("folder").alias("type")))


def items_union(spark, d):
    return _items(spark, d).select("id", "title", "parent_id", "created_at", "type", F.sha2("content", 256).alias("content_sha")).orderBy(F.desc("created_at"), "id")


def items_roots(spark, d):
    return _items(spark, d).where("parent_id is null").select("id", "title", "type")


def items_children(spark, d):
    return _items(spark, d).where("parent_id = 'src1'").select("id", "title", "type")


def item_lookup(spark, d):
    return _items(spark, d).where("id = '7' and type = 'note'").select("id", "title", F.length("content").alias("length")).limit(1)


def note_titles_renamed(spark, d):
    t = F.when(F.col("ordinal") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("title"), F.lit(" ")))
    return notes(table(spark, d, "documents")).select("id", F.coalesce(F.nullif(F.trim(t), F.lit("")), F.lit("Untitled")).alias("title"))


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def event_fold_state(spark, d):
    t = F.col("event_type")
    f = G.fold(_events(spark, d), "user_id", "event_id", t == "signup", t.isin("click", "view"), t == "error", F.col("value"))
    return f.select("user_id", "created_seq", "updated_seq", F.round("value", 6).alias("value"))


def event_fold_partial_update(spark, d):
    """Column by column: clicks set value, views set props; the last one that sets a column wins."""
    e = _events(spark, d)
    t = F.col("event_type")
    a = G.fold(e, "user_id", "event_id", t == "signup", t == "click", t == "error", F.col("value")).select("user_id", "created_seq", F.round("value", 6).alias("value"))
    b = G.fold(e, "user_id", "event_id", t == "signup", t == "view", t == "error", F.col("props")).select("user_id", F.col("value").alias("props"))
    return a.join(b, "user_id")


def content_sync_latest(spark, d):
    """The last sync of each user's content stands, unless a clear came after it."""
    e = _events(spark, d).where("event_type in ('purchase', 'error')")
    return G.latest(e, ["user_id"], "event_id", "event_type", "props").where("event_type = 'purchase'").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def ui_state_latest(spark, d):
    e = _events(spark, d).where("event_type = 'click'")
    return e.agg(F.coalesce(F.max_by("user_id", "event_id"), F.lit(-1)).alias("selected"), F.coalesce(F.max_by("props", "event_id"), F.lit("{}")).alias("state"))


def entity_attributes_latest(spark, d):
    """Delete and insert: the last row of a key, created anew."""
    return G.latest(_events(spark, d), ["user_id", "event_type"], "event_id", "props").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("entity_key"), "props", F.col("event_id").alias("created_seq"))


def command_sessions(spark, d):
    s = G.sessions(_events(spark, d).where("event_type in ('click', 'view')"), "user_id", "ts", "30 minutes", "event_id")
    return s.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n"))


def debounce_last(spark, d):
    return G.with_quiet(_events(spark, d), "user_id", "ts", "event_id").where("quiet_s is null or quiet_s >= 600").select("event_id", "user_id")


def idle_gaps(spark, d):
    return G.with_quiet(_events(spark, d), "user_id", "ts", "event_id").where("quiet_s >= 7200").select("event_id", "user_id", F.round("quiet_s", 3).alias("quiet_s"))


def compaction_trigger(spark, d):
    return G.compaction(_events(spark, d), "user_id", "ts", F.length("props"), 100, 36000, "event_id").select("event_id", "user_id", "log_size", "reason")


def log_compaction(spark, d):
    """The log arrives in six batches; whenever its tail holds over a third of all rows it is compacted, and what later
    batches add is folded with what the compaction left."""
    e = _events(spark, d).select("user_id", "event_id", "event_type", "value")
    cuts, n = e.agg(F.percentile_approx("event_id", [i / 6 for i in range(1, 6)], 10_000), F.count(F.lit(1))).first()
    cuts = sorted(set(cuts or ()))
    log, names = VersionedTable(spark, new_path(spark, "event-log")), ("user_id", "event_id", "event_type", "value")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        above, upto = (F.lit(True) if low is None else F.col("event_id") > low), (F.lit(True) if high is None else F.col("event_id") <= high)
        log.append(e.where(above & upto))
        if log.tail_rows() > n // 3:
            log.compact(lambda rows: G.condensed(rows, *names, "signup", ["click", "view"], "error"))
            log.vacuum()
    t = F.col("event_type")
    f = G.fold(log.read(), "user_id", "event_id", t == "signup", t.isin("click", "view"), t == "error", F.col("value"))
    return f.select("user_id", "created_seq", "updated_seq", F.round("value", 6).alias("value"))


def store_versions(spark, d):
    """Customers in five versions: two appended halves, a replacement, a compaction and one more half; each is read once
    all are there."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    store = VersionedTable(spark, new_path(spark, "customers"))
    even, odd = c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1")
    versions = [store.append(even), store.append(odd), store.replace(c.where("c_nationkey < 12"), 2), store.compact(), store.append(odd)]
    found = [store.read(v).select(F.lit(v).cast("long").alias("version"), "c_nationkey", "c_acctbal") for v in versions]
    rows = found[0].union(found[1]).union(found[2]).union(found[3]).union(found[4])
    return rows.groupBy("version", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def _snapshots(spark, d):
    return _events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", F.concat(F.lit("snap-"), F.col("event_id").cast("string")).alias("file_name"), F.sha2("props", 256).alias("checksum"), "ts", F.length("props").alias("size"))


def snapshot_latest(spark, d):
    return _snapshots(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("file_name", "checksum")


def snapshot_gc(spark, d):
    """What goes when the newest two of each user stay."""
    s = _snapshots(spark, d)
    keep = G.newest(s, "user_id", 2, F.desc("ts"), F.desc("event_id"))
    return s.join(keep.select("event_id"), "event_id", "left_anti").select("file_name", "user_id")


def snapshot_info(spark, d):
    return _snapshots(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max("file_name").alias("last_name"), F.sum("size").alias("total_size"))


def keep_newest_n(spark, d):
    return G.newest(_snapshots(spark, d), "user_id", 10, F.desc("ts"), F.desc("event_id")).select("user_id", "file_name", "rank")


def queue_order(spark, d):
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 0).when(F.col("o_orderpriority").startswith("3"), 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", rank.alias("rank")).orderBy("rank", "o_orderkey")


def toggle_parity(spark, d):
    return _events(spark, d).where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("toggles")).select("user_id", (F.col("toggles") % 2 == 1).alias("selected"))


def toggle_all(spark, d):
    """Whether every user is selected: then all are cleared, else all are selected."""
    return toggle_parity(spark, d).agg(F.bool_and("selected").alias("every"), F.count(F.lit(1)).alias("n"))


def _forest(spark, d):
    return forest(*(table(spark, d, t) for t in ("region", "nation", "customer", "supplier")))


def descendants(spark, d):
    return trees.descendants(_forest(spark, d), "id = 'r1' or id = 'r2'").select("id", "root", "depth")


def hierarchy_depth(spark, d):
    f = _forest(spark, d)
    return trees.descendants(f, "parent_id is null").join(f.select(F.col("parent_id").alias("id")).where("id is not null").distinct(), "id", "left_semi").groupBy("root").agg(F.max("depth").alias("max_depth"), F.count(F.lit(1)).alias("parents"))


def compound_relations(spark, d):
    f = _forest(spark, d).where("parent_id is not null")
    return f.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def bulk_delete_cascade(spark, d):
    """What is left when two regions go with everything below them."""
    f = _forest(spark, d)
    return f.join(trees.descendants(f, "id in ('r0', 'r3')").select("id"), "id", "left_anti").select("id", "parent_id")


QUERIES = {f.__name__: f for f in (items_union, items_roots, items_children, item_lookup, note_titles_renamed, event_fold_state, event_fold_partial_update, content_sync_latest, ui_state_latest, entity_attributes_latest, command_sessions, debounce_last, idle_gaps, compaction_trigger, log_compaction, store_versions, snapshot_latest, snapshot_gc, snapshot_info, keep_newest_n, queue_order, toggle_parity, toggle_all, descendants, hierarchy_depth, compound_relations, bulk_delete_cascade)}

_ITEMS = """items as (select cast(doc_id as varchar) as id, source || '-' || doc_id as title, text as content, source as parent_id, strftime(timestamp '2024-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') as created_at, 'note' as type from documents
union all select source, source, '', null, strftime(timestamp '2024-01-01' + to_seconds(min(doc_id)), '%Y-%m-%dT%H:%M:%S'), 'folder' from documents group by source)"""


def _fold_sql(update: str, value: str) -> str:
    return f"""gone as (select user_id, max(event_id) as g from events where event_type = 'error' group by 1),
alive as (select e.* from events e left join gone using (user_id) where g is null or event_id > g),
born as (select user_id, min(event_id) as created_seq from alive where event_type = 'signup' group by 1),
kept as (select a.*, created_seq from alive a join born using (user_id) where event_id = created_seq or (event_type in ({update}) and event_id > created_seq)),
folded as (select user_id, min(created_seq) as created_seq, max(event_id) as updated_seq, arg_max({value}, event_id) filter ({value} is not null) as value from kept group by 1)"""


_QUIET = "q as (select *, epoch_us(lead(ts) over w) / 1e6 - epoch_us(ts) / 1e6 as quiet_s, sum(length(props)) over (partition by user_id order by ts, event_id rows unbounded preceding) as log_size from events window w as (partition by user_id order by ts, event_id))"
_SNAPS = "s as (select event_id, user_id, 'snap-' || event_id as file_name, sha256(props) as checksum, ts, length(props) as size, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events where event_type = 'purchase')"
_FOREST = "f as (select 'r' || r_regionkey as id, cast(null as varchar) as parent_id from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier)"


def _down(start: str) -> str:
    return f"with recursive {_FOREST}, t(id, root, depth) as (select id, id, 0 from f where {start} union all select f.id, t.root, t.depth + 1 from t join f on f.parent_id = t.id)"


ORACLE_SQL = {
    "items_union": f"with {_ITEMS} select id, title, parent_id, created_at, type, sha256(content) as content_sha from items",
    "items_roots": f"with {_ITEMS} select id, title, type from items where parent_id is null",
    "items_children": f"with {_ITEMS} select id, title, type from items where parent_id = 'src1'",
    "item_lookup": f"with {_ITEMS} select id, title, cast(length(content) as integer) as length from items where id = '7' and type = 'note'",
    "note_titles_renamed": "select cast(doc_id as varchar) as id, case when doc_id % 3 = 0 then 'Untitled' else source || '-' || doc_id end as title from documents",
    "event_fold_state": f"with {_fold_sql("'click', 'view'", 'value')} select user_id, created_seq, updated_seq, round(value, 6) as value from folded",
    "event_fold_partial_update": f"with {_fold_sql("'click'", 'value')}, k2 as (select a.*, created_seq from alive a join born using (user_id) where event_id = created_seq or (event_type = 'view' and event_id > created_seq)), f2 as (select user_id, arg_max(props, event_id) filter (props is not null) as props from k2 group by 1) select user_id, created_seq, round(value, 6) as value, props from folded join f2 using (user_id)",
    "content_sync_latest": "select user_id, event_id, cast(json_extract(props, '$.k') as bigint) as k from (select *, row_number() over (partition by user_id order by event_id desc) as r from events where event_type in ('purchase', 'error')) where r = 1 and event_type = 'purchase'",
    "ui_state_latest": "select coalesce(arg_max(user_id, event_id), -1) as selected, coalesce(arg_max(props, event_id), '{}') as state from events where event_type = 'click'",
    "entity_attributes_latest": "select event_type || ':' || user_id as entity_key, arg_max(props, event_id) as props, max(event_id) as created_seq from events group by event_type, user_id",
    "command_sessions": "with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minutes then 1 else 0 end as new from events where event_type in ('click', 'view')), b as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from a) select user_id, cast(session as bigint) as session, min(event_id) as first_event, max(event_id) as last_event, count(*) as n from b group by 1, 2",
    "debounce_last": f"with {_QUIET} select event_id, user_id from q where quiet_s is null or quiet_s >= 600",
    "idle_gaps": f"with {_QUIET} select event_id, user_id, round(quiet_s, 3) as quiet_s from q where quiet_s >= 7200",
    "compaction_trigger": f"with {_QUIET} select event_id, user_id, cast(log_size as bigint) as log_size, case when floor(log_size / 100) > floor((log_size - length(props)) / 100) then 'size' else 'idle' end as reason from q where floor(log_size / 100) > floor((log_size - length(props)) / 100) or quiet_s >= 36000",
    "store_versions": "with c as (select c_custkey % 2 as odd, c_nationkey, c_acctbal from customer), v as (select 1 as version, * from c where odd = 0 union all select 2, * from c union all select v, c.* from c, (values (3), (4), (5)) t(v) where c_nationkey < 12 union all select 5, * from c where odd = 1) select cast(version as bigint) as version, c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from v group by 1, 2",
    "snapshot_latest": f"with {_SNAPS} select file_name, checksum from s order by ts desc, event_id desc limit 1",
    "snapshot_gc": f"with {_SNAPS} select file_name, user_id from s where rank > 2",
    "snapshot_info": f"with {_SNAPS} select count(*) as n, max(file_name) as last_name, cast(sum(size) as bigint) as total_size from s",
    "keep_newest_n": f"with {_SNAPS} select user_id, file_name, rank from s where rank <= 10",
    "queue_order": "with t as (select o_orderkey, case when o_orderpriority[1] in ('1', '2') then 0 when o_orderpriority[1] = '3' then 1 else 2 end as rank from orders) select o_orderkey, rank from t order by rank, o_orderkey",
    "toggle_parity": "select user_id, count(*) % 2 = 1 as selected from events where event_type = 'view' group by 1",
    "toggle_all": "select bool_and(s) as every, count(*) as n from (select user_id, count(*) % 2 = 1 as s from events where event_type = 'view' group by 1)",
    "descendants": f"{_down("id in ('r1', 'r2')")} select id, root, depth from t",
    "hierarchy_depth": f"{_down('parent_id is null')} select root, max(depth) as max_depth, count(*) as parents from t where id in (select parent_id from f where parent_id is not null) group by root",
    "compound_relations": f"with {_FOREST} select parent_id, count(*) as n, min(id) as first, max(id) as last from f where parent_id is not null group by 1",
    "bulk_delete_cascade": f"{_down("id in ('r0', 'r3')")} select id, parent_id from f where id not in (select id from t)",
}
ORACLE_SQL["log_compaction"] = ORACLE_SQL["event_fold_state"]
