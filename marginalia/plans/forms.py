"""Queries of attribute values, rich documents, entity preparation and small formats, with SQL that computes the same."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import forms as A
from ..functions import text as T
from ..functions import vector as V
from ..operators import sync as S
from ..operators import texts as X
from ..sources.tables import table

ABBREVIATIONS = ("e.g", "No", "approx")


def _raw(spark, d):
    """Events' numbers as JSON values of every type."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = k.cast("string")
    raw = (
        F.when(k % 10 == 0, s)
        .when(k % 10 == 1, F.when(k > 50, "true").otherwise("false"))
        .when(k % 10 == 2, F.concat(F.lit('["a'), s, F.lit('","b","c'), s, F.lit('"]')))
        .when(k % 10 == 3, F.concat(F.lit('{"current":'), s, F.lit(',"maximum":80}')))
        .when(k % 10 == 4, F.concat(F.lit('{"strength":'), s, F.lit(',"wisdom":9}')))
        .when(k % 10 == 5, F.concat(F.lit('"2024-01-02T03:04:'), F.lpad((k % 60).cast("string"), 2, "0"), F.lit('"')))
        .when(k % 10 == 6, F.concat(F.lit('"https://example.org/'), s, F.lit('"')))
        .when(k % 10 == 7, F.concat(F.lit('{"label":"L'), s, F.lit('"}')))
        .when(k % 10 == 8, F.concat(F.lit("-"), s, F.lit(".5")))
        .otherwise(F.concat(F.lit('"value '), s, F.lit('"')))
    )
    return table(spark, d, "events").select("event_id", k.alias("k"), raw.alias("raw"))


def attribute_type_detect(spark, d):
    return _raw(spark, d).select("event_id", "raw", A.kind_of(F.col("raw")).alias("found"))


def attribute_display(spark, d):
    r = _raw(spark, d)
    kind = F.when(F.col("k") % 10 == 7, "EntityLink").otherwise(A.kind_of(F.col("raw")))
    return r.select("event_id", A.shown(F.col("raw"), kind).alias("shown"), A.summary(F.col("raw"), kind).alias("summary"))


def attribute_normalise(spark, d):
    """Values as if each were all that is kept of an entity's attributes; some are plain text."""
    raw = F.when(F.col("k") % 10 == 9, F.concat(F.lit("plain "), F.col("k").cast("string"))).otherwise(F.col("raw"))
    m = _raw(spark, d).select("event_id", A.attributes(raw).alias("m"))
    return m.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("attributes"))


def attribute_edits(spark, d):
    """A map and a list after an added, a replaced, a blank and a deleted key, an appended and a removed item."""
    k = F.col("k").cast("string")
    m = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(k, F.lit("x")))
    m = A.without_key(A.with_key(A.with_key(A.with_key(m, F.lit(" c "), k), F.lit("a"), F.lit("new")), F.lit("  "), k), F.when(F.col("k") % 2 == 0, "b").otherwise("zzz"))
    items = A.without_index(A.appended(A.appended(F.array(F.lit("p"), F.lit("q")), F.concat(F.lit(" "), k, F.lit(" "))), F.lit(" ")), F.col("k") % 4)
    out = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return _raw(spark, d).select("event_id", out.alias("attributes"), F.array_join(items, ",").alias("items"))


def highest_stat(spark, d):
    """Three stats a customer; every one that is the largest is marked, ties too."""
    c = F.col("c_custkey")
    stats = F.create_map(F.lit("strength"), c % 7, F.lit("wisdom"), c % 5, F.lit("charisma"), c % 3)
    return table(spark, d, "customer").select("c_custkey", F.array_join(A.highest(stats), ",").alias("top"))


def layout_sections(spark, d):
    """Where two layouts put each attribute of the events' entities: those that its kind has, and its own, which are text."""
    from .sync import attribute_defaults

    r = S.registry(spark).select("kind", "name", F.col("type").alias("t"))
    kind = F.coalesce("t", F.lit("Text"))
    return attribute_defaults(spark, d).join(F.broadcast(r), ["kind", "name"], "left").select("entity", "name", A.section(kind, "character").alias("character"), A.section(kind, "faction").alias("faction"))


def progress_bars(spark, d):
    c = F.col("c_custkey")
    p, band = A.percent(c % 150, 100 + c % 50)
    return table(spark, d, "customer").select("c_custkey", p.alias("percent"), band.alias("band"))


def delta_envelopes(spark, d):
    """The steps that append a tag to a text, in an envelope with their checksum."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old"), F.concat(F.coalesce("text", F.lit("")), F.lit(" #"), "lang").alias("new"))

    def each(old, new):
        steps = [{"type": t, "length": n} | ({"content": c} if c else {}) for t, n, c in X.delta(old, new)]
        return [(json.dumps(steps, separators=(",", ":"), ensure_ascii=False),)]

    made = X.mapped(docs, "doc_id", ["old", "new"], each, {"deltas": pa.string()}, "deltas string")
    return made.select("doc_id", "deltas", F.left(F.base64(F.encode("deltas", "utf-8")), F.lit(16)).alias("checksum"))


def data_uris(spark, d):
    uri = F.when(F.col("doc_id") % 5 == 0, F.lit("data:broken")).otherwise(F.concat(F.lit("data:text/plain;base64,"), F.replace(F.base64(F.encode("text", "utf-8")), F.lit("\r\n"), F.lit(""))))
    kind, data = T.data_uri(uri)
    return table(spark, d, "documents").select("doc_id", kind.alias("media"), F.octet_length(data).alias("bytes"), F.sha2(data, 256).alias("sha"))


def wav_files(spark, d):
    """A wave of each user's events as sound: beyond 1 in either direction they are cut."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", ((F.col("event_id") % 200 - 100) / 80).alias("v")))).alias("s"))
    w = T.wav(F.transform("s", lambda x: x["v"]))
    return e.select("user_id", F.octet_length(w).alias("bytes"), F.sha2(w, 256).alias("sha"))


def wiki_hrefs(spark, d):
    href = F.when(F.col("doc_id") % 4 == 0, F.lit("https://example.org/page")).otherwise(F.concat(F.lit("https://example.org/wiki/"), F.replace(F.url_encode(F.concat("source", F.lit(" & "), "lang", F.lit("+1"))), F.lit("+"), F.lit("%20"))))
    return table(spark, d, "documents").select("doc_id", T.wiki_title(href).alias("title"))


def highlights(spark, d):
    marked = F.concat("text", F.lit(" ==by "), "source", F.lit("== and ==in "), "lang", F.lit("== ==="))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all(marked, F.lit(T.HIGHLIGHT), F.lit(1)), "|").alias("marked"))


def entity_text(spark, d):
    """What entity search is given: without tags and diacritics; and whether it is long enough for it and for triples."""
    t = T.clean_for_entities(F.concat(F.lit("<p>"), "text", F.lit("</p> Málaga Ångström naïve café")))
    short = F.when(F.col("doc_id") % 6 == 0, F.left("text", F.col("doc_id").cast("int") % 30)).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), (F.length(F.trim(short)) >= 10).alias("entities"), (F.length(F.trim(short)) >= 20).alias("triples"))


def object_json(spark, d):
    """Suppliers as serialised objects: keys in snake case, an alias, and the account's balance as a secret."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplierKey"), F.col("s_name").alias("displayName"), F.struct(F.col("s_nationkey").alias("nationKey")).alias("homePlace"), F.col("s_acctbal").alias("accountBalance"))
    out = A.serialised(s, ["example", "Supplier"], {"accountBalance": "ACCOUNT_BALANCE"}, {"displayName": "fullName"})
    return out.select(*[F.get_json_object("json", f"$.{p}").alias(n) for n, p in (("ns", "ns"), ("type", "type"), ("key", "kwargs.supplier_key"), ("name", "kwargs.full_name"), ("nation", "kwargs.home_place.nation_key"), ("secret", "kwargs.account_balance.type"), ("secret_id", "kwargs.account_balance.id[0]"))])


def inline_rendering(spark, d):
    k = F.col("doc_id")
    a, b = T.entity_mark(F.lit("ORG"), F.col("source"), F.when(k % 2 == 0, F.to_json(F.struct(k.alias("n"))))), T.entity_mark(F.lit("LANG"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.triple_mark(a, F.lit("speaks"), b).alias("triple"), F.concat(F.lit("#"), "lang").alias("tag"), F.concat(F.lit("[["), "source", F.lit("]]")).alias("wiki"), F.concat(F.lit("<<"), "source", F.lit(">>")).alias("cross"))


_LABELLED = (*X.ENTITY_KINDS, "Organisation", "location", "datetime")


def entity_icons(spark, d):
    """The icon of each event's entity, whose label its number tells."""
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELLED]), (F.col("event_id") % len(_LABELLED) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", label.alias("label")).select("event_id", "label", T.entity_icon(F.col("label")).alias("icon"))


def prompts(spark, d):
    t = F.col("text")
    p = {k: A.prompt(k, t, F.lit("make it rhyme"), list(X.LABELS)) for k in A.PROMPTS}
    return table(spark, d, "documents").select("doc_id", *[F.sha2(p[k], 256).alias(f"for_{k}") for k in A.PROMPTS])


def time_formats(spark, d):
    """ISO text, epoch milliseconds, the date alone, whether texts are dates, and time passed in words."""
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.lit("day "), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_millis(ts).alias("ms"), F.to_date(ts).cast("string").alias("day"), A.is_date(text).alias("is_date"), T.since(ts, now).alias("passed"))


def cosine_unguarded(spark, d):
    """Without a guard for vectors of no length: no similarity at all, where the guarded one is 0."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 3, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("v"))
    q = e.where("id = 0").select("v")
    return e.withColumn("q", q.scalar()).select("id", F.round(V.cosine(F.col("v"), F.col("q")), 6).alias("plain"), F.round(V.cosine(F.col("v"), F.col("q"), F.lit(0.0)), 6).alias("guarded"))


def level_probabilities(spark, d):
    """Levels of a layered index for lists of 16 neighbours: each vector draws one by a number that its id tells, and of each
    level the chance that it has is told, which is what the draws are of it on average."""
    u = (F.col("vec_id") * 7919 % 10007 + 0.5) / 10007
    level = F.floor(-F.log(1 - u) / F.log(F.lit(16.0))).cast("int")
    p = F.exp(-F.col("level") * F.log(F.lit(16.0))) * (1 - F.exp(-F.log(F.lit(16.0))))
    return table(spark, d, "embeddings").select(level.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", "n", F.round(p, 9).alias("p"))


def masked_sentences(spark, d):
    t = F.concat("text", F.lit(" See e.g. this, No. 7 or approx. that. Then the end"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.masked_sentences(t, ABBREVIATIONS)).alias("n", "s")).select("doc_id", "n", F.sha2("s", 256).alias("sha"))


def chunk_prefixes(spark, d):
    t = T.chunk_text(F.col("text"))
    p = T.prefixed(t, "note")
    return table(spark, d, "documents").select("doc_id", F.sha2(p, 256).alias("prefixed"), (T.unprefixed(p, "note") == F.regexp_replace(t, r"^\s+", "")).alias("back"), F.length(t).alias("length"))


def _rich(spark, d):
    """Documents as rich text: a heading, a paragraph, a list with two items, a blank paragraph, and a bare text."""
    def node(kind: str, text):
        return F.concat(F.lit(f'{{"type":"{kind}","content":['), F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))), F.lit("]}"))

    t = F.regexp_replace("text", "\n", " ")
    item = F.concat(F.lit('{"type":"listItem","content":['), node("paragraph", F.col("lang")), F.lit("]}"))
    body = F.concat(F.lit('{"type":"doc","content":['), node("heading", F.col("source")), F.lit(","), node("paragraph", t), F.lit(","), item, F.lit(","), node("paragraph", F.lit("  ")), F.lit(","), item, F.lit("]}"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit(" plain "), "source", F.lit(" "))).otherwise(body).alias("body"))


def rich_text_variants(spark, d):
    b = F.col("body")
    clean = F.coalesce(X.rich_text(b, "clean"), F.trim(b))
    return _rich(spark, d).select("doc_id", F.sha2(X.rich_text(b, "lines"), 256).alias("lines"), F.sha2(X.rich_text(b), 256).alias("paragraphs"), F.sha2(clean, 256).alias("clean"))


def note_maps(spark, d):
    """Connections of notes and folders alike: what isn't a note has none."""
    k = F.col("doc_id")
    body = F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"tag","attrs":{"label":"'), "lang", F.lit('"}},{"type":"tag","attrs":{"label":"'), "lang", F.lit('"}},{"type":"text","text":"a","marks":[{"type":"mention","attrs":{"label":"'), "source", F.lit('"}},{"type":"link","attrs":{"title":"t'), (k % 9).cast("string"), F.lit('"}}]},{"type":"crosslink","attrs":{"label":"c'), (k % 4).cast("string"), F.lit('"}},{"type":"entity","attrs":{"kind":"ORG","label":"'), "source", F.lit('"}}]}]}'))
    items = table(spark, d, "documents").select(k.cast("string").alias("id"), F.when(k % 11 != 0, body).alias("body"))
    names = ("tags", "mentions", "links", "backlinks", "entities", "triples")

    def each(b):
        w = X.walked(b)
        return [tuple(",".join(w[n]) for n in names)]

    return X.mapped(items, "id", ["body"], each, {n: pa.string() for n in names}, ", ".join(f"{n} string" for n in names))


def rule_entities(spark, d):
    """Entities that patterns find in every text; offsets are code points."""
    e = X.Recognizers().run(table(spark, d, "documents"), "doc_id", "text")
    return e.select("doc_id", "value", "type", "start", "end", "confidence")


def entity_preparation(spark, d):
    """Counts of tokens that are no stop words, of sentences, and the confidence that a text is worth searching."""
    t = F.col("text")
    stop = F.array(*[F.lit(w) for w in X.STOP_WORDS])
    tokens = F.filter(T.query_tokens(t), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).alias("tokens"), F.size(T.sentences(t)).alias("sentences"), F.round(T.text_confidence(t), 6).alias("confidence"))


def entity_labels(spark, d):
    """How often each of a recognizer's labels would mark the events: outside, or a beginning or inside of a kind."""
    n = len(X.ENTITY_KINDS)
    kind = F.element_at(F.array(*[F.lit(x) for x in X.ENTITY_KINDS]), (F.col("event_id") % n + 1).cast("int"))
    part = F.col("event_id") % 4
    label = F.when(part == 0, F.concat(F.lit("B-"), kind)).when(part == 1, F.concat(F.lit("I-"), kind)).otherwise("O")
    found = table(spark, d, "events").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(x,) for x in X.LABELS], "label string")
    return every.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {f.__name__: f for f in (attribute_type_detect, attribute_display, attribute_normalise, attribute_edits, highest_stat, layout_sections, progress_bars, delta_envelopes, data_uris, wav_files, wiki_hrefs, highlights, entity_text, object_json, inline_rendering, entity_icons, prompts, time_formats, cosine_unguarded, level_probabilities, masked_sentences, chunk_prefixes, rich_text_variants, note_maps, rule_entities, entity_preparation, entity_labels)}

from .sync import _ROWS  # noqa: E402
from .sync import ORACLE_SQL as _SYNC  # noqa: E402

_DEFAULTS = _SYNC["attribute_defaults"]

_R = """r as (select event_id, k, case k % 10 when 0 then cast(k as varchar) when 1 then case when k > 50 then 'true' else 'false' end when 2 then '["a' || k || '","b","c' || k || '"]' when 3 then '{"current":' || k || ',"maximum":80}' when 4 then '{"strength":' || k || ',"wisdom":9}' when 5 then '"2024-01-02T03:04:' || lpad(cast(k % 60 as varchar), 2, '0') || '"' when 6 then '"https://example.org/' || k || '"' when 7 then '{"label":"L' || k || '"}' when 8 then '-' || k || '.5' else '"value ' || k || '"' end as raw from (select event_id, cast(json_extract(props, '$.k') as integer) as k from events))"""
_TYPED = """t as (select *, case when json_type(raw) = 'BOOLEAN' then 'Boolean' when json_type(raw) in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'Number' when json_type(raw) = 'ARRAY' then 'List' when json_exists(raw, '$.current') then 'ProgressBar' when json_exists(raw, '$.strength') then 'StatBlock' when json_type(raw) = 'VARCHAR' and regexp_matches(raw, '^"[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'Date' when json_type(raw) = 'VARCHAR' and (starts_with(raw, '"http://') or starts_with(raw, '"https://')) then 'URL' else 'Text' end as found from r)"""
_SENT = "list_filter(list_transform(string_split_regex({t}, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_MASK = "replace(replace(replace(text || ' See e.g. this, No. 7 or approx. that. Then the end', 'e.g.', 'e¶g¶'), 'No.', 'No¶'), 'approx.', 'approx¶')"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_KINDS = "list_value('" + "', '".join(_LABELLED) + "')"


def _prompt_sql(kind: str) -> str:
    parts = A.re.split(r"(\{\w+\})", A.PROMPTS[kind])
    values = {"{text}": "text", "{command}": "'make it rhyme'", "{labels}": "'" + ", ".join(X.LABELS) + "'"}
    return " || ".join(values.get(x, "'" + x.replace("'", "''") + "'") for x in parts if x)


def _hex(x: str, size: int) -> str:
    h = f"lpad(printf('%X', (({x}) + {1 << 8 * size}) % {1 << 8 * size}), {2 * size}, '0')"
    return " || ".join(f"substring({h}, {2 * i + 1}, 2)" for i in reversed(range(size)))


ORACLE_SQL = {
    "attribute_type_detect": f"with {_R}, {_TYPED} select event_id, raw, found from t",
    "attribute_display": f"""with {_R}, {_TYPED} select event_id, case k % 10 when 2 then 'a' || k || ', b, c' || k when 3 then k || '/80' when 4 then 'STR:' || k when 7 then 'L' || k when 5 then trim(raw, '"') when 6 then trim(raw, '"') when 9 then trim(raw, '"') else raw end as shown,
case k % 10 when 1 then upper(raw[1]) || raw[2:] when 2 then '3 items' when 5 then trim(raw, '"') when 6 then trim(raw, '"') when 9 then trim(raw, '"') else raw end as summary from t""",
    "attribute_normalise": f"with {_R} select event_id, case k % 10 when 2 then '' when 3 then 'current=' || k || ',maximum=80' when 4 then 'strength=' || k || ',wisdom=9' when 7 then 'label=L' || k when 9 then 'text=plain ' || k else 'text=' || raw end as attributes from r",
    "attribute_edits": f"with {_R} select event_id, case when k % 2 = 0 then 'a=new,c=' || k else 'a=new,b=x,c=' || k end as attributes, case k % 4 when 0 then 'q,' || k when 1 then 'p,' || k when 2 then 'p,q' else 'p,q,' || k end as items from r",
    "highest_stat": "with s as (select c_custkey, unnest(['charisma', 'strength', 'wisdom']) as stat, unnest([c_custkey % 3, c_custkey % 7, c_custkey % 5]) as v from customer), m as (select *, max(v) over (partition by c_custkey) as top from s) select c_custkey, string_agg(stat, ',' order by stat) as top from m where v = top group by 1",
    "layout_sections": f"with a as ({_DEFAULTS}), r(kind, name, type, fallback, unit) as (values {_ROWS}), t as (select entity, a.name, coalesce(type, 'Text') as type from a left join r on r.kind = a.kind and r.name = a.name) select entity, name, case type when 'StatBlock' then 'stats' when 'ProgressBar' then 'bars' else 'rest' end as character, case when type = 'Relationship' then 'relations' when type = 'ProgressBar' then 'bars' when type in ('Text', 'Number', 'Boolean') then 'facts' when type = 'List' then 'lists' end as faction from t",
    "progress_bars": "with p as (select c_custkey, cast(floor((c_custkey % 150) / cast(100 + c_custkey % 50 as double) * 100 + 0.5) as integer) as percent from customer) select c_custkey, percent, case when percent > 66 then 'green' when percent > 33 then 'yellow' else 'red' end as band from p",
    "delta_envelopes": """with e as (select doc_id, (case when length(text) > 0 then '[{"type":"retain","length":' || length(text) || '},' else '[' end) || '{"type":"insert","length":' || (length(lang) + 2) || ',"content":" #' || lang || '"}]' as deltas from documents) select doc_id, deltas, substring(base64(encode(deltas)), 1, 16) as checksum from e""",
    "data_uris": "select doc_id, case when doc_id % 5 <> 0 then 'text/plain' end as media, case when doc_id % 5 <> 0 then cast(strlen(text) as integer) end as bytes, case when doc_id % 5 <> 0 then sha256(text) end as sha from documents",
    "wav_files": f"with s as (select user_id, event_id, cast(trunc(greatest(-1, least(1, (event_id % 200 - 100) / cast(80 as double))) * 32767) as integer) as v from events), b as (select user_id, string_agg({_hex('v', 2)}, '' order by event_id) as body, count(*) * 2 as n from s group by 1), w as (select user_id, '52494646' || {_hex('n + 36', 4)} || '57415645666D7420' || '1000000001000100C05D000080BB00000200100064617461' || {_hex('n', 4)} || body as h from b) select user_id, cast(length(h) / 2 as integer) as bytes, sha256(unhex(h)) as sha from w",
    "wiki_hrefs": "select doc_id, case when doc_id % 4 <> 0 then source || ' & ' || lang || '+1' end as title from documents",
    "highlights": "select doc_id, array_to_string(regexp_extract_all(text || ' ==by ' || source || '== and ==in ' || lang || '== ===', '==([^=]+)==', 1), '|') as marked from documents",
    "entity_text": "select doc_id, sha256(trim(strip_accents(regexp_replace('<p>' || text || '</p> Málaga Ångström naïve café', '<[^>]*>', '', 'g')))) as sha, length(trim(s)) >= 10 as entities, length(trim(s)) >= 20 as triples from (select *, case when doc_id % 6 = 0 then substring(text, 1, doc_id % 30) else text end as s from documents)",
    "object_json": "select '1' as ns, 'constructor' as type, cast(s_suppkey as varchar) as key, s_name as name, cast(s_nationkey as varchar) as nation, 'secret' as secret, 'ACCOUNT_BALANCE' as secret_id from supplier",
    "inline_rendering": """select doc_id, '[ORG|' || source || case when doc_id % 2 = 0 then '|{"n":' || doc_id || '}' else '' end || '] (speaks) [LANG|' || lang || ']' as triple, '#' || lang as tag, '[[' || source || ']]' as wiki, '<<' || source || '>>' as cross from documents""",
    "entity_icons": f"with l as (select event_id, ({_KINDS})[event_id % {len(_LABELLED)} + 1] as label from events) select event_id, label, case when contains(lower(label), 'person') then 'users' when contains(lower(label), 'org') then 'building' when contains(lower(label), 'loc') or contains(lower(label), 'gpe') then 'map-pin' when contains(lower(label), 'date') or contains(lower(label), 'time') then 'calendar' else 'hash' end as icon from l",
    "prompts": "select doc_id, " + ", ".join(f"sha256({_prompt_sql(k)}) as for_{k}" for k in A.PROMPTS) + " from documents",
    "time_formats": "with e as (select event_id, ts, epoch(timestamp '2024-03-01') - floor(epoch(ts)) as s from events), u as (select *, case when s >= 31104000 and floor(s / 31536000) >= 1 then [cast(floor(s / 31536000) as bigint), 31536000] when floor(s / 2592000) >= 1 then [cast(floor(s / 2592000) as bigint), 2592000] when floor(s / 86400) >= 1 then [cast(floor(s / 86400) as bigint), 86400] when floor(s / 3600) >= 1 then [cast(floor(s / 3600) as bigint), 3600] when floor(s / 60) >= 1 then [cast(floor(s / 60) as bigint), 60] end as n from e) select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, epoch_us(ts) // 1000 as ms, strftime(ts, '%Y-%m-%d') as day, event_id % 3 <> 2 as is_date, case when n is null then 'just now' else n[1] || ' ' || case n[2] when 31536000 then 'year' when 2592000 then 'month' when 86400 then 'day' when 3600 then 'hour' else 'minute' end || case when n[1] > 1 then 's' else '' end || ' ago' end as passed from u",
    "cosine_unguarded": "with e as (select vec_id as id, case when vec_id % 10 = 3 then list_transform(embedding, lambda x: cast(0 as double)) else list_transform(embedding, lambda x: cast(x as double)) end as v from embeddings), q as (select v as q from e where id = 0), s as (select id, list_dot_product(v, q) / nullif(sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 0) as c from e, q) select id, round(c, 6) as plain, round(coalesce(c, 0), 6) as guarded from s",
    "level_probabilities": "with l as (select cast(floor(-ln(1 - (vec_id * 7919 % 10007 + 0.5) / 10007) / ln(16)) as integer) as level from embeddings) select level, count(*) as n, round(pow(16, -level) * (1 - 1.0 / 16), 9) as p from l group by 1",
    "masked_sentences": f"with t as (select doc_id, {_SENT.format(t=_MASK)} as s from documents), u as (select doc_id, unnest(s) as s, generate_subscripts(s, 1) - 1 as n from t) select doc_id, cast(n as integer) as n, sha256(replace(s, '¶', '.')) as sha from u",
    "chunk_prefixes": "with t as (select doc_id, regexp_replace(regexp_replace(text, '([^\\n])\\n([^\\n])', '\\1 \\2', 'g'), '\\s{2,}', ' ', 'g') as t from documents) select doc_id, sha256('note: ' || t) as prefixed, true as back, cast(length(t) as integer) as length from t",
    "rich_text_variants": "with t as (select doc_id, source as s, lang as l, replace(text, chr(10), ' ') as t from documents) select doc_id, case when doc_id % 8 <> 0 then sha256(s || chr(10) || t || chr(10) || l || chr(10) || '  ' || chr(10) || l || chr(10)) end as lines, case when doc_id % 8 <> 0 then sha256(s || chr(10) || t || chr(10) || l || chr(10) || '  ' || chr(10) || l) end as paragraphs, sha256(case when doc_id % 8 = 0 then 'plain ' || s else s || chr(10) || case when trim(t) = '' then '' else regexp_replace(t || chr(10), '[ \\t]{2,}', ' ', 'g') end || l || ' ' || l end) as clean from t",
    "note_maps": """select cast(doc_id as varchar) as id, case when doc_id % 11 = 0 then '' else lang end as tags, case when doc_id % 11 = 0 then '' else source end as mentions, case when doc_id % 11 = 0 then '' else 't' || doc_id % 9 end as links, case when doc_id % 11 = 0 then '' else 'c' || doc_id % 4 end as backlinks, case when doc_id % 11 = 0 then '' else '{"kind": "ORG", "label": "' || source || '"}' end as entities, '' as triples from documents""",
    "entity_preparation": f"select doc_id, cast(len(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 and w not in ({_STOP}))) as integer) as tokens, cast(len({_SENT.format(t='text')}) as integer) as sentences, cast(round(least(1.0, 0.5 + case when len(regexp_extract_all(text, '\\w+')) >= 5 then 0.2 else 0 end + case when len({_SENT.format(t='text')}) >= 2 then 0.1 else 0 end + case when regexp_matches(text, '[a-z,;] [A-Z][a-z]+') then 0.2 else 0 end), 6) as double) as confidence from documents",
    "entity_labels": "with k as (select list_value('" + "', '".join(X.ENTITY_KINDS) + "') as k), f as (select case event_id % 4 when 0 then 'B-' || k[event_id % 18 + 1] when 1 then 'I-' || k[event_id % 18 + 1] else 'O' end as label from events, k), every as (select 'O' as label union all select p || unnest(k) from k, (values ('B-'), ('I-')) t(p)) select label, count(f.label) as n from every left join f using (label) group by 1",
}
