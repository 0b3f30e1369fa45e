"""Queries of chunkers, deltas, rich documents and attributes, with SQL that computes the same where SQL can."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import texts as X
from ..sources.tables import table
from .retrieval import windows_sql


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def sentence_chunks(spark, d):
    s = _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("chunk", "s"))
    return s.select("doc_id", "chunk", F.sha2("s", 256).alias("sha"))


def fixed_chunks(spark, d):
    fields = {"chunk": pa.int32(), "start": pa.int32(), "end": pa.int32(), "text": pa.string()}
    c = X.mapped(_docs(spark, d), "doc_id", ["text"], X.windows, fields, "chunk int, start int, end int, text string")
    return c.select("doc_id", "chunk", "start", "end", F.sha2("text", 256).alias("sha"))


def _listed(spark, d, each):
    fields = {"chunk": pa.int32(), "tokens": pa.int32(), "sha": pa.string()}
    return X.mapped(_docs(spark, d), "doc_id", ["text"], lambda t: [(i, X.tokens(c), hashlib.sha256(c.encode()).hexdigest()) for i, c in enumerate(each(t))], fields, "chunk int, tokens int, sha string")


def packed_chunks(spark, d):
    return _listed(spark, d, lambda t: X.packed(X.sentences(t)))


def semantic_chunks(spark, d):
    return _listed(spark, d, X.semantic)


def delta_roundtrip(spark, d):
    """Each document's text turned into its reverse: the steps that takes, and whether they give it back."""
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("old"), F.reverse("text").alias("new"))
    fields = {"steps": pa.int32(), "exact": pa.bool_()}
    return X.mapped(docs, "doc_id", ["old", "new"], lambda a, b: [(len(s := X.delta(a, b)), X.applied(a, s) == b)], fields, "steps int, exact boolean")


def doc_tree(spark, d):
    """Documents as rich text: a paragraph for the text, with a tag, a mention mark and an entity."""
    body = F.concat(
        F.lit('{"type":"doc","content":[{"type":"paragraph","content":['),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("text"))),
        F.lit(',{"type":"tag","attrs":{"label":"'), F.col("lang"), F.lit('"}},{"type":"text","text":"x","marks":[{"type":"mention","attrs":{"label":"'), F.col("source"),
        F.lit('"}}]},{"type":"entity","attrs":{"kind":"LANG","label":"'), F.col("lang"), F.lit('"}}]}]}'),
    )
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "{broken").otherwise(body).alias("body"))
    fields = {"text": pa.string(), "tags": pa.string(), "mentions": pa.string(), "entities": pa.int32()}
    return X.mapped(docs, "doc_id", ["body"], lambda b: [("".join((w := X.walked(b))["text"]), ",".join(w["tags"]), ",".join(w["mentions"]), len(w["entities"]))], fields, "text string, tags string, mentions string, entities int")


def _attributes(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", "event_type", k.alias("k"))


def attribute_defaults_merge(spark, d):
    """Per kind: the default, under an inline value, under a saved one."""
    defaults = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 3), ("signup", 4)], "event_type string, fallback int")
    a = _attributes(spark, d)
    saved = a.where("event_id % 5 = 0").select("event_id", (F.col("k") + 100).alias("saved"))
    inline = a.where("event_id % 3 = 0").select("event_id", F.col("k").alias("inline"))
    j = a.join(saved, "event_id", "left").join(inline, "event_id", "left").join(F.broadcast(defaults), "event_type", "left")
    return j.select("event_id", F.coalesce("saved", "inline", "fallback").alias("value"), F.when(F.col("saved").isNotNull(), "saved").when(F.col("inline").isNotNull(), "inline").when(F.col("fallback").isNotNull(), "default").otherwise("custom").alias("origin"))


def attribute_format(spark, d):
    k = F.col("k")
    p = F.round(k / 100 * 100).cast("int")
    return _attributes(spark, d).select("event_id", T.slug(F.concat(F.col("event_type"), F.lit("  Kind "), k.cast("string"))).alias("slug"), F.concat(F.least(p, F.lit(100)).cast("string"), F.lit("%")).alias("progress"), F.when(p > 66, "green").when(p > 33, "yellow").otherwise("red").alias("band"), F.concat(k.cast("string"), F.lit(" items")).alias("listed"))


QUERIES = {f.__name__: f for f in (sentence_chunks, fixed_chunks, packed_chunks, semantic_chunks, delta_roundtrip, doc_tree, attribute_defaults_merge, attribute_format)}

_TRIMMED = "select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents"

ORACLE_SQL = {
    "sentence_chunks": "with t as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as s from documents), u as (select doc_id, unnest(s) as s, generate_subscripts(s, 1) - 1 as chunk from t) select doc_id, cast(chunk as integer) as chunk, sha256(s) as sha from u",
    "attribute_defaults_merge": "with a as (select event_id, event_type, cast(json_extract(props, '$.k') as integer) as k from events), b as (select event_id, case when event_id % 5 = 0 then k + 100 end as saved, case when event_id % 3 = 0 then k end as inl, case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'signup' then 4 end as def from a) select event_id, coalesce(saved, inl, def) as value, case when saved is not null then 'saved' when inl is not null then 'inline' when def is not null then 'default' else 'custom' end as origin from b",
    "attribute_format": "with a as (select event_id, event_type, cast(json_extract(props, '$.k') as integer) as k from events) select event_id, 'entity-' || event_type || '-kind-' || k as slug, least(k, 100) || '%' as progress, case when k > 66 then 'green' when k > 33 then 'yellow' else 'red' end as band, k || ' items' as listed from a",
    "fixed_chunks": f"with recursive {windows_sql(_TRIMMED, 'doc_id')} select doc_id, chunk, start, \"end\", sha256(text) as sha from w",
    "packed_chunks": """with recursive t as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as s from documents),
r(doc_id, i, chunk, size) as (select doc_id, 1, 0, length(s[1]) from t where len(s) > 0 union all select r.doc_id, i + 1, case when ceil(size / 4.0) + ceil(length(s[i + 1]) / 4.0) <= 500 then chunk else chunk + 1 end, case when ceil(size / 4.0) + ceil(length(s[i + 1]) / 4.0) <= 500 then size + 1 + length(s[i + 1]) else length(s[i + 1]) end from r join t on t.doc_id = r.doc_id where i < len(s)),
c as (select r.doc_id, chunk, string_agg(s[i], ' ' order by i) as text from r join t on t.doc_id = r.doc_id group by 1, 2) select doc_id, cast(chunk as integer) as chunk, cast(ceil(length(text) / 4.0) as integer) as tokens, sha256(text) as sha from c""",
    "doc_tree": "select doc_id, case when doc_id % 9 = 0 then '' else text || 'x' end as text, case when doc_id % 9 = 0 then '' else lang end as tags, case when doc_id % 9 = 0 then '' else source end as mentions, cast(case when doc_id % 9 = 0 then 0 else 1 end as integer) as entities from documents",
}
