"""Queries of lexical, positional and hybrid search, and of the text functions, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import inverted as I
from ..operators import lexical as L
from ..sources.tables import notes, table

QUERY = "the thing with that, the other"
POSITIONAL = "the and that the with"


def _corpus(spark, d):
    n = notes(table(spark, d, "documents"))
    return n.select(F.col("ordinal").alias("id"), "title", "content", T.preprocess(F.concat_ws(" ", "title", "content")).alias("doc"))


def bm25_topk(spark, d):
    c = _plain(spark, d)
    best = L.top(L.bm25(c, QUERY), 10, positive=True)
    told = c.select("id", "title", T.snippet(F.col("content"), 200).alias("snippet"))
    return told.join(F.broadcast(best), "id").select("id", "title", "snippet", F.round("score", 6).alias("score"))


def bm25_multi_query(spark, d):
    """The whole text of each benchmark item is a query."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return L.bm25_tokens(_plain(spark, d), q).select("query_id", "id", F.round("score", 6).alias("score"))


def _kept_index(spark, d):
    """The corpus in a kept index, saved in three parts, of which the last has documents that are there with another text."""
    c, index = _plain(spark, d), I.InvertedIndex(spark)
    index.add(c.where("id % 2 = 0").withColumn("doc", F.when(F.col("id") % 10 == 0, F.lit("an older text of the thing")).otherwise(F.col("doc"))))
    index.add(c.where("id % 2 = 1"))
    index.add(c.where("id % 10 = 0"))
    return index


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.preprocess(F.col("text")).alias("query"))


def bm25_index_topk(spark, d):
    """The ten best documents for the whole text of each benchmark item, from the kept index."""
    best, _ = _kept_index(spark, d).topk(_asked(spark, d))
    return best.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def bm25_index_removed(spark, d):
    """The same once each third document is taken out, and the segments are merged."""
    index = _kept_index(spark, d)
    index.remove(_plain(spark, d).where("id % 3 = 0").select("id"))
    index.merge()
    best, _ = index.topk(_asked(spark, d))
    return best.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def bm25_index_status(spark, d):
    c = _corpus(spark, d)
    terms = c.select(F.explode(T.words(F.col("doc"))).alias("t")).distinct().agg(F.count(F.lit(1)).alias("terms"))
    return c.agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(T.word_count(F.col("doc"))), 6).alias("mean_length")).withColumn("terms", terms.scalar())


def text_filter(spark, d):
    n = notes(table(spark, d, "documents"))
    q = "Thor".lower()
    return n.where(F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("content"), F.lit(q))).select("id", "title", T.snippet(F.col("content"), 80).alias("preview"))


def search_roots(spark, d):
    """Root items whose title has the words, or that are notes whose content has them; half the notes lie in folders."""
    n = notes(table(spark, d, "documents")).select("id", "title", "content", F.when(F.col("ordinal") % 2 == 0, F.col("parent_id")).alias("parent_id"), F.lit("note").alias("type"))
    f = table(spark, d, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("id"), F.initcap("n_name").alias("title"), F.lit("THE CONTENT").alias("content"), F.lit(None).cast("string").alias("parent_id"), F.lit("folder").alias("type"))
    q = F.lit("The".lower())
    return n.union(f).where("parent_id is null").where(F.contains(F.lower("title"), q) | ((F.col("type") == "note") & F.contains(F.lower("content"), q))).select("id", "title", "type")


def _plain(spark, d):
    """The corpus with texts in lower case alone: words, and terms without white space, are the same in collapsed ones."""
    n = notes(table(spark, d, "documents"))
    return n.select(F.col("ordinal").alias("id"), "title", "content", F.lower(F.concat_ws(" ", "title", "content")).alias("doc"))


def _index(spark, d, only=None):
    return L.postings(_plain(spark, d).select("id", F.col("content").alias("doc")), only=only)


def qps_postings(spark, d):
    return _index(spark, d).select("id", "token", "freq", "mask", "tokens")


def qps_topk(spark, d):
    return L.top(L.positional_search(_index(spark, d, POSITIONAL.split()), POSITIONAL), 20).select("id", F.round("score", 6).alias("score"))


def qps_status(spark, d):
    i = _index(spark, d)
    return i.groupBy("token").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("postings"))


def _dense(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id = 0").select("embedding")
    return e.withColumn("q", q.scalar()).select("id", V.cosine(F.col("embedding"), F.col("q"), F.lit(0.0)).alias("score"))


def hybrid_topk(spark, d):
    f = L.fuse(L.bm25(_plain(spark, d), QUERY), _dense(spark, d), 0.5, 10)
    return f.select("id", *[F.round(c, 6).alias(c) for c in ("sparse_score", "dense_score", "score")])


def text_preprocess(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(T.preprocess_embed(t), 256).alias("embed_sha"), F.length(T.preprocess_embed(t)).alias("embed_length"), F.sha2(T.preprocess(t), 256).alias("lexical_sha"))


def token_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.word_count(t).alias("words"), F.size(T.query_tokens(t)).alias("query_tokens"), F.size(T.sentences(t)).alias("sentences"), T.approximate_tokens(t).alias("approximate"), T.substring_count(F.lower(t), "the").alias("the"))


def text_confidence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.text_confidence(F.col("text")), 6).alias("confidence"))


def extract_syntax(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.inline(F.col("text")).alias("x"))
    return x.select("doc_id", F.array_join("x.tags", ",").alias("tags"), F.array_join("x.mentions", ",").alias("mentions"), F.size("x.wiki").alias("wiki"), F.size("x.cross").alias("cross"))


def extract_tags(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.TAG), F.lit(1)))).alias("tag"))
    return t


def extract_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.MENTION), F.lit(1)))).alias("mention"))


def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("times"))


def strip_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.strip_html(F.col("html")), 256).alias("text_sha"), F.length(T.strip_html(F.col("html"))).alias("length"))


def sha256_checksum(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.left(F.base64(F.encode(t, "utf-8")), F.lit(16)).alias("short"))


def title_extraction(spark, d):
    first = F.trim(F.substring_index("text", "\n", 1))
    ok = F.length(first).between(1, 100)
    long = F.concat(F.trim(F.left("text", F.lit(50))), F.when(F.length("text") > 50, "...").otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.when(ok, first).otherwise(long).alias("title"))


def size_labels(spark, d):
    n = F.octet_length("text")
    p = F.least(F.lit(100.0), n / (5 * 1024 * 1024) * 100)
    band = F.when(p > 66, "high").when(p > 33, "middle").otherwise("low")
    return table(spark, d, "documents").select("doc_id", T.format_bytes(n).alias("size"), F.round(p, 6).alias("percent"), band.alias("band"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_multi_query, bm25_index_topk, bm25_index_removed, bm25_index_status, text_filter, search_roots, qps_postings, qps_topk, qps_status, hybrid_topk, text_preprocess, token_counts, text_confidence, extract_syntax, extract_tags, extract_mentions, page_links, strip_html_text, sha256_checksum, title_extraction, size_labels)}

_CORPUS = "corpus as (select doc_id as id, source || '-' || doc_id as title, text as content, trim(regexp_replace(lower(source || '-' || doc_id || ' ' || text), '\\s+', ' ', 'g')) as doc from documents)"
_TERMS = ("the", "thing", "with", "that", "other")


def _bm25_sql() -> str:
    df = ", ".join(f"sum(case when contains(doc, '{t}') then 1 else 0 end) as df{i}" for i, t in enumerate(_TERMS))
    tf = ", ".join(f"(length(doc) - length(replace(doc, '{t}', ''))) / {len(t)} as tf{i}" for i, t in enumerate(_TERMS))
    times = [2, 1, 1, 1, 1]
    score = " + ".join(f"{times[i]} * ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(_TERMS)))
    return f"{_CORPUS}, stats as (select count(*) as n, avg(length(regexp_extract_all(doc, '\\w+'))) as mean, {df} from corpus), parts as (select id, title, content, length(regexp_extract_all(doc, '\\w+')) as len, {tf} from corpus), scored as (select id, title, content, {score} as score from parts, stats)"


_SENTENCES = """words as (select id, list_filter(list_transform(string_split_regex(content, '[.!?]+'), lambda s: list_filter(string_split_regex(regexp_replace(lower(s), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')), lambda x: len(x) > 0) as s from corpus),
numbered as (select id, unnest(s) as w, generate_subscripts(s, 1) as pos from words),
placed as (select id, w, least(15, coalesce(sum(case when len(w) > 1 then 1 else 0 end) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0)) as seg, sum(len(w)) over (partition by id) as tokens from numbered),
tokens as (select id, unnest(w) as token, seg, tokens from placed),
postings as (select id, token, count(*) as freq, cast(bit_or(cast(1 as integer) << cast(seg as integer)) as integer) as mask, cast(max(tokens) as integer) as tokens from tokens group by id, token)"""

ORACLE_SQL = {
    "bm25_topk": f"with {_bm25_sql()} select id, title, substring(content, 1, 200) || '...' as snippet, round(score, 6) as score from scored where score > 0 order by scored.score desc, id limit 10",
    "bm25_multi_query": f"""with {_CORPUS}, lens as (select id, len(regexp_extract_all(doc, '\\w+')) as len from corpus), stats as (select count(*) as n, avg(len) as mean from lens),
q as (select item_id as query_id, unnest(regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\w+')) as token from benchmark),
wanted as (select query_id, token, count(*) as times from q group by 1, 2),
tok as (select id, unnest(regexp_extract_all(doc, '\\w+')) as token from corpus), freq as (select id, token, count(*) as tf from tok where token in (select token from q) group by 1, 2),
dfs as (select token, count(*) as df from freq group by 1)
select query_id, freq.id as id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from freq join dfs using (token) join wanted using (token) join lens on lens.id = freq.id, stats group by query_id, freq.id""",
    "bm25_index_status": f"with {_CORPUS}, t as (select unnest(regexp_extract_all(doc, '\\w+')) as t from corpus) select count(*) as docs, round(avg(len(regexp_extract_all(doc, '\\w+'))), 6) as mean_length, (select count(distinct t) from t) as terms from corpus",
    "text_filter": "select cast(doc_id as varchar) as id, source || '-' || doc_id as title, substring(text, 1, 80) || '...' as preview from documents where contains(lower(source || '-' || doc_id), 'thor') or contains(lower(text), 'thor')",
    "qps_postings": f"with {_CORPUS}, {_SENTENCES} select id, token, freq, mask, tokens from postings",
    "qps_topk": f"""with {_CORPUS}, {_SENTENCES}, asked(turn, token) as (values (0, 'the'), (1, 'and'), (2, 'that'), (3, 'the'), (4, 'with')),
hits as (select id, turn, freq, mask, tokens, coalesce(bit_or(mask) over (partition by id order by turn rows between unbounded preceding and 1 preceding), 0) as prior from postings join asked using (token))
select id, round(sum(freq * freq / cast(tokens as double) + 1 + 0.5 * bit_count(prior & mask)), 6) as score from hits group by id order by sum(freq * freq / cast(tokens as double) + 1 + 0.5 * bit_count(prior & mask)) desc, id limit 20""",
    "qps_status": f"with {_CORPUS}, {_SENTENCES} select count(distinct token) as tokens, count(*) as postings from postings",
    "hybrid_topk": f"""with {_bm25_sql()}, sp as (select id, score from scored where score > 0 order by score desc, id limit 30),
e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), q as (select v as qv from e where id = 0),
cs as (select id, coalesce(list_dot_product(v, qv) / nullif(sqrt(list_dot_product(v, v) * list_dot_product(qv, qv)), 0), 0) as score from e, q), de as (select id, score from cs order by score desc, id limit 30),
s2 as (select id, case when (select max(score) from sp) > 0 then score / (select max(score) from sp) else 0.0 end as sparse_score from sp), d2 as (select id, case when (select max(score) from de) > 0 then score / (select max(score) from de) else 0.0 end as dense_score from de),
f as (select coalesce(s2.id, d2.id) as id, sparse_score, dense_score, 0.5 * coalesce(sparse_score, 0.0) + 0.5 * coalesce(dense_score, 0.0) as score from s2 full outer join d2 on s2.id = d2.id)
select id, round(sparse_score, 6) as sparse_score, round(dense_score, 6) as dense_score, round(f.score, 6) as score from f order by f.score desc, id limit 10""",
    "text_preprocess": "with t as (select doc_id, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\w\\s.,!?;:-]', '', 'g')) as e, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as l from documents) select doc_id, sha256(e) as embed_sha, cast(length(e) as integer) as embed_length, sha256(l) as lexical_sha from t",
    "token_counts": "select doc_id, cast(len(regexp_extract_all(text, '\\w+')) as integer) as words, cast(len(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) as integer) as query_tokens, cast(len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) as integer) as sentences, cast(ceil(length(text) / 4.0) as bigint) as approximate, cast((length(text) - length(replace(lower(text), 'the', ''))) / 3 as bigint) as the from documents",
    "text_confidence": "select doc_id, cast(round(least(1.0, 0.5 + case when len(regexp_extract_all(text, '\\w+')) >= 5 then 0.2 else 0 end + case when len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) >= 2 then 0.1 else 0 end + case when regexp_matches(text, '[a-z,;] [A-Z][a-z]+') then 0.2 else 0 end), 6) as double) as confidence from documents",
    "extract_tags": "select distinct doc_id, unnest(regexp_extract_all(text, '#(\\w+)', 1)) as tag from documents",
    "extract_mentions": "select distinct doc_id, unnest(regexp_extract_all(text, '@(\\w+)', 1)) as mention from documents",
    "page_links": "with t as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) select page_id, href, count(*) as times from t group by 1, 2",
    "strip_html_text": "select page_id, sha256(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) as text_sha, cast(length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) as integer) as length from pages",
    "sha256_checksum": "select doc_id, sha256(text) as sha, substring(base64(encode(text)), 1, 16) as short from documents",
    "title_extraction": "with t as (select doc_id, text, trim(split_part(text, chr(10), 1)) as f from documents) select doc_id, case when length(f) between 1 and 100 then f else trim(substring(text, 1, 50)) || case when length(text) > 50 then '...' else '' end end as title from t",
    "search_roots": "select cast(doc_id as varchar) as id, source || '-' || doc_id as title, 'note' as type from documents where doc_id % 2 = 1 and (contains(lower(source || '-' || doc_id), 'the') or contains(lower(text), 'the')) union all select 'f' || n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), 'folder' from nation where contains(lower(n_name), 'the')",
    "size_labels": "with t as (select doc_id, strlen(text) as n from documents), u as (select *, case when n > 0 then cast(floor(ln(n) / ln(1024)) as integer) else 0 end as i from t) select doc_id, case when n = 0 then '0 Bytes' else regexp_replace(cast(round(n / pow(1024, i), 2) as varchar), '\\.0$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB', 'TB'][i + 1] end as size, round(least(100.0, n / 5242880.0 * 100), 6) as percent, case when n / 5242880.0 * 100 > 66 then 'high' when n / 5242880.0 * 100 > 33 then 'middle' else 'low' end as band from u",
    "extract_syntax": "with a as (select doc_id, regexp_replace(text, '#(\\w+)', ' ', 'g') as no_tags, array_to_string(regexp_extract_all(text, '#(\\w+)', 1), ',') as tags from documents), b as (select *, array_to_string(regexp_extract_all(no_tags, '@(\\w+)', 1), ',') as mentions, regexp_replace(no_tags, '@(\\w+)', ' ', 'g') as rest from a) select doc_id, tags, mentions, cast(len(regexp_extract_all(rest, '\\[\\[([^\\]]+)\\]\\]')) as integer) as wiki, cast(len(regexp_extract_all(rest, '<<([^>]+)>>')) as integer) as cross from b",
}


def _index_sql(live: str) -> str:
    every = ORACLE_SQL["bm25_multi_query"].replace("from documents)", f"from documents where {live})", 1)
    score = every.split("freq.id as id, round(")[1].split(", 6) as score")[0]
    every = every.replace(f"round({score}, 6) as score", f"round({score}, 10) as score")
    return f"select query_id, id, cast(rank as integer) as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from ({every})) where rank <= 10"


ORACLE_SQL["bm25_index_topk"] = _index_sql("true")
ORACLE_SQL["bm25_index_removed"] = _index_sql("doc_id % 3 <> 0")
