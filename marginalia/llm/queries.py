"""The queries of this subpackage for __spark_entry__.py, and SQL for those that SQL can express."""

from __future__ import annotations

from .conversations import op13_conversation_repair
from .decontaminate import op9_decontamination
from .fingerprints import op8_fingerprints
from .near_duplicates import op5_jaccard_join
from .packing import op4_packing
from .pii import op2_pii
from .sentence_pieces import op12_sentencepiece
from .sharding import op10_sharding
from .substrings import op7_substring_dedup
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity
from .url_filter import op1_url_filters
from .vector_codes import op11_vector_codes

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_conversation_repair": op13_conversation_repair,
}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round: the nearest entry of each part, then floor(sum / count) of each entry's parts."""
    d = "list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] - e[i]) * (x[i] - e[i])))"
    sql = f"""with v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) as x from v, range({parts}) r(part)),
c0 as materialized (select part, rank() over (partition by part order by vec_id) - 1 as entry, x as e from p qualify entry < {entries})"""
    for r in range(rounds + 1):
        sql += f""",
a{r} as materialized (select vec_id, part, any_value(label) as label, any_value(x) as x, min({{'d': d, 'entry': entry}}) as best from (select vec_id, label, p.part, x, entry, {d} as d from p join c{r} on p.part = c{r}.part) group by vec_id, part)"""
        if r < rounds:
            sql += f""",
s{r} as (select part, entry, pos, cast(floor(sum(v) / count(*)) as bigint) as m from (select part, best.entry as entry, unnest(x) as v, generate_subscripts(x, 1) as pos from a{r}) group by all),
m{r} as (select part, entry, list(m order by pos) as e from s{r} group by part, entry),
c{r + 1} as materialized (select c{r}.part, c{r}.entry, coalesce(m{r}.e, c{r}.e) as e from c{r} left join m{r} on m{r}.part = c{r}.part and m{r}.entry = c{r}.entry)"""
    return sql + f""",
told as (select vec_id, any_value(label) as label, string_agg(lower(lpad(hex(best.entry), 2, '0')), '' order by part) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) from c{rounds}) as codebooks_sha256 from told"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _vector_codes_sql(),
    "op9_decontamination": f"""with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where text is not null), s as (select item_id, w, least(10, len(w)) as size from i where len(w) > 0),
ip as (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as pos from s), iw as (select distinct item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as win from ip),
sizes as (select distinct size from iw), dp as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as pos from d, sizes where len(w) >= size),
dw as (select doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as win from dp),
hits as (select dw.doc_id, dw.pos, dw.size, iw.item_id from dw join iw on dw.size = iw.size and dw.win = iw.win),
spots as (select distinct doc_id, size, pos from hits), covered as (select distinct doc_id, unnest(range(pos, pos + size)) as at_word from spots), n as (select doc_id, count(*) as n_hit from covered group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join n on n.doc_id = d.doc_id left join items on items.doc_id = d.doc_id""",
    "op7_substring_dedup": r"""with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as pos from d where len(w) >= 50),
x as (select doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 49), ' ')) as h from p), m as (select h, min(doc_id) as low from x group by h),
c as (select distinct x.doc_id, unnest(range(x.pos, x.pos + 50)) as at_word from x join m on x.h = m.h where x.doc_id > m.low), n as (select doc_id, count(*) as n_removed from c group by 1),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as idx from d),
k as (select words.doc_id, string_agg(word, ' ' order by idx) as kept from words left join c on c.doc_id = words.doc_id and c.at_word = words.idx where c.at_word is null group by words.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join n on n.doc_id = d.doc_id left join k on k.doc_id = d.doc_id""",
}
