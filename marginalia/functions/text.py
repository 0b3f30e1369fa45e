"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def preprocess(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed: what lexical search indexes."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def preprocess_embed(c: Column) -> Column:
    """White space collapsed, everything but ASCII word characters and plain punctuation dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\w\s.,!?;:-]", ""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\w+"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0))


def substring_count(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def query_tokens(c: Column) -> Column:
    """Lower case, other than word characters and white space to blanks, split, empty ones dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Parts between runs of . ! ?, trimmed, empty ones dropped."""
    parts = F.transform(F.split(c, r"[.!?]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def masked_sentences(c: Column, abbreviations: tuple[str, ...]) -> Column:
    """sentences() in which the full stops of abbreviations (given without their last one) end nothing."""
    for a in abbreviations:
        masked = f"{a}.".replace(".", "\u00b6")
        c = F.regexp_replace(c, r"\b" + re.escape(a) + r"\.", masked)
    return F.transform(sentences(c), lambda x: F.replace(x, F.lit("\u00b6"), F.lit(".")))


def chunk_text(c: Column) -> Column:
    """Single line feeds between other characters to blanks, then runs of white space to one."""
    return F.regexp_replace(F.regexp_replace(c, r"([^\n])\n([^\n])", "$1 $2"), r"\s{2,}", " ")


def prefixed(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}: "), c) if prefix.strip() else c


def unprefixed(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, rf"^{re.escape(prefix)}:\s*", "") if prefix.strip() else c


#: Letters with marks and the letters they stand on, from the Unicode decompositions of Latin, Greek and Cyrillic.
_MARKED = {chr(i): d[0] for i in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)) if (d := unicodedata.normalize("NFD", chr(i))) != chr(i) and all(unicodedata.combining(x) for x in d[1:])}


def without_marks(c: Column) -> Column:
    """Diacritics taken off, and combining marks dropped."""
    return F.regexp_replace(F.translate(c, "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}", "")


def clean_for_entities(c: Column) -> Column:
    return F.trim(without_marks(F.regexp_replace(c, "<[^>]*>", "")))


def approximate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def snippet(c: Column, n: int) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]*>", ""))


def text_confidence(c: Column) -> Column:
    """0.5, and 0.2 for 5 words or more, 0.1 for 2 sentences or more, 0.2 for a capitalised word inside, at most 1."""
    inside = c.rlike(r"[a-z,;] [A-Z][a-z]+")
    score = F.lit(0.5) + F.when(word_count(c) >= 5, 0.2).otherwise(0.0) + F.when(F.size(sentences(c)) >= 2, 0.1).otherwise(0.0) + F.when(inside, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score)


# Inline syntax. The marks of tags, mentions, wiki links, cross links, highlights, entities, triples.
TAG, MENTION, WIKI, CROSS, HIGHLIGHT = r"#(\w+)", r"@(\w+)", r"\[\[([^\]]+)\]\]", r"<<([^>]+)>>", r"==([^=]+)=="
ENTITY = r"\[([^|\]]+)\|([^|\]]+)(?:\|(\{.*?\}))?\]"
TRIPLE = ENTITY + r"\s*\(([^)]+)\)\s*" + ENTITY


def inline(c: Column) -> Column:
    """Struct of tags, mentions, wiki, cross, entities and triples. Rules consume text in the order triple, entity,
    tag, mention, wiki link, cross link, so that an entity inside a triple, or a wiki link's alias, counts once."""
    links_kept = F.regexp_replace(c, WIKI, " ")
    no_triples = F.regexp_replace(links_kept, TRIPLE, " ")
    no_entities = F.regexp_replace(F.regexp_replace(c, TRIPLE, " "), r"(?<!\[)" + ENTITY, " ")
    no_tags = F.regexp_replace(no_entities, TAG, " ")
    no_mentions = F.regexp_replace(no_tags, MENTION, " ")
    return F.struct(
        F.regexp_extract_all(links_kept, F.lit(TRIPLE), F.lit(0)).alias("triples"),
        F.regexp_extract_all(no_triples, F.lit(ENTITY), F.lit(0)).alias("entities"),
        F.regexp_extract_all(no_entities, F.lit(TAG), F.lit(1)).alias("tags"),
        F.regexp_extract_all(no_tags, F.lit(MENTION), F.lit(1)).alias("mentions"),
        F.regexp_extract_all(no_mentions, F.lit(WIKI), F.lit(1)).alias("wiki"),
        F.regexp_extract_all(no_mentions, F.lit(CROSS), F.lit(1)).alias("cross"),
    )


def wiki_title(href: Column) -> Column:
    """The percent-decoded title of a /wiki/ address, else null."""
    raw = F.regexp_replace(F.regexp_extract(href, "/wiki/(.+)", 1), r"\+", "%2B")
    return F.when(href.rlike("/wiki/.+"), F.try_url_decode(raw))


def slug(c: Column) -> Column:
    return F.concat(F.lit("entity-"), F.regexp_replace(F.lower(c), r"\s+", "-"))


def entity_mark(kind: Column, label: Column, attributes: Column | None = None) -> Column:
    """An entity as inline text: [kind|label], or [kind|label|{json}]."""
    rest = F.lit("") if attributes is None else F.coalesce(F.concat(F.lit("|"), attributes), F.lit(""))
    return F.concat(F.lit("["), kind, F.lit("|"), label, rest, F.lit("]"))


def triple_mark(subject: Column, predicate: Column, target: Column) -> Column:
    return F.concat(subject, F.lit(" ("), predicate, F.lit(") "), target)


def entity_icon(kind: Column) -> Column:
    """The icon of an entity type, by what its name has in it."""
    k = F.lower(kind)
    return F.when(F.contains(k, F.lit("person")), "users").when(F.contains(k, F.lit("org")), "building").when(k.rlike("loc|gpe"), "map-pin").when(k.rlike("date|time"), "calendar").otherwise("hash")


def since(then: Column, now: Column) -> Column:
    """How long ago in words, to the largest whole unit."""
    s = F.unix_seconds(now) - F.unix_seconds(then)
    out = F.lit("just now")
    for unit, n in (("minute", 60), ("hour", 3600), ("day", 86400), ("month", 30 * 86400), ("year", 365 * 86400)):
        k = F.floor(s / n)
        out = F.when(k >= 1, F.concat(k.cast("string"), F.lit(f" {unit}"), F.when(k > 1, "s").otherwise(""), F.lit(" ago"))).otherwise(out)
    return out


def data_uri(c: Column) -> tuple[Column, Column]:
    """Media type and bytes of a base64 data address; nulls where it is none."""
    ok = c.rlike("^data:[^;,]+;base64,[A-Za-z0-9+/=]*$")
    return F.when(ok, F.regexp_extract(c, ":(.*?);", 1)), F.when(ok, F.unbase64(F.regexp_extract(c, ",(.*)$", 1)))


def samples(values: Column) -> Column:
    """16-bit samples of an array of numbers: held between -1 and 1, times 32767, towards zero."""
    return F.transform(values, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int"))


def _little(x: Column, size: int) -> Column:
    h = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 8 * size))), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def wav(values: Column, rate: int = 24000) -> Column:
    """A mono 16-bit WAV file of an array of numbers: 44 bytes of header, then the samples."""
    body = F.array_join(F.transform(samples(values), lambda x: _little(x, 2)), "")
    n = F.size(values) * 2
    head = [F.hex(F.lit("RIFF")), _little(n + 36, 4), F.hex(F.lit("WAVEfmt ")), *[_little(F.lit(x), k) for x, k in ((16, 4), (1, 2), (1, 2), (rate, 4), (rate * 2, 4), (2, 2), (16, 2))], F.hex(F.lit("data")), _little(n, 4)]
    return F.unhex(F.concat(*head, body))


def format_bytes(c: Column) -> Column:
    """0 Bytes, or the number in the largest unit of 1024s below it, to two places without trailing zeros."""
    i = F.when(c > 0, F.floor(F.log(1024.0, c.cast("double")))).otherwise(0)
    unit = F.get(F.array(*[F.lit(x) for x in ("Bytes", "KB", "MB", "GB", "TB")]), i.cast("int"))
    return F.when(c == 0, "0 Bytes").otherwise(F.concat(F.regexp_replace(F.round(c / F.pow(F.lit(1024.0), i), 2).cast("string"), r"\.0$", ""), F.lit(" "), unit))
