"""Document fingerprints by winnowing, and how alike they are, in SQL functions only.

Words are runs of characters other than ASCII white space, unchanged, each with a 64-bit hash. Every run of k words has
a rolling hash, of which 33 bits count: the one before rotated by a bit, without the word that leaves and with the one
that comes (a cyclic polynomial). An array function can't carry a value along a whole text without copying what it has
made so far, so the hash rolls on for BLOCK runs and then starts anew. A text of fewer words, but not none, is one run. Every `window` neighbouring runs choose the
smallest hash, the rightmost of equal ones; the chosen hashes and the word positions they stand at are the
fingerprint (a text of fewer runs is one window). Two texts that share window + k - 1 words share a fingerprint, and
fingerprints never come from less than k equal words.

A fingerprint is kept as one long: the hash's 33 bits over 2**30 - 1 - position, so that the smallest long of a
window is its rightmost smallest hash; a text has fewer than 2**30 words, as it has fewer than 2**31 bytes. Likeness is
the Jaccard similarity of the two sets of hashes; of two empty sets, 1.

with_next() puts each document beside the next one by id without a global sort: approximate quantiles of the ids
(at most MAX_RANGES) cut the table into ranges, one partition each, and the first document of a range goes to the
range before it too, that of the first to the last. The texts are shuffled once. The driver gets two numbers for each
range. A range is range_bytes of text up to a terabyte in all, and grows from there: 1.6 GB at 100 TB, one sort that
spills.

Nulls and edge cases: a null text is an empty one; null ids come first; rows of one id are ordered by their texts; a
table of one row follows itself; an empty text has an empty fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_text

K, WINDOW = 5, 8
BLOCK = 64
RANGE_BYTES, MAX_RANGES = 16 << 20, 1 << 16
_POSITION = 2**30 - 1


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return bound(trimmed, lambda t: F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def rotated(x: Column, n: int) -> Column:
    """x with its bits moved n to the left, those that leave coming in at the right."""
    n %= 64
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n else x


def rolling(h: Column, k: int) -> Column:
    """The hash of each run of k neighbours in an array of hashes, each made from the one before within a block."""
    none = F.expr("cast(array() as array<bigint>)")

    def whole(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: rotated(s, 1).bitwiseXOR(x))

    def block(start: Column) -> Column:
        last = start + F.least(F.lit(BLOCK), F.size(h) - (k - 1) - start) - 1

        def roll(made: Column, i: Column) -> Column:
            on = rotated(F.get(made, i - start - 1), 1).bitwiseXOR(rotated(F.get(h, i - 1), k)).bitwiseXOR(F.get(h, i + k - 1))
            return F.array_append(made, F.when(i == start, whole(F.slice(h, i + 1, k))).otherwise(on))

        return F.aggregate(F.sequence(start, last), none, roll)

    many = F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - k, F.lit(BLOCK)), block))
    return F.when(F.size(h) >= k, many).when(F.size(h) > 0, F.array(whole(h))).otherwise(none)


def prints(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of a text as longs, in the order of their positions."""

    def keyed(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 31), 30).bitwiseOR(F.lit(_POSITION) - i.cast("long")))

    def hashes(w: Column) -> Column:
        return F.transform(w, lambda x: F.xxhash64(x))

    def chosen(r: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(r) - (window - 1)), lambda i: F.array_min(F.slice(r, i, window)))
        return F.when(F.size(r) >= window, F.array_distinct(each)).when(F.size(r) > 0, F.array(F.array_min(r))).otherwise(r)

    return bound(bound(hashes(words(text)), lambda h: keyed(rolling(h, k))), chosen)


def hash_of(p: Column) -> Column:
    return F.shiftright(p, 30)


def position_of(p: Column) -> Column:
    return F.lit(_POSITION) - p.bitwiseAND(F.lit(_POSITION))


def likeness(a: Column, b: Column) -> Column:
    def sets(x: Column) -> Column:
        return F.array_distinct(F.transform(x, hash_of))

    def jaccard(s: Column) -> Column:
        x, y = F.get(s, 0), F.get(s, 1)
        return bound(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))

    return bound(F.array(sets(a), sets(b)), jaccard)


def as_string(p: Column) -> Column:
    """hash:position of each, comma-joined; hashes in hexadecimal."""
    return F.concat_ws(",", F.transform(p, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit(":"), position_of(x).cast("string"))))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(listed, at + s - 1) < key, F.lit(False)), at + s).otherwise(at))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, Window]:
    """__id, __text, __next (the next row's text), __copy (rows that only stand in for a neighbour), and the window
    over which more can be looked up in the next row."""
    rows = keyed_text(docs, id_col, text_col).select("__id", F.coalesce("__text", F.lit("")).alias("__text"), F.coalesce(F.col("__id").cast("long"), F.lit(-(2**63))).alias("__key"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    n = min(MAX_RANGES, max(1, -(-total // range_bytes)))
    cuts = rows.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(cuts or ()))
    rows = rows.withColumn("__range", _range_of(F.col("__key"), bounds))
    firsts = {r["__range"]: r["low"] for r in rows.groupBy("__range").agg(F.min("__key").alias("low")).collect()}
    used = sorted(firsts)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    count = len(bounds) + 1
    low = F.from_json(F.lit(json.dumps([firsts.get(r) for r in range(count)])), "array<bigint>")
    prior = F.from_json(F.lit(json.dumps([before.get(r) for r in range(count)])), "array<int>")
    here = F.struct(F.col("__range").alias("r"), F.lit(False).alias("c"))
    there = F.struct(F.get(prior, F.col("__range")).alias("r"), F.lit(True).alias("c"))
    placed = rows.select("__id", "__text", "__key", F.inline(F.when(F.get(low, F.col("__range")) == F.col("__key"), F.array(here, there)).otherwise(F.array(here))).alias("__place", "__copy"))
    placed = placed.repartitionById(count, F.col("__place"))
    order = Window.partitionBy("__place").orderBy("__copy", "__key", "__text")
    return placed.withColumn("__next", F.lead("__text").over(order)), order


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, share: int = 4, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """id_col, n_chars, prints, edited (the text with its last n_chars // share characters replaced by the next
    document's first as many, or all), edited_prints, near_edited and near_next."""
    if k < 1 or window < 1 or share < 1:
        raise ValueError("k, window and share must be 1 or more")
    rows, order = with_next(docs, id_col, text_col, range_bytes)
    n = F.char_length("__text")
    cut = (n / share).cast("int")
    edited = F.concat(F.left("__text", n - cut), F.left(F.coalesce("__next", F.lit("")), cut))
    rows = rows.select("__id", "__key", "__text", "__place", "__copy", n.cast("long").alias("n_chars"), prints(F.col("__text"), k, window).alias("prints"), edited.alias("edited"))
    rows = rows.withColumn("edited_prints", F.when(~F.col("__copy"), prints(F.col("edited"), k, window)))
    rows = rows.withColumn("__after", F.lead("prints").over(order)).where("not __copy")
    near = likeness(F.col("prints"), F.col("edited_prints")), likeness(F.col("prints"), F.coalesce("__after", F.expr("cast(array() as array<bigint>)")))
    return rows.select(F.col("__id").alias(id_col), "n_chars", "prints", "edited", "edited_prints", near[0].alias("near_edited"), near[1].alias("near_next"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns."""
    rows = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("prints")).alias("fingerprint"), as_string(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next")
