"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Words are runs of characters other than ASCII white space, with A-Z lower-cased. A document's set holds its distinct
runs of k words (by 64-bit hashes); with fewer words, but some, the whole sequence is its one element. Two documents
link when 100 * |intersection| >= percent * |union|; an empty set links with nothing.

1. Frequencies. Every batch of texts sends its elements to hash buckets as packed arrays (the bytes of the hash that the
   bucket's number doesn't tell, 2 of the document's place in the batch), so one shuffle of 8 to 10 bytes an element
   counts all of them. An element that
   several documents of a batch have is sent once, with their number, so one that all documents have sends its bucket
   12 bytes for each 3 MB of text. Elements that one document alone has can't be shared: only the others go back to
   their batches, with their frequencies.
2. Classes. Documents with equal sets are one class under its smallest id; copies are not expanded.
3. Prefixes. A class of n elements needs t = ceil(percent * n / 100) in common with any partner. Ordered by frequency
   (unshared ones first), two partners share at least l elements of their first n - t + l. Each class chooses l by
   estimated cost: the frequencies in its prefix (postings to read) and these over l times a weight (candidates to
   verify). Classes with over n - t unshared elements drop out here.
4. Links. A pair is verified once its prefixes share enough elements: min(l, l'), or what is left of the elements that
   they must share when all beyond the longer prefix's end are taken as shared, if that is more. Members of one posting
   list first meet along two chains (by size, by hash), one pair for each entry, in parts of at most CHAIN entries, and
   the elements that their prefixes share are counted. That joins groups of near copies into components at a linear
   cost. While the entries outside their lists' largest components would still meet more than SPARE entries each on
   average, and one try in WORTH links, each meets neighbours in the largest one, a few pairs an entry (ROUNDS times at
   most). Then every pair of a list that lies in different components is met (a list's largest component meets the others
   only, not itself), if its sizes fit, if the elements that can still be shared before and after its place in both
   orders are enough to link, and so are those left when each bit of one's signature (the hashes of its shared elements
   in SIGNATURE bits) that the other's lacks is taken off; a pair's meetings over all lists are counted, and those that
   met often enough are verified. So no link between components is lost; links inside a component can't change it.

Verification compares the whole sets of hashes: |union| = n + n' - |intersection|. Among n distinct elements of a corpus
about n * n / 2**65 pairs have one hash; such a pair counts as one shared element, which decides a link only where the
similarity is at the threshold, or where both sets are that one element (of m such sets, m * m / 2**65 pairs).

Nulls and edge cases: a null or empty text has an empty set and is its own component; a null id links with nothing
and its component is null; ids are longs (or cast to longs); repeated rows are in one class; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import Scratch, keyed_text, text_bytes, written

K, PERCENT = 5, 80
MOST_L, CHAIN = 8, 4096
ROUNDS, SPARE, WORTH = 8, 4, 20
SIGNATURE = 1024
FEW = 200_000  # rows of some numbers each that are broadcast
BUCKET_BYTES = 6 << 20  # of text at most, for each bucket: a million elements or fewer
_ROWS = 60_000  # documents of a batch are numbered in 2 bytes
_SUMMED = 0xFFFF  # stands for all documents of a batch that have an element
_MOST_DF = 0xFFFF  # frequencies from here on are taken as alike: they only order elements and estimate costs
_OWN = np.dtype([("h", "<u8"), ("d", "<u2")])
_SUMS = np.dtype([("h", "<u8"), ("c", "<u4")])
_BACK = np.dtype([("token", "<u8"), ("df", "<u2"), ("d", "<u2")])


def _sent(lead: int) -> np.dtype:
    """What is sent of an element: its hash without the whole bytes that its bucket tells, and its document."""
    return np.dtype([("h", "u1", 8 - lead // 8), ("d", "<u2")])


def sets_of(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, element), distinct and sorted."""
    left, counts = w.left(), w.counts()
    of = w.text_of()
    at = np.flatnonzero(left >= k)
    texts, hashes = [of[at]], [w.windows(k)[at]]
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            texts.append(short)
            hashes.append(w.windows(size)[w.first[short]])
    texts, hashes = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    keep = np.append(True, (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1]))[: len(texts)]
    return texts[keep], hashes[keep]


_HOME = "own binary, ids array<bigint>, digests array<binary>, sizes array<int>, first array<int>"
_SENT_SCHEMA = f"bucket bigint, batch long, sent binary, sums binary, {_HOME}"
_BACK_SCHEMA = f"batch long, back binary, {_HOME}"
_HOME_TYPES = [("own", pa.binary()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("first", pa.list_(pa.int32()))]


def _cut(rows: np.ndarray, bucket: np.ndarray, used: np.ndarray) -> pa.Array:
    """The rows of each used bucket, packed; bucket is ascending."""
    offsets = np.searchsorted(bucket, np.append(used, np.iinfo(np.int64).max)) * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _sender(k: int, lead: int):
    """Elements to buckets by the first `lead` bits of their hashes."""
    kind, buckets = _sent(lead), 1 << lead
    schema = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("sent", pa.binary()), ("sums", pa.binary()), *_HOME_TYPES])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        w = W.words_of(*W.texts(W.column(part, "__text")), lower=True)
        texts, hashes = sets_of(w, k)
        sizes = np.bincount(texts, minlength=part.num_rows)
        ends = np.cumsum(sizes)
        ids = W.column(part, "__id").to_pylist()
        digests = [hashlib.blake2b(hashes[b - n : b].tobytes(), digest_size=16).digest() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        first: dict[bytes, int] = {}  # of equal sets in the batch, the one with the smallest id stands for all
        for i, (d, x) in enumerate(zip(digests, ids, strict=True)):
            if x is not None and (d not in first or x < ids[first[d]]):
                first[d] = i
        stands = np.zeros(part.num_rows, bool)
        stands[list(first.values())] = True
        batch = int.from_bytes(hashlib.blake2b(b"".join(digests) + repr(ids).encode(), digest_size=8).digest(), "little", signed=True)
        go = stands[texts]
        texts, hashes = texts[go], hashes[go]
        order = np.argsort(hashes, kind="stable")
        texts, hashes = texts[order], hashes[order]
        bucket = (hashes >> W.U(64 - lead) if lead else np.zeros(len(hashes), W.U)).astype(np.int64)
        new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(hashes)))
        lone, many = at[count == 1], at[count > 1]
        sent, sums = np.zeros(len(lone), kind), np.zeros(len(many), _SUMS)
        sent["h"], sent["d"] = hashes[lone].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - lead // 8], texts[lone]
        sums["h"], sums["c"] = hashes[many], count[count > 1]
        within = np.repeat(count > 1, count)  # what several documents of the batch have is sent once, and stays here
        own = np.zeros(int(within.sum()), _OWN)
        own["h"], own["d"] = hashes[within], texts[within]
        used = np.unique(bucket)
        n = len(used) + 1
        none = [None] * (n - 1)
        home = [own.tobytes(), ids, digests, sizes.tolist(), np.flatnonzero(stands).tolist()]
        nothing = pa.array([None], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(used, batch % buckets), pa.int64()),
                pa.array(np.full(n, batch), pa.int64()),
                pa.concat_arrays([_cut(sent, bucket[lone], used), nothing]),
                pa.concat_arrays([_cut(sums, bucket[many], used), nothing]),
                *[pa.array([*none, x], t) for x, (_, t) in zip(home, _HOME_TYPES, strict=True)],
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                for at in range(0, part.num_rows, _ROWS):
                    yield one(part.slice(at, _ROWS))

    return run


def _counter(lead: int):
    return lambda table: _counted_bucket(table, lead)


def _counted_bucket(table: pa.Table, lead: int) -> pa.Table:
    """Frequencies of a bucket's elements; what more than one document has goes back, with the batches' own rows."""
    kind, known = _sent(lead), lead // 8
    bucket = table["bucket"][0].as_py()
    homes = table.filter(table["ids"].is_valid())
    table = table.filter(table["sent"].is_valid())
    sent, sums = table["sent"].to_pylist(), table["sums"].to_pylist()
    rows, more = np.frombuffer(b"".join(sent), kind), np.frombuffer(b"".join(sums), _SUMS)
    whole = np.zeros((len(rows), 8), np.uint8)
    whole[:, : 8 - known] = rows["h"]
    top = (bucket >> lead - 8 * known) << 64 - 8 * known if known else 0
    h = np.concatenate([whole.view("<u8").ravel() | W.U(top), more["h"]])
    weight = np.concatenate([np.ones(len(rows), np.int64), more["c"].astype(np.int64)])
    order = np.argsort(h, kind="stable")
    edge = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
    group = np.cumsum(edge) - 1
    df = np.zeros(len(h), np.int64)
    df[order] = np.bincount(group, weight[order])[group].astype(np.int64) if len(h) else 0
    df = np.minimum(df, _MOST_DF)
    back = np.zeros(len(h), _BACK)
    back["token"], back["df"], back["d"] = h, df, np.append(rows["d"], np.full(len(more), _SUMMED, np.uint16))
    out = {"batch": [], "back": []}
    ends, ends_more = (np.append(0, np.cumsum([len(x) for x in blobs]) // kind.itemsize) for blobs, kind in ((sent, kind), (sums, _SUMS)))
    for i, batch in enumerate(table["batch"].to_pylist()):
        mine = back[ends[i] : ends[i + 1]], back[len(rows) + ends_more[i] : len(rows) + ends_more[i + 1]]
        found = mine[0][mine[0]["df"] > 1].tobytes() + mine[1].tobytes()
        if found:
            out["batch"].append(batch)
            out["back"].append(found)
    n, names = len(out["batch"]), [x for x, _ in _HOME_TYPES]
    shared = pa.table({"batch": pa.array(out["batch"], pa.int64()), "back": pa.array(out["back"], pa.binary())} | {x: pa.nulls(n, t) for x, t in _HOME_TYPES})
    own = pa.table({"batch": homes["batch"], "back": pa.nulls(homes.num_rows, pa.binary())} | {x: homes[x] for x in names})
    return pa.concat_tables([shared, own])


_SETS_SCHEMA = "id long, batch long, place int, digest binary, n int, stands boolean, tokens array<bigint>, dfs array<int>, l int, take int"


def _assembler(percent: int):
    return lambda table: _assembled(table, percent)


def _assembled(table: pa.Table, percent: int) -> pa.Table:
    """A batch's documents with their shared elements, rare ones first, l and how many of them the prefix takes (only for the
    first of equal sets, and if it can link)."""
    homes = table.filter(table["ids"].is_valid()).to_pylist()
    rows = np.frombuffer(b"".join(x for x in table["back"].to_pylist() if x), _BACK)
    home = homes[0]  # a batch that occurs twice, row for row, comes with its elements twice
    summed = rows[rows["d"] == _SUMMED]
    own = np.frombuffer(home["own"], _OWN)
    if len(own):
        summed = summed[np.argsort(summed["token"], kind="stable")]
        shared = np.zeros(len(own), _BACK)
        shared["token"], shared["d"], shared["df"] = own["h"], own["d"], summed["df"][np.searchsorted(summed["token"], own["h"])]
        rows = np.concatenate([rows[rows["d"] != _SUMMED], shared])
    rows = rows[np.lexsort((rows["token"], rows["df"], rows["d"]))]
    if len(homes) > 1:
        rows = rows[np.append(True, (rows["d"][1:] != rows["d"][:-1]) | (rows["token"][1:] != rows["token"][:-1]))[: len(rows)]]
    n = len(home["ids"])
    counts = np.bincount(rows["d"], minlength=n)
    tokens, dfs = W.nested(rows["token"].astype("<u8").view(np.int64), counts, pa.int64()), W.nested(rows["df"].astype(np.int32), counts, pa.int32())
    stands = np.zeros(n, bool)
    stands[home["first"]] = True
    prefix = np.zeros((n, 2), np.int32)
    edges = np.append(0, np.cumsum(counts))
    for i in home["first"]:
        prefix[i] = prefix_of(home["sizes"][i], rows["df"][edges[i] : edges[i + 1]], percent)
    hidden = pa.array(prefix[:, 1] == 0)
    batch = pa.array([table["batch"][0].as_py()] * n, pa.int64())
    columns = {"id": pa.array(home["ids"], pa.int64()), "batch": batch, "place": pa.array(np.arange(n), pa.int32()), "digest": pa.array(home["digests"], pa.binary()), "n": pa.array(home["sizes"], pa.int32()), "stands": pa.array(stands)}
    told = {"tokens": pc.if_else(hidden, None, tokens), "dfs": pc.if_else(hidden, None, dfs), "l": pa.array(prefix[:, 0]), "take": pa.array(prefix[:, 1])}
    out = [pa.table(columns | told)]
    for i in range(1, len(homes)):
        again = {"place": pa.array(np.arange(n) + i * n, pa.int32()), "stands": pa.array(np.zeros(n, bool))}
        out.append(pa.table(columns | again | {c: pa.nulls(n, x.type) for c, x in told.items()}))
    return pa.concat_tables(out)


def shared_elements(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    lead = (max(1, -(-text_bytes(docs, text_col) // bucket_bytes)) - 1).bit_length()
    mine = keyed_text(docs, id_col, text_col).withColumn("__id", F.col("__id").cast("long"))
    sent = mine.mapInArrow(_sender(k, lead), _SENT_SCHEMA)
    back = sent.groupBy("bucket").applyInArrow(_counter(lead), _BACK_SCHEMA)
    return back.groupBy("batch").applyInArrow(_assembler(percent), _SETS_SCHEMA)


def prefix_of(n: int, dfs: np.ndarray, percent: int, weight: float = 4.0) -> tuple[int, int]:
    """l and how many of the shared elements (whose frequencies are dfs) the prefix takes; (0, 0) if nothing can link."""
    need = -(-percent * n // 100)
    spare = len(dfs) - need  # n - need less the unshared elements, which come first in the order
    if spare < 0 or need < 1:
        return 0, 0
    most = min(MOST_L, need)
    read = np.cumsum(dfs[: spare + most].astype(np.float64) - 1)[spare:]
    at = np.arange(1, len(read) + 1)
    best = int(np.argmin(read * (1 + weight / at)))
    return best + 1, spare + best + 1


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class the bits that its shared elements hash to."""
    for batch in batches:
        lists = W.column(batch, "tokens")
        bits = np.zeros((batch.num_rows, SIGNATURE), np.uint8)
        for i in range(batch.num_rows):
            bits[i, lists[i].values.to_numpy() % SIGNATURE] = 1
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([W.column(batch, "rep"), W.nested(packed.ravel(), np.full(batch.num_rows, SIGNATURE // 64), pa.int64())], names=["rep", "signature"])


def _least_shared(percent: int, x: str, y: str):
    """Elements that two sets must have in common to link."""
    return F.ceil(percent * (F.col(f"n{x}") + F.col(f"n{y}")) / (100 + percent))


def _matches(percent: int, x: str, y: str):
    """How many elements the prefixes of two linked sets share at least: min(l, l'), or what is left of the elements
    that they must share when all those beyond the longer prefix's end are taken as shared."""
    after = F.greatest(*[F.ceil(percent * F.col(f"n{s}") / 100) - F.col(f"l{s}") for s in (x, y)])
    return F.greatest(F.least(f"l{x}", f"l{y}"), _least_shared(percent, x, y) - after)


def _counted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b; a table) with both sides' sets and `met`, how many elements their prefixes share, where that is enough.
    While there are few pairs, only their own sets are sent anywhere."""
    side = classes.select("rep", "n", "l", "take", "tokens")
    if pairs.count() <= FEW:
        side = side.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "rep", "left_semi")
        pairs = F.broadcast(pairs)
    a, b = (side.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}{x}") for c in side.columns[1:]]) for x in "ab")
    met = F.size(F.array_intersect(F.slice("tokensa", F.lit(1), F.col("takea")), F.slice("tokensb", F.lit(1), F.col("takeb"))))
    return pairs.join(a, "a").join(b, "b").withColumn("met", met).where(F.col("met") >= _matches(percent, "a", "b"))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that share enough of their prefixes and then link."""
    both = _counted(pairs, classes, percent).withColumn("i", F.size(F.array_intersect("tokensa", "tokensb")))
    return both.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _fits(percent: int, x: str, y: str):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _placed(postings: DataFrame, comps: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Entries of the posting lists with their components; of the lists that lie in several, the largest one; and how
    many pairs of entries an entry outside the largest would meet."""
    placed = scratch.write(postings.join(comps.withColumnRenamed("v", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "placed")
    parts = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("all"), F.max("c").alias("most")).where("parts > 1")
    main = scratch.write(main, "posting-lists")
    waiting = main.agg(F.coalesce(F.sum((F.col("all") - F.col("most")) * F.col("all")), F.lit(0))).first()[0]
    return placed, main, waiting


def _met(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough of their prefixes: every posting list that both are on
    counts one. Entries (token, k, main, comp) of one component's class don't meet one another."""
    signed = placed.join(classes.mapInArrow(_signatures, "rep long, signature array<bigint>"), "rep")
    u, v = (signed.select("token", *[F.col(c).alias(f"{c}{s}") for c in ("rep", "n", "l", "k", "m", "comp", "main", "signature")]) for s in "xy")
    least_shared = _least_shared(percent, "x", "y")
    reach = F.least("kx", "ky") + F.least(F.col("mx") - F.col("kx"), F.col("my") - F.col("ky"))  # elements in common at most

    def alone(x: str, y: str):
        """Elements of one that the other lacks, at least."""
        return sum((F.bit_count(F.get(f"signature{x}", i).bitwiseAND(F.bitwise_not(F.get(f"signature{y}", i)))) for i in range(SIGNATURE // 64)), F.lit(0))

    alike = (F.col("mx") - alone("x", "y") >= least_shared) & (F.col("my") - alone("y", "x") >= least_shared)
    across = (F.col("compx") != F.col("compy")) & (F.col("mainy") | (F.col("compx") < F.col("compy")))
    rows = u.where("not mainx").join(v, "token").where(across & _fits(percent, "nx", "ny") & (reach >= least_shared) & alike)
    rows = rows.select(F.least("repx", "repy").alias("a"), F.greatest("repx", "repy").alias("b"), _matches(percent, "x", "y").alias("needed"))
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed")).where("met >= needed")


def _parted(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """postings with `part`, which deals the entries of a list to parts of about CHAIN. A frequency is how long a list is
    at most; lists of elements whose frequency was too large to be told are counted."""
    told = postings.where(F.col("df") >= _MOST_DF).groupBy("token").agg(F.count(F.lit(1)).alias("entries"))
    told = scratch.write(told, "long-lists")
    size = F.col("df")
    if n := told.count():
        postings = postings.join(F.broadcast(told) if n <= FEW else told, "token", "left")
        size = F.coalesce("entries", size)
    return postings.withColumn("part", F.pmod(F.xxhash64("rep", "token"), F.ceil(size / CHAIN).cast("long"))).drop("entries")


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id_col, n_shingles, class_id (smallest id with the same set) and component_id (smallest id reachable by links)
    for every row, as a table in the shared folder; all other tables are deleted."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    scratch = Scratch(docs.sparkSession)
    sets = scratch.write(shared_elements(docs, k, percent, id_col, text_col, bucket_bytes), "sets")
    best = sets.where("id is not null and n > 0 and stands").groupBy("digest").agg(F.min(F.struct("id", "batch", "place")).alias("m"))
    best = scratch.write(best.select("digest", F.col("m.id").alias("rep"), F.col("m.batch").alias("batch"), F.col("m.place").alias("place")), "classes")
    able = sets.where("id is not null and take > 0")
    mine = ["batch", "place"]
    copies = able.select("digest", *mine).join(best.select("digest", *[F.col(c).alias(f"of_{c}") for c in mine]), "digest").where("batch <> of_batch or place <> of_place")
    copies = scratch.write(copies.select(*mine), "copies")  # of sets of other batches: few, where sets are many
    able = able.join(F.broadcast(copies) if copies.count() <= FEW else copies, mine, "left_anti").select(F.col("id").alias("rep"), "n", "tokens", "dfs", "l", "take")
    classes = scratch.write(able, "class-sets")
    named = scratch.write(sets.select("id", "digest", "n"), "named")
    scratch.drop(sets)
    postings = classes.select("rep", "n", "l", F.size("tokens").alias("m"), "dfs", F.posexplode(F.slice("tokens", F.lit(1), F.col("take"))).alias("k", "token"))
    postings = scratch.write(postings.select("token", F.get("dfs", F.col("k")).alias("df"), "rep", "n", "l", "k", "m"), "postings")

    postings = _parted(postings, scratch)
    hashed = postings.select("token", "part", "rep", "n", F.xxhash64("rep").alias("h"))
    before = [F.lag(F.struct("rep", "n")).over(Window.partitionBy("token", "part").orderBy(*order)).alias(f"by_{order[0]}") for order in (("n", "rep"), ("h", "rep"))]
    step = hashed.select("rep", "n", *before).select("rep", "n", F.explode(F.array("by_n", "by_h")).alias("prev")).select("rep", "n", F.col("prev.rep").alias("prev"), F.col("prev.n").alias("m")).where(F.col("prev").isNotNull() & _fits(percent, "n", "m"))
    tried = scratch.write(step.select(F.least("rep", "prev").alias("a"), F.greatest("rep", "prev").alias("b")).distinct(), "chains")
    links = scratch.write(_verified(tried, classes, percent), "chain-links")

    entries = postings.count()
    comps, giving_up = None, False
    for turn in range(ROUNDS + 1):
        if comps is not None:
            scratch.drop(comps, placed, lists)
        comps = components(links, scratch)
        placed, lists, waiting = _placed(postings, comps, scratch)
        mixed = placed.join(lists.select("token", "main"), "token").withColumn("main", F.col("comp") == F.col("main"))
        if giving_up or turn == ROUNDS or waiting <= SPARE * entries:
            break
        chains = []
        for order in (("n", F.xxhash64("rep", F.lit(turn))), (F.xxhash64("rep", F.lit(-1 - turn)),)):
            by = Window.partitionBy("token", "part").orderBy(*order)
            for end, pick in ((by.rowsBetween(Window.unboundedPreceding, -1), F.last), (by.rowsBetween(1, Window.unboundedFollowing), F.first)):
                near = pick(F.when(F.col("main"), F.struct("rep", "n")), ignorenulls=True).over(end)
                step = mixed.withColumn("near", near).where("not main and near is not null").select("rep", "n", F.col("near.rep").alias("prev"), F.col("near.n").alias("m")).where(_fits(percent, "n", "m"))
                chains.append(step.select(F.least("rep", "prev").alias("a"), F.greatest("rep", "prev").alias("b")))
        more = scratch.write(reduce(DataFrame.union, chains).distinct().join(tried, ["a", "b"], "left_anti"), "chains")
        found = scratch.write(_verified(more, classes, percent), "chain-links")
        tried = tried.union(more)
        links = links.union(found)
        giving_up = found.count() * WORTH < more.count()

    cross = scratch.write(_met(mixed, classes, percent).join(tried, ["a", "b"], "left_anti"), "cross")
    links = scratch.write(links.unionByName(_verified(cross.select("a", "b"), classes, percent)), "all-links")
    comps = components(links, scratch)

    named = named.join(best.select("digest", "rep"), "digest", "left").join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("id", "n", "digest", "rep", F.coalesce("comp", "rep").alias("comp"))
    alone = F.col("n") == 0
    known = F.col("id").isNotNull()
    out = named.select(F.col("id").alias("__id"), F.col("n").cast("long").alias("n_shingles"), F.when(known, F.when(alone, F.col("id")).otherwise(F.col("rep"))).alias("class_id"), F.when(known, F.when(alone, F.col("id")).otherwise(F.col("comp"))).alias("component_id"), F.col("digest").alias("set_digest"))
    out = written(out, "near-duplicates")
    scratch.close()
    return out.select(F.col("__id").alias(id_col), "n_shingles", "class_id", "component_id", "set_digest")


def _digests_of(k: int):
    """Adds the digest of each text's set to its row, the last column being the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                texts, hashes = sets_of(W.words_of(*W.texts(W.column(part, "__text")), lower=True), k)
                ends = np.cumsum(np.bincount(texts, minlength=part.num_rows)).tolist()
                digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(digests, pa.binary())], names=[*part.schema.names[:-1], "__digest"])

    return run


def without_near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs without those that are linked, over any number of links, with a document of a smaller id. Rows without
    an id stay. An id usually goes or stays as a whole; of ids whose rows have texts of which some go and others stay,
    each row is judged by the set of its own text."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    gone = F.col("__gone")
    told = found.select(F.col(f"`{id_col}`").alias("__id"), "set_digest", (F.col(f"`{id_col}`") != F.col("component_id")).alias("__gone")).where("__id is not null")
    whole = told.groupBy("__id").agg(F.min("__gone").alias("every"), F.max("__gone").alias("any")).where("any")
    own = F.col(f"`{id_col}`").cast("long")
    kept = docs.join(whole.select("__id"), own == F.col("__id"), "left_anti")
    scratch = Scratch(docs.sparkSession)
    mixed = scratch.write(whole.where("not every").select("__id"), "ids-with-two-texts")
    if mixed.isEmpty():
        scratch.close()
        return kept
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], own.alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    rows = rows.join(mixed, "__id").select(*[f"__{i}" for i in range(len(names))], "__id", "__text")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1]) + ", __digest binary"
    going = told.where(gone).select("__id", F.col("set_digest").alias("__digest")).distinct()
    left = rows.mapInArrow(_digests_of(k), schema).join(going, ["__id", "__digest"], "left_anti")
    left = left.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
    return kept.union(written(left, "rows-of-two-texts"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
