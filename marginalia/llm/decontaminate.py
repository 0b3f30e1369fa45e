"""Benchmark decontamination by winnowed fingerprints.

Words are runs of characters other than ASCII ones that are no letter or digit, with A-Z lower-cased. A window is
`n` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Both sides keep the
smallest k-gram hash of every run of n - k + 1 k-grams (winnowing), so that a document and an item that share n
words share a fingerprint; a document's fingerprint that is one of the benchmark's is extended to the windows
around it, and those decide, by their hashes and then by the words themselves. Windows of fewer words than n, of which there are few lengths, are looked up at every
word, since winnowing promises nothing for them.

The benchmark comes to the tasks in blocks of bounded size (BLOCK_BYTES of text, some 30,000 items), so the fingerprints
are joined by look-up. Each block is one narrow pass over the documents, which are never shuffled, and carries what
earlier blocks found; with several blocks, what a pass gives is written to the shared folder before the next block comes
to the driver, which thus holds one at a time.

Nulls and edge cases: item ids can have any atomic type and are listed in the order of their strings; a null text has no words and no hits; a null item text, or one without words, has no window;
items that share an id count once; those without an id count as one item, null, whose windows hit like others';
repeated documents are judged each by itself; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import words as W
from .shared import Scratch

BLOCK_BYTES = 8 << 20
K = 5
_BITS = 20


class Block:
    """Windows of some benchmark items: by length the sorted hashes, the words, and the items that each belongs to."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        self.n, self.k = n, min(K, n)
        self.ids = in_order(ids)
        rank = {x: i for i, x in enumerate(self.ids)}
        w = W.words_of(*W.texts(pa.array(texts, pa.large_string())), inside=W.ALNUM, lower=True)
        of, left, counts = w.text_of(), w.left(), w.counts()
        item = np.array([rank[x] for x in ids], np.int64)
        self.windows: dict[int, tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]] = {}
        self.data, starts = w.plain()
        for size in np.unique(np.minimum(counts, n)).tolist():
            if size == 0:
                continue
            at = np.flatnonzero((left >= n) if size == n else (counts[of] == size) & (left == size))
            h, begin, end, whose = w.windows(size)[at], starts[at], starts[at + size], item[of[at]]
            order = np.lexsort((whose, h))
            h, begin, end, whose = (x[order] for x in (h, begin, end, whose))
            again = np.flatnonzero(h[1:] == h[:-1]) + 1

            def other(i: int, begin: np.ndarray, end: np.ndarray) -> bool:
                return self.data[begin[i - 1] : end[i - 1]] != self.data[begin[i] : end[i]]

            if any(other(i, begin, end) for i in again.tolist()):  # different words with one hash
                order = sorted(range(len(h)), key=lambda i: (h[i], self.data[begin[i] : end[i]], whose[i]))  # noqa: B023
                h, begin, end, whose = (x[order] for x in (h, begin, end, whose))
            new = np.append(True, h[1:] != h[:-1])[: len(h)]
            new[[i for i in again.tolist() if other(i, begin, end)]] = True
            keep = new | np.append(True, whose[1:] != whose[:-1])[: len(h)]
            first = np.append(np.cumsum(keep)[new] - 1, keep.sum())
            self.windows[size] = h[new], (begin[new], end[new]), first, whose[keep]
        grams = w.windows(self.k)
        _, chosen = W.winnowed(grams, left, self.k, n - self.k + 1)
        self.prints = np.unique(grams[chosen])
        self.seen = self._bits(self.prints)
        self.short = {size: self._bits(x[0]) for size, x in self.windows.items() if size < n}

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[keys & W.U((1 << _BITS) - 1)] = True
        return out

    @staticmethod
    def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def _same(self, w: W.Words, size: int, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places whose hash is a window's, those with that window's words too, and which window."""
        keys, (begin, end), _, _ = self.windows[size]
        starts, ends, raw = w.start, w.end, w.raw
        places, which = [], []
        for p, i in zip(at.tolist(), found.tolist(), strict=True):
            mine = b"".join([raw[a:b].tobytes() + b" " for a, b in zip(starts[p : p + size].tolist(), ends[p : p + size].tolist(), strict=True)])
            for j in range(i, len(keys)):
                if keys[j] != keys[i]:
                    break
                if self.data[begin[j] : end[j]] == mine:
                    places.append(p), which.append(j)
                    break
        return np.array(places, np.int64), np.array(which, np.int64)

    def hits(self, w: W.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: the words at which windows of the block start, and which windows."""
        left = w.left()
        mask = W.U((1 << _BITS) - 1)
        for size, (keys, _, _, _) in self.windows.items():
            if size == self.n:
                grams = w.windows(self.k)
                chosen, prints = W.winnowed(grams, left, self.k, self.n - self.k + 1)
                prints = prints[self.seen[grams[prints] & mask]]
                prints = prints[self._among(grams[prints], self.prints) >= 0]
                if not len(prints):
                    continue
                known = np.zeros(len(left) + 1, bool)
                known[prints] = True
                at = np.flatnonzero((chosen >= 0) & known[chosen])  # windows whose fingerprint is the benchmark's
                h = w.windows(size)[at]
            else:
                h = w.windows(size)
                at = np.flatnonzero((left >= size) & self.short[size][h & mask])
                h = h[at]
            found = self._among(h, keys)
            yield size, *self._same(w, size, at[found >= 0], found[found >= 0])


def in_order(ids) -> list:
    """Distinct ids, sorted as strings; a null is last."""
    return sorted(set(ids), key=lambda x: (x is None, str(x)))


def _found(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds the block's hits to those that the batch carries."""
    w = W.words_of(*W.texts(W.column(batch, "__text")), inside=W.ALNUM, lower=True)
    of, n = w.text_of(), len(w.hash)
    steps = np.zeros(n + 1, np.int64)
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, at, which in block.hits(w):
        np.add.at(steps, at, 1)
        np.add.at(steps, at + size, -1)
        _, _, first, item = block.windows[size]
        many = first[which + 1] - first[which]
        docs.append(np.repeat(of[at], many))
        items.append(item[np.repeat(first[which] - np.cumsum(many) + many, many) + np.arange(many.sum())])
    had_spans, had_items = W.column(batch, "__spans").to_pylist(), W.column(batch, "__items")
    for d, spans in enumerate(had_spans):
        for a, b in spans or ():
            steps[w.first[d] + a] += 1
            steps[w.first[d] + b] -= 1
    hit = np.cumsum(steps[:n]) > 0
    edge = np.zeros(n + 1, bool)
    edge[w.first] = True
    starts = np.flatnonzero(hit & (edge[:n] | ~np.append(False, hit[:-1])) if n else hit)
    ends = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False)) if n else hit) + 1
    spans: list[list[list[int]]] = [[] for _ in range(w.n_texts)]
    for d, a, b in zip(of[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
        spans[d].append([a - int(w.first[d]), b - int(w.first[d])])
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
    new: dict[int, set] = {}
    for d, i in pairs.T.tolist():
        new.setdefault(d, set()).add(block.ids[i])
    merged = [in_order({*(old or ()), *new.get(d, ())}) for d, old in enumerate(had_items.to_pylist())]
    out = {"__n_words": pa.array(w.counts(), pa.int64()), "__spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "__items": pa.array(merged, had_items.type)}
    return pa.RecordBatch.from_arrays([out[x] if x in out else W.column(batch, x) for x in batch.schema.names], names=batch.schema.names)


def _blocks(benchmark: DataFrame, n: int, item_col: str, item_text_col: str, block_bytes: int) -> tuple[int, Iterator[Block]]:
    """How many blocks of about so many bytes the benchmark makes (one at least), and one after another."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    count = max(1, -(-size // block_bytes))

    def made() -> Iterator[Block]:
        for b in range(count):
            rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b).collect()
            yield Block([r.i for r in rows], [r.t for r in rows], n)

    return count, made()


def without_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, as they are, in which no window of the benchmark occurs."""
    scratch = Scratch(docs.sparkSession)
    count, blocks = _blocks(benchmark, n, item_col, item_text_col, block_bytes)
    for b, block in enumerate(blocks):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in W.slices(batch, text_col):
                    w = W.words_of(*W.texts(W.column(part, text_col)), inside=W.ALNUM, lower=True)
                    of, clean = w.text_of(), np.ones(part.num_rows, bool)
                    for _, at, _ in block.hits(w):
                        clean[of[at]] = False
                    yield part.filter(pa.array(clean))

        docs, before = docs.mapInArrow(run, docs.schema), docs
        if b < count - 1:
            docs = scratch.write(docs, "decontaminated")
            scratch.drop(before)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """One row for each document: id_col, n_words, n_hit, spans (array of [first word, last word + 1], disjoint and
    ascending) and items (the ids of items with a window in the document), and text_col if keep_text."""
    none = F.array().cast(ArrayType(benchmark.schema[item_col].dataType))
    given = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), F.lit(0).cast("long").alias("__n_words"), F.expr("cast(array() as array<array<bigint>>)").alias("__spans"), none.alias("__items"))
    scratch = Scratch(docs.sparkSession)
    count, blocks = _blocks(benchmark, n, item_col, item_text_col, block_bytes)
    for b, block in enumerate(blocks):
        schema = given.drop("__text").schema if b == count - 1 and not keep_text else given.schema

        def run(batches: Iterator[pa.RecordBatch], block: Block = block, names: list[str] = schema.names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in W.slices(batch):
                    yield _found(block, part).select(names)

        given, before = given.mapInArrow(run, schema), given
        if b < count - 1:
            given = scratch.write(given, "decontaminated")
            scratch.drop(before)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    text = [F.col("__text").alias(text_col)] if keep_text else []
    return given.select(F.col("__id").alias(id_col), *text, F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents and the whole benchmark."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
