"""Removal of long passages that an earlier document already has, with a log-structured fingerprint index.

Words are runs of characters other than ASCII white space, compared unchanged. A window is `size` consecutive words
of one document. A word is removed where a window that covers it also starts in a document with a smaller id;
windows are judged on the texts as given.

How it works. Every window names the smallest hash of the k-grams in it (rightmost of equals), its anchor; equal
windows have equal anchors, and neighbouring windows mostly share theirs, so that about one word in twenty is an
anchor. The windows with one anchor are a segment, known by its anchor and a cryptographic digest of all its words.
The log holds for each (anchor, segment) the smallest id of a document with it, in immutable runs sorted by anchor:
Parquet in the shared folder. take() is given batches of ascending ids, one after another, and for each of them

* merge-joins the batch's anchors with the runs so far; a segment that an earlier document has is verified by its digest
  and goes as a whole;
* verifies segments that are new, but whose anchor is not (the ends of passages), window by window: only the documents
  that first had one of that anchor's segments are read again, and digests of their windows with that anchor compared;
* appends the segments that no run has as a new run; when more than `max_runs` have gathered, compact() merges them.

So a batch costs a scan of the log (about a fifth of the texts it stands for) and work on its own texts. append() only
indexes, and dedup(docs, history) judges documents that were appended before.

Equality: windows count as equal when their anchors (64 bits over k words) and their digests (64 bits of BLAKE2b over all
their words, or those of their segments) are both equal. Only windows with one anchor are ever compared, so among m
different ones of a common anchor about m * m / 2**65 pairs would be confused.

Shuffles: the anchors (about 5 % of the words) and each batch's texts once, by id. An anchor in very many documents is
summed before the shuffle, and Spark splits its rows in the join; compaction deals rows by anchor and segment.

Nulls and edge cases: a null text has no words. A null id is never earlier than another and nothing is removed from
its text. Rows that share an id don't count against one another. Texts of under `size` words are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch, keyed_text, new_path, removed, written

SIZE = 50
K = 10
BATCHES = 6
BROADCAST_BYTES = 8 << 20


def _chosen(w: W.Words, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the word that its window chose (-1: no window), and the k-gram hashes."""
    grams = w.windows(k)
    return W.winnowed(grams, w.left(), k, size - k + 1)[0], grams


def _segments(w: W.Words, chosen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments: their first and last windows, and digests of their words."""
    at = np.flatnonzero(chosen >= 0)
    new = np.flatnonzero(np.append(True, chosen[at][1:] != chosen[at][:-1])) if len(at) else at
    first, last = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
    return first, last, w.digests(first, last + size)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_rows(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                w = W.words_of(*W.texts(W.column(part, "__text")))
                chosen, grams = _chosen(w, size, k)
                first, _, digests = _segments(w, chosen, size)
                of = np.searchsorted(w.first, first, "right") - 1
                keys = np.stack([of.astype(W.U), grams[chosen[first]], digests], axis=1)
                keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
                keys = keys[np.append(True, (keys[1:] != keys[:-1]).any(axis=1))[: len(keys)]]
                ids = W.column(part, "__id").take(pa.array(keys[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([_signed(keys[:, 1]), _signed(keys[:, 2]), ids], names=["anchor", "segment", "id"])

    return run


def _listed(part: pa.RecordBatch, name: str) -> list[np.ndarray]:
    lists = W.column(part, name)
    return [np.zeros(0, W.U) if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(W.U) for x in lists]


def _window_rows(size: int, k: int):
    """(anchor, window, mark, id) of the windows whose anchor is among the document's __mixed: window is a digest, and
    mark a hash to find it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                w = W.words_of(*W.texts(W.column(part, "__text")))
                chosen, grams = _chosen(w, size, k)
                marks, places, rows = w.windows(size), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, mixed in enumerate(_listed(part, "__mixed")):
                    at = np.arange(w.first[i], w.first[i + 1])
                    at = at[chosen[at] >= 0]
                    at = at[np.isin(grams[chosen[at]], mixed)]
                    _, once = np.unique(marks[at], return_index=True)
                    places.append(at[once])
                    rows.append(np.full(len(once), i))
                at = np.concatenate(places)
                ids = W.column(part, "__id").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([_signed(grams[chosen[at]]), _signed(w.digests(at, at + size)), _signed(marks[at]), ids], names=["anchor", "window", "mark", "id"])

    return run


def _kept_rows(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                raw, offsets = W.texts(W.column(part, "__text"))
                data = raw.tobytes()
                n_words, n_removed, kept = [], [], []
                for i, (old, late) in enumerate(zip(_listed(part, "__old"), _listed(part, "__late"), strict=True)):
                    text = data[offsets[i] : offsets[i + 1]]
                    if not len(old) and not len(late):
                        found = text.split()  # bytes: ASCII white space
                        n_words.append(len(found))
                        n_removed.append(0)
                        kept.append(b" ".join(found).decode())
                        continue
                    w = W.words_of(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                    steps = np.zeros(len(w.hash) + 1, np.int64)
                    if len(old):
                        first, last, digests = _segments(w, _chosen(w, size, k)[0], size)
                        hit = np.isin(digests, old)
                        np.add.at(steps, first[hit], 1)
                        np.add.at(steps, last[hit] + size, -1)
                    if len(late):
                        at = np.flatnonzero(np.isin(w.windows(size), late) & (w.left() >= size))
                        np.add.at(steps, at, 1)
                        np.add.at(steps, at + size, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    n_words.append(len(gone))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([text[a:b] for a, b in zip(w.start[~gone].tolist(), w.end[~gone].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays([W.column(part, "__id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["__id", "n_words", "n_removed", "kept"])

    return run


class FingerprintLog:
    """Sorted immutable runs of (anchor, segment, low); `runs` names them, so that a log can be opened again."""

    def __init__(self, spark: SparkSession, path: str | None = None, runs: list[str] | None = None, size: int = SIZE, k: int = K, max_runs: int = 4):
        if not 0 < k <= size:
            raise ValueError("k must be from 1 to size")
        self.spark, self.path = spark, path or new_path(spark, "fingerprint-log")
        self.runs, self.size, self.k, self.max_runs, self.made = list(runs or []), size, k, max_runs, len(runs or [])

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        run = f"{self.path}/run-{self.made:05d}"
        rows.select("anchor", "segment", "low").sortWithinPartitions("anchor").write.parquet(run)
        return run

    def _added(self, rows: DataFrame) -> None:
        self.runs.append(self._write(rows))
        if len(self.runs) > self.max_runs:
            self.compact()

    def _anchors(self, keyed: DataFrame) -> DataFrame:
        return keyed.where("__id is not null").mapInArrow(_anchor_rows(self.size, self.k), "anchor long, segment long, id long")

    def rows(self) -> DataFrame:
        schema = "anchor long, segment long, low long"
        return self.spark.read.schema(schema).parquet(*self.runs) if self.runs else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Merges all runs into one; the old ones go only once the new one is whole."""
        old, self.runs = self.runs, [self._write(self.rows().groupBy("anchor", "segment").agg(F.min("low").alias("low")))]
        for run in old:
            removed(self.spark, run)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Indexes documents, in any order of ids."""
        rows = self._anchors(keyed_text(docs, id_col, text_col))
        self._added(rows.groupBy("anchor", "segment").agg(F.min("id").alias("low")))

    def _met(self, rows: DataFrame) -> DataFrame:
        """The log's segments with the anchors of rows."""
        return self.rows().join(rows.select("anchor").distinct().hint("merge"), "anchor", "left_semi")

    def take(self, docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends a batch whose ids are above all in the log (or the same as the largest), and gives dedup()'s rows for
        it. history: all documents taken so far, the batch included (default: the batch, the first)."""
        scratch = Scratch(self.spark)
        rows = scratch.write(self._anchors(keyed_text(docs, id_col, text_col)), "anchors")
        fresh = rows.groupBy("anchor", "segment").agg(F.min("id").alias("low")).withColumn("new", F.lit(True))
        both = fresh.unionByName(self._met(rows).withColumn("new", F.lit(False))) if self.runs else fresh
        segments = scratch.write(both.groupBy("anchor", "segment").agg(F.min("low").alias("low"), F.min("new").alias("new")), "segments")
        out = self._judged(rows, segments, docs, docs if history is None else history, id_col, text_col, scratch)
        self._added(segments.where("new"))
        scratch.close()
        return out

    def dedup(self, docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """For each row of docs, which were appended: id_col, n_words, n_removed and kept, the words left, joined by single
        spaces. history: all documents in the log (default: docs)."""
        scratch = Scratch(self.spark)
        rows = scratch.write(self._anchors(keyed_text(docs, id_col, text_col)), "anchors")
        segments = scratch.write(self._met(rows), "segments")
        out = self._judged(rows, segments, docs, docs if history is None else history, id_col, text_col, scratch)
        scratch.close()
        return out

    def _judged(self, rows: DataFrame, segments: DataFrame, docs: DataFrame, history: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
        firsts = segments.groupBy("anchor").agg(F.min("low").alias("earliest"))
        known = scratch.write(segments.select("anchor", "segment", "low").join(firsts.hint("merge"), "anchor"), "known-segments")
        told = rows.join(known.hint("merge"), ["anchor", "segment"]).select("anchor", "segment", "id", (F.col("low") < F.col("id")).alias("old"), (F.col("earliest") < F.col("id")).alias("met"))
        told = scratch.write(told.where("old or met"), "told")
        mixed = told.where("not old").select("anchor").distinct()
        wanted = known.join(mixed.hint("merge"), "anchor", "left_semi").groupBy(F.col("low").alias("__id")).agg(F.collect_set("anchor").alias("__mixed"))
        wanted = scratch.write(wanted, "wanted")
        size = wanted.agg(F.coalesce(F.sum(F.size("__mixed") + 4), F.lit(0))).first()[0] * 8
        every = keyed_text(history, id_col, text_col)
        texts = every.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted.hint("merge"), "__id")
        windows = scratch.write(texts.mapInArrow(_window_rows(self.size, self.k), "anchor long, window long, mark long, id long"), "windows")
        first = windows.groupBy("anchor", "window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
        late = windows.join(first.hint("merge"), ["anchor", "window"]).where("id > low").groupBy(F.col("id").alias("__id")).agg(F.collect_set("mark").alias("__late"))
        old = told.where("old").groupBy(F.col("id").alias("__id")).agg(F.collect_set("segment").alias("__old"))
        marks = written(old.join(late.hint("merge"), "__id", "full"), "marks")
        mine = keyed_text(docs, id_col, text_col)
        full = mine.join(marks.hint("merge"), "__id", "left").select("__id", "__text", "__old", "__late")
        out = full.mapInArrow(_kept_rows(self.size, self.k), f"__id {dict(mine.dtypes)['__id']}, n_words long, n_removed long, kept string")
        return out.withColumnRenamed("__id", id_col)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, taken in BATCHES batches of ascending ids; the contract's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / BATCHES for i in range(1, BATCHES)], 1000)).first()[0]
    cuts = sorted(set(cuts or ()))
    log = FingerprintLog(spark)
    found = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        above = F.lit(True) if low is None else F.col("doc_id") > low
        below = F.lit(True) if high is None else F.col("doc_id") <= high
        unknown = F.col("doc_id").isNull() if low is None else F.lit(False)  # rows without an id go first
        found.append(log.take(docs.where((above & below) | unknown), docs.where(below)))
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
