"""Best-fit packing of tokenized documents into training sequences.

tokenized() turns each text into ids, ends it with the separator id and cuts what is longer than a sequence; it
writes the pieces to the shared folder. The default tokenizer's ids depend on nothing across a space or a line feed (its
pre-tokenizer drops white space and its normalizer composes nothing with it), so it runs once for each distinct run
between them that a worker meets, and numpy strings the ids together; a tokenizer of another make, which its file
tells (by_runs()), encodes whole texts.

packed() is a bounded-space online best fit over the pieces' lengths alone: at most `max_open` sequences are open, a
bitset has one bit for each amount of free space that an open one has, so that one shift and one lowest bit find the
fullest sequence with room enough. With none, a new one opens; if that is one too many, the fullest closes first.
Pieces arrive in groups of about `group_pieces`, spread and ordered by hashes of their keys (so that long and short
ones come mixed however the table was sorted); a group is one task's memory and loses a part of max_open sequences
at most.

Nulls and edge cases: a null or empty text is the separator alone; a null id stays null; repeated rows are packed
each; a text of any length is cut into whole pieces; an empty table packs into nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_letters, keyed_text, written

MAX_LEN, SEPARATOR, MAX_OPEN, GROUP_PIECES, CACHED = 4096, 1, 256, 100_000, 400_000


#: Runs whose ids need no more than the model's merges: Latin-1 letters, which are composed and lower-case one by one,
#: then marks that are no letter, digit or apostrophe. They are two pre-tokens, or one.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\\[-`{-~]*)")


#: What splits a text at white space before anything else, so that runs between blanks can be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_runs(tokenizer_json: str) -> bool:
    """Whether a tokenizer is of the kind whose ids depend on nothing across white space: lower-casing, cutting words out by
    _SPLIT and dropping the rest, with a mark at the ends of words. Any other encodes whole texts."""
    spec = json.loads(tokenizer_json)
    normal, cut, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = cut.get("pretokenizers") or [{}]
    words = steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    bytes_ = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return normal.get("normalizers") == _NORMALIZERS and words and bytes_ and model.get("type") == "BPE" and not model.get("dropout") and bool(model.get("end_of_word_suffix"))


class WholeTexts:
    """Any tokenizer's ids of whole texts."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class _Numbers(dict):
    """Numbers keys as they are asked for; what is new waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Ids:
    """The tokenizer's ids of whole texts; keeps those of up to so many distinct runs between spaces."""

    def __init__(self, tokenizer_json: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_str(tokenizer_json), cached
        self.model = self.tokenizer.model
        shown = {b: c for c, b in byte_letters().items()}
        self.shown = {b: shown[b] for b in range(256)}
        self.tails: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.known, self.words = _Numbers(), {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _ids(self, run: str) -> list[int]:
        plain = _PLAIN.fullmatch(run)
        if plain is None:
            return self.tokenizer.encode(run, add_special_tokens=False).ids
        word, tail = plain.groups()
        word = word.lower()
        if (ids := self.words.get(word)) is None:
            seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
            ids = self.words[word] = [x.id for x in self.model.tokenize(seen)] if word else []
        if not tail:
            return ids
        if (more := self.tails.get(tail)) is None:
            more = self.tokenizer.encode(tail, add_special_tokens=False).ids
            if len(self.tails) < 10_000:
                self.tails[tail] = more
        return ids + more

    def _learn(self, new: list[str]) -> None:
        ids = [self._ids(x) for x in new]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.known) - len(new), int(sizes.sum())
        self.at, self.size = self._room(self.at, n + len(new)), self._room(self.size, n + len(new))
        self.flat = self._room(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.size[n : n + len(new)] = sizes
        self.at[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def of(self, text: str) -> np.ndarray:
        runs = text.replace("\n", " ").split(" ")
        if len(self.known) > self.cached:
            self._clear()
        k = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        sizes = self.size[k]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.at[k] - ends + sizes, sizes) + np.arange(ends[-1])]


_workers: dict[tuple[int, int], Ids | WholeTexts] = {}


def tokenized(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: key (unique), id_col, piece, start, length and ids (little-endian unsigned 32-bit)."""
    if max_len < 1:
        raise ValueError("max_len must be 1 or more")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    mine = keyed_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = (hash(vocabulary.value), CACHED)
        if made not in _workers:
            _workers.clear()
            _workers[made] = (Ids if by_runs(vocabulary.value) else WholeTexts)(vocabulary.value)
        ids_of, key = _workers[made], TaskContext.get().partitionId() << 36
        for batch in batches:
            names = batch.column(0)
            for a in range(0, batch.num_rows, 256):
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(a, 256).to_pylist(), a):
                    found = np.append(ids_of.of(text) if text else np.zeros(0, np.uint32), np.uint32(separator)).astype("<u4")
                    for p, s in enumerate(range(0, len(found), max_len)):
                        part = found[s : s + max_len]
                        rows.append(i), pieces.append(p), starts.append(s), lengths.append(len(part)), ids.append(part.tobytes())
                keys = np.arange(key, key + len(rows))
                key += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), names.take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=["key", "__id", "piece", "start", "length", "ids"])

    out = mine.mapInArrow(run, f"key long, __id {dict(mine.dtypes)['__id']}, piece int, start long, length long, ids binary")
    return written(out.withColumnRenamed("__id", id_col), "token-pieces")


def best_fit(lengths: list[int], capacity: int, max_open: int) -> tuple[list[int], list[int], int]:
    """For each length in turn the number of its sequence and its offset there; how many sequences there are."""
    if max_open < 1:
        raise ValueError("max_open must be 1 or more")
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by free space
    free, n_open, made = 0, 0, 0
    where, offsets = [], []
    for n in lengths:
        if fits := free >> n:
            room = n + (fits & -fits).bit_length() - 1
            at = bins[room].pop()
            if not bins[room]:
                free ^= 1 << room
        else:
            if n_open == max_open:
                fullest = (free & -free).bit_length() - 1
                bins[fullest].pop()
                if not bins[fullest]:
                    free ^= 1 << fullest
                n_open -= 1
            at, room = made, capacity
            made += 1
            n_open += 1
        where.append(at)
        offsets.append(capacity - room)
        if left := room - n:
            bins[left].append(at)
            free |= 1 << left
        else:
            n_open -= 1
    return where, offsets, made


def packed(pieces: DataFrame, max_len: int = MAX_LEN, max_open: int = MAX_OPEN, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """key, sequence_id and offset of each piece."""
    lengths = pieces.select("key", "length")
    groups = max(1, -(-lengths.count() // group_pieces))

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["key"].to_numpy(), table["turn"].to_numpy()))
        where, offsets, _ = best_fit(table["length"].to_numpy()[order].tolist(), max_len, max_open)
        base = table["group"][0].as_py() << 36
        return pa.table({"key": table["key"].take(pa.array(order)), "sequence_id": pa.array(np.array(where, np.int64) + base), "offset": pa.array(offsets, pa.int64())})

    grouped = lengths.withColumn("turn", F.xxhash64("key")).withColumn("group", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(run, "key long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, separator: int = SEPARATOR, max_open: int = MAX_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids, sequence_id and offset of each piece of each document."""
    pieces = tokenized(docs, tokenizer_path, max_len, separator, id_col, text_col)
    return pieces.join(packed(pieces, max_len, max_open), "key").drop("key")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens; the contract's columns.

    The digest of the ids is taken on the pieces' side, so that the join moves digests only.
    """
    pieces = tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    told = pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return told.join(packed(pieces), "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
