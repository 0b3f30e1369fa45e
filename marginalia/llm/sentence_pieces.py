"""Texts as ids of a SentencePiece model and back, each distinct marked word segmented once.

A model of byte-pair pieces writes a space as a marker, sets one before the text and joins neighbours by merges. Where no
piece has a marker after another character, no merge crosses from a word to the marker that follows it, so the text falls
into chunks (a run of markers with the characters up to the next one) whose ids depend on nothing else. A worker keeps
a table of distinct chunks with their ids: those of some texts that the table lacks are segmented in one call of the
library, and the texts' ids are gathered from the table in the order of their chunks' positions. Whether a model allows
that is read off the model (chunked()); any other encodes whole texts.

Once the table holds over `cached` chunks, or as many times 16 ids, the half of them that was met least goes (all, if the
other half is still too large), so a worker's memory is bounded by that and its longest text. Nothing is shuffled.

decode() strings together the bytes of the pieces of a row, without the marker that encoding set before the text. Rows
whose bytes are not UTF-8, or with an unknown or control id before the end, are left to the library.

Nulls and edge cases: a null text is an empty one, which has no pieces (and so only the end id, if asked for); a null
id_col stays null; a null list of ids decodes as an empty one, null ids in it are left out and ids outside the
vocabulary stand for the unknown piece; repeated rows are encoded each; a text of any length is encoded whole; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import keyed_text

CACHED = 300_000
MARKER = "▁"
_CHUNK = re.compile(" +[^ ]*")


def chunked(model: bytes) -> bool:
    """Whether a model's pieces can't cross from a character to a marker behind it, and nothing else ties chunks together:
    byte-pair merges, text taken as it is with one marker in front, bytes in place of unknown characters."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    normal, trained, kinds = spec.normalizer_spec, spec.trainer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and normal.escape_whitespaces
    merges = trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
    texts = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
    own = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)
    return bool(plain and merges and not own and MARKER in texts and not any(MARKER in t.lstrip(MARKER) for t in texts))


class _Numbers(dict):
    """Numbers chunks as they are asked for; what is new waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self)
        return n


class _Table:
    """Distinct chunks by number: where in `flat` their ids are, how many, and how often each was met."""

    def __init__(self, segment: Callable[[list[str]], list[list[int]]], cached: int):
        self.segment, self.cached = segment, cached
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.flat = _Numbers(), np.zeros(0, np.int32)
        self.at = self.size = self.met = np.zeros(0, np.int64)

    def _learn(self) -> None:
        ids = self.segment(self.numbers.new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.at = np.append(self.at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size, self.met = np.append(self.size, sizes), np.append(self.met, np.zeros(len(ids), np.int64))
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
        self.numbers.new = []

    def _of(self, k: np.ndarray) -> np.ndarray:
        sizes = self.size[k]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.at[k] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _halve(self) -> None:
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.cached // 2])
        if int(self.size[keep].sum()) > 8 * self.cached:
            return self._empty()
        names, old = list(self.numbers), self.numbers
        self.numbers = _Numbers()
        self.numbers.update((names[i], n) for n, i in enumerate(keep.tolist()))
        old.clear()
        self.flat = self._of(keep)
        self.size, self.met = self.size[keep], self.met[keep] // 2
        self.at = np.cumsum(self.size) - self.size

    def ids(self, chunks: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in order, and how many each run of counts[i] chunks has."""
        if len(self.numbers) > self.cached or len(self.flat) > 16 * self.cached:
            self._halve()
        k = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        if self.numbers.new:
            self._learn()
        self.met += np.bincount(k, minlength=len(self.met))
        sums = np.append(0, np.cumsum(self.size[k]))
        ends = np.cumsum(counts)
        return self._of(k), sums[ends] - sums[ends - counts]


class Pieces:
    """A model's ids of whole texts, and texts of ids."""

    def __init__(self, model: bytes, cached: int = CACHED):
        from sentencepiece import SentencePieceProcessor

        self.library, self.by_chunks = SentencePieceProcessor(model_proto=model), chunked(model)
        self.table = _Table(self._segment, cached)
        n, unknown = self.library.vocab_size(), self.library.unk_id()
        self.end, self.unknown, self.size, self.lone = self.library.eos_id(), unknown, n, [self.library.piece_to_id(MARKER)]
        self.control = {i for i in range(n) if self.library.is_control(i)}
        self.marked = {i for i in range(n) if self.library.id_to_piece(i).startswith(MARKER)}
        self.bytes_of: dict[int, bytes] = {}
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if i != unknown and i not in self.control:
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)]) if self.library.is_byte(i) else piece.replace(MARKER, " ").encode()

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """The library sets the first marker itself, except before an empty text."""
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else self.lone for c, ids in zip(chunks, found, strict=True)]

    def ids(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if self.by_chunks:
            chunks: list[str] = []
            counts = []
            for t in texts:
                found = _CHUNK.findall(" " + t.replace(MARKER, " ")) if t else []
                chunks += found
                counts.append(len(found))
            flat, sizes = self.table.ids(chunks, np.array(counts, np.int64))
        else:
            each = [self.library.encode(t) for t in texts]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter(chain.from_iterable(each), np.int32, int(sizes.sum()))
        if not end or self.end < 0:
            return flat, sizes
        return np.insert(flat, np.cumsum(sizes), self.end), sizes + 1

    def text(self, ids: list[int]) -> str:
        while ids and ids[-1] in self.control:
            ids = ids[:-1]
        if not self.by_chunks:
            return self.library.decode([i if 0 <= i < self.size else self.unknown for i in ids])
        try:
            found = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        except (KeyError, UnicodeDecodeError):
            return self.library.decode([i if 0 <= i < self.size else self.unknown for i in ids])
        return found[1:] if ids and ids[0] in self.marked else found


_workers: dict[tuple[int, int], Pieces] = {}


def _pieces(model: bytes, cached: int) -> Pieces:
    made = (hash(model), cached)
    if made not in _workers:
        _workers.clear()
        _workers[made] = Pieces(model, cached)
    return _workers[made]


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """id_col and ids (a list of int) of each row; end: with the model's end id."""
    model, mine = _model(docs, model_path), keyed_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value, cached)
        for batch in batches:
            for part in W.slices(batch, most=1 << 20):
                flat, sizes = pieces.ids([t or "" for t in W.column(part, "__text").to_pylist()], end)
                yield pa.RecordBatch.from_arrays([W.column(part, "__id"), W.nested(flat, sizes, pa.int32())], names=["__id", "ids"])

    return mine.mapInArrow(run, f"__id {dict(mine.dtypes)['__id']}, ids array<int>").withColumnRenamed("__id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids and decoded, the text of the ids, of each row."""
    model = _model(rows, model_path)
    mine = rows.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value, CACHED)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = W.column(part, "__ids")
                texts = [pieces.text(x) for x in _lists(lists)]
                yield pa.RecordBatch.from_arrays([W.column(part, "__id"), lists, pa.array(texts, pa.string())], names=["__id", "ids", "decoded"])

    return mine.mapInArrow(run, f"__id {dict(mine.dtypes)['__id']}, ids array<int>, decoded string").withColumnRenamed("__id", id_col)


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The ids of each row; a null list is empty, null ids are left out."""
    if column.null_count or column.values.null_count:
        yield from ([i for i in x or [] if i is not None] for x in column.to_pylist())
        return
    flat = column.flatten().to_numpy().tolist()
    at = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist() if len(column) else [0]
    yield from (flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents over the piece_bpe_32k model, encoded with an end id and decoded again; the contract's columns."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    told = decode(found, default_model())
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
