"""Words, their hashes and the hashes of word windows for whole Arrow batches, in numpy.

A word's hash takes in its bytes eight at a time, mixing after each step; words of over LONG bytes are hashed by BLAKE2b.
Words of up to eight bytes have different hashes for certain if they are of one length. A window's hash is built by
doubling: hashes of two neighbouring windows are mixed to that of the window of both, so no sum of powers is involved that
texts of regular structure could bring to the same value. Equal sequences have equal hashes wherever they stand; two
different ones share a hash with a chance of about 1 in 2**64. Where that is too much for what is decided by it, the words
themselves are compared, or digests(), a cryptographic hash of them, in addition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

U = np.uint64
LONG = 128
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
LAST = U(2**64 - 1)
_TAIL = np.array([0, *[(1 << 8 * i) - 1 for i in range(1, 9)]], U)  # the first i bytes of a little-endian long

#: Which bytes belong to words. Bytes from 0x80 on are parts of longer UTF-8 characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(_MIX[0])
    h = (h ^ (h >> U(27))) * U(_MIX[1])
    return h ^ (h >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a and b are hashes of, a first."""
    return mixed(mixed(a + U(_ODD[0])) * U(_ODD[1]) ^ b)


def _later(h: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([h[by:], np.zeros(min(by, len(h)), U)])


@dataclass
class Words:
    """Words of some texts: bytes of all texts, where each text, and each word, starts and ends there."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word index at which each text starts; one more at the end
    hash: np.ndarray
    _doubled: list[np.ndarray] = field(default_factory=list, repr=False)
    _plain: tuple[bytes, np.ndarray] | None = field(default=None, repr=False)

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(self.n_texts), self.counts())

    def left(self) -> np.ndarray:
        """For each word how many words of its text start there or later."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.start))

    def windows(self, size: int) -> np.ndarray:
        """For each word the hash of the size words from it; without meaning where the text has fewer left."""
        chain, out, done = self._doubled or [self.hash], None, 0
        self._doubled = chain
        for i in range(size.bit_length()):
            if i == len(chain):
                chain.append(joined(chain[-1], _later(chain[-1], 1 << i - 1)))
            if size >> i & 1:
                out = chain[i] if out is None else joined(out, _later(chain[i], done))
                done += 1 << i
        return mixed(out + U(size))

    def plain(self) -> tuple[bytes, np.ndarray]:
        """All words with a space after each, and where each word starts there; one more at the end."""
        if self._plain is None:
            sizes = self.end - self.start + 1
            at = np.append(0, np.cumsum(sizes))
            out = np.full(at[-1], 0x20, np.uint8)
            inside = np.ones(at[-1], bool)
            inside[at[1:] - 1] = False
            taken = np.zeros(len(self.raw) + 1, np.int8)
            taken[self.start] += 1
            taken[self.end] -= 1
            out[inside] = self.raw[np.cumsum(taken[:-1], dtype=np.int8).view(bool)]
            self._plain = out.tobytes(), at
        return self._plain

    def digests(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """64 bits of BLAKE2b of the words from each of at up to each of to."""
        data, starts = self.plain()
        view, blake = memoryview(data), hashlib.blake2b
        return np.frombuffer(b"".join([blake(view[a:b], digest_size=8).digest() for a, b in zip(starts[at].tolist(), starts[to].tolist(), strict=True)]), "<u8")


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    lanes = np.ndarray((len(raw) + 1,), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))  # the eight bytes from each one
    size = end - start
    h = mixed(lanes[start] & _TAIL[np.minimum(size, 8)] ^ U(_ODD[0])) ^ size.astype(U) * U(_ODD[1])
    at = np.flatnonzero((size > 8) & (size <= LONG))
    step = 8
    while len(at):
        h[at] = joined(h[at], lanes[start[at] + step] & _TAIL[np.minimum(size[at] - step, 8)])
        step += 8
        at = at[size[at] > step]
    h = mixed(h)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words_of(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    raw = LOWER[raw] if lower else raw
    at = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = at.copy(), at.copy()
    begins[1:] &= ~at[:-1] | edge[1:-1]
    ends[:-1] &= ~at[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(raw, offsets, start, end, np.searchsorted(start, offsets), _hashes(raw, start, end))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "__text", most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about so many bytes of text, so that working memory follows the longest text."""
    if not batch.num_rows:
        return
    offsets = texts(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def nested(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: counts[i] of the values for row i, in order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def winnowed(hashes: np.ndarray, left: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing of the k-gram hashes that start at each word.

    Every run of `window` k-grams (window + k - 1 words) of one text chooses its smallest hash, the rightmost of
    equal ones. Returns for each word the word that the run starting there chose (-1: no whole run starts there),
    and the chosen words once each, ascending.
    """
    n = len(hashes)
    best, chosen = hashes.copy(), np.arange(n)
    for j in range(1, min(window, n)):
        later = hashes[j:]
        take = later <= best[: n - j]
        best[: n - j][take] = later[take]
        chosen[: n - j][take] = np.flatnonzero(take) + j
    chosen = np.where(left >= window + k - 1, chosen, -1)
    mark = np.zeros(n + 1, bool)
    mark[chosen] = True
    return chosen, np.flatnonzero(mark[:n] & (np.arange(n) >= 0)) if n else np.zeros(0, int)
