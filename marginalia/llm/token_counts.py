"""Greedy word-piece token counts by a linear longest-match automaton.

A word is a run of characters other than ASCII white space, with A-Z lower-cased, taken as UTF-8 bytes followed by an
end mark. From its start the longest piece of the vocabulary that fits is taken, again and again; pieces that the
vocabulary marks as final (`</w>`) fit at the end of a word only. A word with a byte that no piece covers is one
unknown token.

The automaton is the vocabulary's trie. A node's failure link leads to the node reached when the pieces that greedy
matching is sure of are popped from the node's string, and the node keeps how many those are, so a word costs one
step or one pop for each byte, and no piece is built. A worker keeps the counts of up to `cached` distinct words.

Nulls and edge cases: a null or empty text has no words and no tokens; a null id stays null; repeated rows are
counted each; a word of any length is one pass; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .packing import default_tokenizer
from .shared import byte_letters, keyed_text

END, CACHED = 256, 500_000


def pieces_of(tokenizer_json: str, final: str = "</w>") -> list[tuple[int, ...]]:
    letters, out = byte_letters(), []
    for piece in json.loads(tokenizer_json)["model"]["vocab"]:
        ends = piece.endswith(final) and piece != final
        body = piece[: -len(final)] if ends else piece
        if body and all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *[END] * ends))
    return out


class LongestMatch:
    """child: (node << 9 | symbol) -> node. Node 0 is the root. fail: -1 where nothing can be popped."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.child: dict[int, int] = {}
        self.fail, self.popped, self.parent, symbol, final = [-1], [0], [-1], [-1], [False]
        for piece in (*pieces, (END,)):
            at = 0
            for s in piece:
                key = at << 9 | s
                to = self.child.get(key)
                if to is None:
                    to = self.child[key] = len(self.fail)
                    self.fail.append(-1), self.popped.append(0), self.parent.append(at), symbol.append(s), final.append(False)
                at = to
            final[at] = True
        self.lone_end = self.child[END]
        for v in self._by_depth():
            if final[v]:
                self.fail[v], self.popped[v] = 0, int(v != self.lone_end)  # an end mark left alone is no token
                continue
            u, n = self.parent[v], 0
            z = self.fail[u]
            n = self.popped[u]
            while z >= 0 and (z << 9 | symbol[v]) not in self.child:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.child[z << 9 | symbol[v]], n

    def _by_depth(self) -> list[int]:
        depth = [0] * len(self.fail)
        for v in range(1, len(depth)):
            depth[v] = depth[self.parent[v]] + 1
        return sorted(range(1, len(depth)), key=depth.__getitem__)

    def count(self, word: bytes) -> int:
        child, fail, popped, at, n = self.child, self.fail, self.popped, 0, 0
        for s in (*word, END):
            while (to := child.get(at << 9 | s)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class Counter:
    """Counts of whole texts, with the counts of known words kept."""

    def __init__(self, tokenizer_json: str, cached: int = CACHED):
        self.match, self.cached, self.known = LongestMatch(pieces_of(tokenizer_json)), cached, {}

    def of(self, text: bytes) -> tuple[int, int]:
        found = text.lower().split()  # of bytes: A-Z and ASCII white space
        known = self.known
        if len(known) > self.cached:
            known.clear()
        for w in set(found).difference(known):
            known[w] = self.match.count(w)
        return len(found), sum(map(known.__getitem__, found))


_workers: dict[int, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words and n_tokens of each row."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    mine = keyed_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = hash(vocabulary.value)
        if made not in _workers:
            _workers.clear()
            _workers[made] = Counter(vocabulary.value)
        counter = _workers[made]
        for batch in batches:
            for part in W.slices(batch):
                raw, at = W.texts(W.column(part, "__text"))
                data, at = raw.tobytes(), at.tolist()
                n = np.array([counter.of(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([W.column(part, "__id"), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["__id", "n_words", "n_tokens"])

    out = mine.mapInArrow(run, f"__id {dict(mine.dtypes)['__id']}, n_words long, n_tokens long")
    return out.withColumnRenamed("__id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents over the word_bpe_49k vocabulary."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
