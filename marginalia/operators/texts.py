"""Operators that walk one text at a time: chunkers, text deltas, rich documents, attributes. Each is a pure function
applied batch by batch; no shuffle."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, MAX_TOKENS, DIM = 500, 50, 500, 64
GIVEN, MADE = 64, 1024  # rows that are taken from a batch at once, and sent back at once


def made(batches: Iterator[pa.RecordBatch], each: Callable, fields: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """(id, *fields) that each(*other columns of a row) yields as tuples, MADE rows at a time, so that what one batch of long
    texts becomes is never held whole."""

    def told(ids: pa.Array, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * len(fields)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, fields.values(), strict=True)]], names=["id", *fields])

    for batch in batches:
        for first in range(0, batch.num_rows, GIVEN):
            part, at, out = batch.slice(first, GIVEN), [], []
            for i, row in enumerate(zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)):
                for one in each(*row):
                    at.append(i)
                    out.append(one)
                    if len(out) == MADE:
                        yield told(part.column(0), at, out)
                        at, out = [], []
            yield told(part.column(0), at, out)


def mapped(df: DataFrame, id_col: str, columns: list[str], each: Callable, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows (id_col, *fields) that each(*columns of a row) yields as tuples."""
    given = df.select(F.col(id_col).alias("id"), *columns)
    return given.mapInArrow(lambda batches: made(batches, each, fields), f"id {dict(given.dtypes)['id']}, {schema}").withColumnRenamed("id", id_col)


def windows(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(index, start, end, text) of fixed windows over a trimmed text, pulled back to just after the last full stop,
    line feed or blank where that lies beyond 70 % of the window. The next window starts at size - overlap, or at the
    end of this one if that is later; so windows don't overlap, and what a pulled-back window leaves is lost."""
    text = (text or "").strip()
    if len(text) <= size:
        return [(0, 0, len(text), text)] if text else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            last = max(text.rfind(c, start, end + 1) for c in ".\n ")
            end = last + 1 if last > start + size * 0.7 else end
        if part := text[start:end].strip():
            out.append((len(out), start, end, part))
        start = max(start + size - overlap, end)
    return out


def tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


_ENDS = re.compile("[.!?]")


def sentences(text: str | None) -> list[str]:
    return [s for part in _ENDS.split(text or "") if (s := part.strip())]


def packed(parts: list[str], most: int = MAX_TOKENS, joins: list[bool] | None = None) -> list[str]:
    """Neighbouring sentences in one chunk while its tokens fit, and while joins[i] allows part i + 1 after part i."""
    out: list[list[str]] = []
    size = 0  # characters of the last chunk
    for i, part in enumerate(parts):
        if out and (joins is None or joins[i - 1]) and math.ceil(size / 4) + tokens(part) <= most:
            out[-1].append(part)
            size += 1 + len(part)
        else:
            out.append([part])
            size = len(part)
    return [" ".join(x) for x in out]


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


def embedded(text: str, dim: int = DIM) -> np.ndarray:
    """The default provider: signed hashes of words, to unit length. Deterministic; another can be passed."""
    sums = [0] * dim
    for w in text.lower().split():
        h = _hash(w)
        sums[h % dim] += 1 if h & 1 << 20 else -1
    v = np.array(sums, float)
    n = np.sqrt(v @ v)
    return v / n if n else v


def embedded_all(texts: list[str], dim: int = DIM) -> list[np.ndarray]:
    """embedded() of each text: the words of all are summed at once, as whole numbers, so in any order alike."""
    words = [t.lower().split() for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = np.fromiter((_hash(w) for ws in words for w in ws), np.int64, len(row))
    v = np.bincount(row * dim + h % dim, np.where(h >> 20 & 1, 1.0, -1.0), len(texts) * dim).astype(float).reshape(len(texts), dim)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return list(np.divide(v, n, out=v, where=n > 0))


def semantic(text: str | None, most: int = MAX_TOKENS, base: float = 0.5, low: float = 0.4, high: float = 0.8, ahead: int = 3, combine: float | None = 0.5, embed: Callable = embedded) -> list[str]:
    """Chunks of like sentences: a sentence joins if the mean similarity of the one before it with the next `ahead`
    reaches a threshold that rises with the variance, and it fits; then neighbouring chunks that are alike merge."""
    parts = sentences(text)
    if not parts:
        return []
    every = embedded_all if embed is embedded else lambda texts: [embed(t) for t in texts]
    v = every(parts)
    near = [float(sum(v[i] @ x for x in v[i + 1 : i + 1 + ahead])) / min(ahead, len(v) - 1 - i) for i in range(len(v) - 1)]
    limit = max(low, min(high, base + (float(np.var(near)) if near else 0.0) / 2))
    chunks = packed(parts, most, [s >= limit for s in near])
    if combine is None:
        return chunks
    vecs = every(chunks)
    merged, size, last = [chunks[0]], tokens(chunks[0]), vecs[0]
    for c, now in zip(chunks[1:], vecs[1:], strict=True):
        if size + tokens(c) <= most and float(last @ now) >= combine:
            merged[-1] += f" {c}"
            size += tokens(c)
        else:
            merged.append(c)
            size = tokens(c)
        last = now
    return merged


def delta(old: str, new: str) -> list[tuple[str, int, str]]:
    """(type, length, content) steps that turn old into new: keep equal runs; at a difference drop as little of old as
    lets some later character of new go on, and insert what lies before it. Where a character comes next is looked up
    from one backward pass, so it takes time in proportion to both lengths and the kinds of characters."""
    out: list[tuple[str, int, str]] = []
    places: dict[str, list[int]] = {}
    for i in range(len(new) - 1, -1, -1):
        places.setdefault(new[i], []).append(i)
    a = b = 0
    while a < len(old) and b < len(new):
        n = 0
        while a + n < len(old) and b + n < len(new) and old[a + n] == new[b + n]:
            n += 1
        if n:
            out.append(("retain", n, ""))
            a, b = a + n, b + n
            continue
        gone, at = a, None
        while gone < len(old):
            ahead = places.get(old[gone], [])
            while ahead and ahead[-1] < b:
                ahead.pop()
            if ahead:
                at = ahead[-1]
                break
            gone += 1
        if gone > a:
            out.append(("delete", gone - a, ""))
        if at is not None and at > b:
            out.append(("insert", at - b, new[b:at]))
            b = at
        a = gone
    if b < len(new):
        out.append(("insert", len(new) - b, new[b:]))
    elif a < len(old):
        out.append(("delete", len(old) - a, ""))
    return out


def applied(old: str, steps: list[tuple[str, int, str]]) -> str:
    out, at = [], 0
    for kind, n, text in steps:
        out.append(old[at : at + n] if kind == "retain" else text)
        at += n if kind != "insert" else 0
    return "".join(out)


def walked(document: str | None) -> dict[str, list[str]]:
    """What a rich document (a JSON tree) holds: text, and tags, mentions, links, backlinks, entities, triples, in order,
    tags to backlinks once each. Both ways of writing them count, as marks of a text and as nodes; entities and triples
    are JSON. What isn't a JSON object holds nothing."""
    found: dict[str, list[str]] = {k: [] for k in ("text", "tags", "mentions", "links", "backlinks", "entities", "triples")}
    try:
        root = json.loads(document or "")
    except ValueError:
        return found
    kinds = {"tag": ("tags", "label", "tag"), "mention": ("mentions", "label", "id"), "link": ("links", "title", "href"), "wikilink": ("links", "target", "title"), "backlink": ("backlinks", "label", "noteId"), "crosslink": ("backlinks", "label", "targetNoteId")}
    todo = [root] if isinstance(root, dict) else []
    while todo:
        node = todo.pop()
        if isinstance(node.get("text"), str):
            found["text"].append(node["text"])
        for item in (node, *[m for m in node.get("marks") or () if isinstance(m, dict)]):
            kind, attrs = str(item.get("type", "")).lower(), item.get("attrs")
            attrs = attrs if isinstance(attrs, dict) else {}
            if kind in kinds:
                where, *names = kinds[kind]
                value = next((str(attrs[n]) for n in names if attrs.get(n)), node.get("text"))
                if value and value not in found[where]:
                    found[where].append(value)
            elif kind in ("entity", "triple"):
                found["entities" if kind == "entity" else "triples"].append(json.dumps(attrs, sort_keys=True))
        todo += [c for c in reversed(node.get("content") or []) if isinstance(c, dict)]
    return found


def plain(document: str | None, variant: str = "paragraphs") -> str | None:
    """The text of a rich document, None for what isn't JSON. Variants: `lines`, a line feed after each top-level node;
    `paragraphs`, one after each paragraph or heading wherever it is, trimmed; `clean`, one after each top-level paragraph
    or heading and a blank after list items, blank nodes left out, white space collapsed."""
    try:
        root = json.loads(document or "")
    except ValueError:
        return None
    content = root.get("content") if isinstance(root, dict) else None
    out: list[str] = []
    for top in content if isinstance(content, list) else ():
        if not isinstance(top, dict):
            continue
        todo, made = [top], []
        while todo:  # nodes, and what comes after their children
            node = todo.pop()
            if isinstance(node, str):
                made.append(node)
                continue
            made.append(str(node.get("text") or ""))
            if variant == "paragraphs" and node.get("type") in ("paragraph", "heading"):
                todo.append("\n")
            below = node.get("content")
            todo += [x for x in reversed(below if isinstance(below, list) else []) if isinstance(x, dict)]
        text = "".join(made)
        if variant == "lines":
            text += "\n"
        elif variant == "clean":
            text = "" if not text.strip() else text + {"paragraph": "\n", "heading": "\n", "listItem": " "}.get(top.get("type"), "")
        out.append(text)
    whole = "".join(out)
    if variant == "clean":
        whole = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", whole))
    return whole if variant == "lines" else whole.strip()


def rich_text(content, variant: str = "paragraphs"):
    """plain() of a column, in Arrow batches, of which GIVEN texts at a time are Python's."""

    @F.arrow_udf("string")
    def each(c: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([plain(x, variant) for x in c.slice(at, GIVEN).to_pylist()], pa.string()) for at in range(0, max(1, len(c)), GIVEN)])

    return each(content)


#: Words that carry little meaning by themselves.
STOP_WORDS = "a about after all also an and any are as at be because been before being but by can could did do does for from had has have he her him his how if in into is it its just like me more most my no not now of on only or other our out over she should so some such than that the their them then there these they this those to under up was we were what when where which while who will with would you your".split()

# The labels of entities, each with B- and I- before it, and O.
ENTITY_KINDS = ("CARDINAL", "DATE", "EVENT", "FAC", "GPE", "LANGUAGE", "LAW", "LOC", "MONEY", "NORP", "ORDINAL", "ORG", "PERCENT", "PERSON", "PRODUCT", "QUANTITY", "TIME", "WORK_OF_ART")
LABELS = ("O", *(f"{p}-{k}" for k in ENTITY_KINDS for p in "BI"))

#: What the recognizer without a model finds: a pattern for each type, in order; a place that one has taken stays its.
RULES = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "URL": r"https?://[^\s<>\"]+",
    "DATE": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b",
    "TIME": r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    "MONEY": r"[$\u20ac\u00a3]\d+(?:[.,]\d+)*",
    "PERCENT": r"\b\d+(?:\.\d+)?%",
    "ORDINAL": r"\b\d+(?:st|nd|rd|th)\b",
    "CARDINAL": r"\b\d+(?:[.,]\d+)*\b",
}
_RULES = re.compile("|".join(f"(?P<{k}>{p})" for k, p in RULES.items()), re.ASCII)


def recognized(text: str | None) -> list[tuple[str, str, int, int, float]]:
    """(value, type, start, end, confidence) of what RULES find; the confidence is always 0.9, as none is measured."""
    return [(m[0], m.lastgroup, m.start(), m.end(), 0.9) for m in _RULES.finditer(text or "")]


class Recognizers:
    """Named entity recognizers, of which one is active: functions from a text to recognized()'s rows."""

    def __init__(self):
        self.known: dict[str, Callable] = {"rules": recognized}
        self.active = "rules"

    def add(self, name: str, each: Callable) -> None:
        self.known[name] = each

    def switch(self, name: str) -> None:
        if name not in self.known:
            raise KeyError(f"no recognizer {name}")
        self.active = name

    def run(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        fields = {"value": pa.string(), "type": pa.string(), "start": pa.int32(), "end": pa.int32(), "confidence": pa.float64()}
        return mapped(df, id_col, [text_col], self.known[self.active], fields, "value string, type string, start int, end int, confidence double")
