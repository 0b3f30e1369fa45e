"""Repair of conversations whose rows are damaged: the cheapest edits that make the roles a well-formed sequence.

Rows of a conversation are taken in order of their turns (nulls first). The first fault of a row counts: blank (nothing
but ASCII white space), duplicate (role and text seen earlier) or truncated (the last character that is no white space
is none of . ! ?). The edits are Keep (0), Rerole to user or assistant (3), Delete (4; blank and duplicate rows must go)
and Insert of a row without text (3, anywhere); a truncated row that stays costs 3 more. The initials of the roles
that result are empty, or an s or nothing and then ua once or more. Of the cheapest sequences of edits the one whose
initials are least in ASCII order is the audit.

Solving: a row is one of nine symbols (its role's initial and its fault). A worker gathers the symbol sequences of a
batch of conversations, each distinct one once, and compresses them by Re-Pair: the most frequent pair of neighbours
becomes a rule, again and again. A symbol or rule has one matrix over (cost, audit) pairs from each state of the role
automaton to each; a rule's is the min-plus product of its two parts', computed once, bottom-up, and kept by the worker
for all later batches. A sequence is then a product of few matrices. Audits are ropes, so that long ones are shared and
not copied. Equal costs are compared by audits; as of two different ones of equal cost neither begins with the other,
the least of a product is the product of the least.

Scale: what decides (symbol, turn, digest of role and text; no texts) is one small row a row. Duplicates are found by
the first turn of each (conversation, digest), summed before the shuffle and joined back, so no task holds what a
conversation has seen. Rows then stream through a worker in order: of a conversation of any length it holds a segment of
symbols, four states and its audit. The texts are shuffled once, for the repaired rows, and stream in order as well. A
conversation is one sequence, and a digest of it one pass, so a single one is not split over tasks; its rows are sorted
by Spark, which spills.

Nulls and edge cases: a null role or text is one space; a null conversation id is a conversation of its own; rows of one turn
are ordered by role, the first 32 characters of the text and a digest, so that equal ones are neighbours. Roles and texts
are equal if the 128-bit MD5 of both is. A role counts by its first character alone ('s', 'u', 'a', any other, or none).
A conversation without rows, or with none kept, has the empty audit. An empty table gives no rows. Turns must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch

SEGMENT = 1 << 16
LEAST_PAIRS, MOST_RULES, LEAF = 4, 10_000, 1024
SPACE = " \t\n\x0b\x0c\r"
_NO_TURN = -(1 << 63)
_S, _U, _A = 0, 1, 2

# States of the role automaton: nothing yet, after s, after u, after a.
_STEPS = {(0, _S): 1, (0, _U): 2, (1, _U): 2, (2, _A): 3, (3, _U): 2}
_ACCEPTED = (0, 3)
#: Roles that an inserted or rerolled row takes in each state.
_NEXT = ("user", "user", "assistant", "user")

Rope = str | tuple  # a string, or (length, left, right)
Entry = tuple[int, Rope] | None


def joined(a: Rope, b: Rope) -> Rope:
    if isinstance(b, str):
        if not b:
            return a
        if isinstance(a, str):
            if len(a) + len(b) <= LEAF:
                return a + b
        elif isinstance(a[2], str) and len(a[2]) + len(b) <= LEAF:
            return (a[0] + len(b), a[1], a[2] + b)
    if isinstance(a, str) and not a:
        return b
    n = (len(a) if isinstance(a, str) else a[0]) + (len(b) if isinstance(b, str) else b[0])
    return (n, a, b)


def flat(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[2], top[1])
    return "".join(out)


def less(a: Rope, b: Rope) -> bool:
    """a < b as strings; nodes that both share are passed over."""
    left, right, x, y = [a], [b], "", ""
    while True:
        while not x and not y and left and right:
            p, q = left[-1], right[-1]
            if p is q:
                left.pop(), right.pop()
            elif isinstance(p, tuple) and (isinstance(q, str) or p[0] >= q[0]):
                left.pop()
                left += (p[2], p[1])
            elif isinstance(q, tuple):
                right.pop()
                right += (q[2], q[1])
            else:
                x, y = left.pop(), right.pop()
        while not x and left:
            p = left.pop()
            if isinstance(p, str):
                x = p
            else:
                left += (p[2], p[1])
        while not y and right:
            q = right.pop()
            if isinstance(q, str):
                y = q
            else:
                right += (q[2], q[1])
        if not x or not y:
            return bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def _better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    return a if a[0] < b[0] or a[0] == b[0] and not less(b[1], a[1]) else b


def _times(row: list[Entry], matrix: list[list[Entry]]) -> list[Entry]:
    out: list[Entry] = [None] * 4
    for r, before in enumerate(row):
        if before is None:
            continue
        for q, after in enumerate(matrix[r]):
            if after is None:
                continue
            cost, had = before[0] + after[0], out[q]
            if had is None or cost < had[0]:
                out[q] = (cost, joined(before[1], after[1]))
            elif cost == had[0]:
                out[q] = _better(had, (cost, joined(before[1], after[1])))
    return out


def _inserts() -> list[list[Entry]]:
    """From each state to each by inserted rows alone."""
    out: list[list[Entry]] = []
    for p in range(4):
        reached: list[Entry] = [None] * 4
        at, n = p, 0
        while reached[at] is None:
            reached[at] = (3 * n, "I" * n)
            at, n = _STEPS[at, _U if _NEXT[at] == "user" else _A], n + 1
        out.append(reached)
    return out


_INSERTS = _inserts()


def _row_matrix(symbol: int) -> list[list[Entry]]:
    """Inserted rows, then one edit of a row of this symbol."""
    edits: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        edits[p][p] = (4, "D")
        if symbol:
            initial, cut = divmod(symbol - 1, 2)
            for to in (_U, _A):
                if (p, to) in _STEPS:
                    q = _STEPS[p, to]
                    edits[p][q] = _better(edits[p][q], (3 + 3 * cut, "R"))
            if (p, initial) in _STEPS:
                q = _STEPS[p, initial]
                edits[p][q] = _better(edits[p][q], (3 * cut, "K"))
    return [_times(row, edits) for row in _INSERTS]


TERMINALS = 9  # 0: must go; else 1 + 2 * (0 s, 1 u, 2 a, 3 other) + truncated
START: list[Entry] = [(0, ""), None, None, None]


def _taken(hit: np.ndarray, same: bool) -> np.ndarray:
    """Positions of hits, from the left, of which no two overlap."""
    at = np.flatnonzero(hit)
    if not same or not len(at):
        return at
    new = np.append(True, np.diff(at) > 1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


class Grammar:
    """Rules of pairs, each with its matrix; kept from batch to batch until there are too many."""

    def __init__(self, least: int = LEAST_PAIRS, most: int = MOST_RULES):
        self.least, self.most = least, most
        self.rules: dict[tuple[int, int], int] = {}
        self.matrices = [_row_matrix(s) for s in range(TERMINALS)]

    def _rule(self, a: int, b: int) -> int:
        made = self.rules.get((a, b))
        if made is None:
            made = self.rules[a, b] = len(self.matrices)
            left, right = self.matrices[a], self.matrices[b]
            self.matrices.append([_times(row, right) for row in left])
        return made

    def compressed(self, sequences: list[bytes]) -> list[list[int]]:
        """The sequences over terminals and rules."""
        if len(self.rules) > self.most:
            self.rules.clear()
            del self.matrices[TERMINALS:]
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        ends = np.cumsum(sizes + 1)
        s = np.full(int(ends[-1]) + 1 if len(ends) else 1, -1, np.int64)  # -1 before, between and after sequences
        inside = np.ones(len(s), bool)
        inside[0] = False
        inside[ends] = False
        s[inside] = np.frombuffer(b"".join(sequences), np.uint8)
        counts: dict[int, int] = {}

        def count(pairs: np.ndarray, sign: int) -> None:
            a, b = s[pairs], s[pairs + 1]
            real = (a >= 0) & (b >= 0)
            keys, n = np.unique(a[real] << 32 | b[real], return_counts=True)
            for k, m in zip(keys.tolist(), n.tolist(), strict=True):
                counts[k] = counts.get(k, 0) + sign * m
                if not counts[k]:
                    del counts[k]

        count(np.arange(len(s) - 1), 1)
        passed: set[int] = set()
        while counts:
            key = max(counts, key=lambda k: (counts[k], -k) if k not in passed else (0, -k))
            if key in passed or counts[key] < self.least:
                break
            a, b = key >> 32, key & 0xFFFFFFFF
            at = _taken((s[:-1] == a) & (s[1:] == b), a == b)
            if len(at) < self.least:  # overlaps of one symbol
                passed.add(key)
                continue
            touched = np.unique(np.concatenate([at - 1, at, at + 1]))
            count(touched, -1)
            s[at] = self._rule(a, b)
            stays = np.ones(len(s), bool)
            stays[at + 1] = False
            s = s[stays]
            now = at - np.arange(len(at))
            count(np.unique(np.concatenate([now - 1, now])), 1)
        cuts = np.flatnonzero(s < 0)
        flat_ = s.tolist()
        return [flat_[x + 1 : y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def advance(self, state: list[Entry], symbols: list[int]) -> list[Entry]:
        for x in symbols:
            state = _times(state, self.matrices[x])
        return state

    @staticmethod
    def finish(state: list[Entry]) -> tuple[int, str]:
        ends = _times(state, _INSERTS)
        cost, rope = _better(ends[_ACCEPTED[0]], ends[_ACCEPTED[1]])
        return cost, flat(rope)

    def solve(self, sequences: list[bytes]) -> list[tuple[int, str]]:
        """Cost and audit of each sequence of symbols; equal ones are solved once."""
        distinct = list(dict.fromkeys(sequences))
        known = {x: self.finish(self.advance(START, c)) for x, c in zip(distinct, self.compressed(distinct), strict=True)}
        return [known[x] for x in sequences]


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and copies: each row after damage by crc32(`conv:turn`) % 20 (nulls: one space). 0 drops it
    (copies 0), 1 empties its text, 2 removes . ! ? from it, 3 repeats it (copies 2), 4 sets role user."""
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    of = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    cut = F.translate(text, ".!?", "")
    return rows.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.when(of == 4, F.lit("user")).otherwise(role).alias("role"), F.when(of == 1, F.lit("")).when(of == 2, cut).otherwise(text).alias("text"), F.when(of == 0, 0).when(of == 3, 2).otherwise(1).alias("copies"))


def intact(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as they are, in the form of damaged()."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).alias("copies"))


def _ordering() -> dict[str, Column]:
    told = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return {"at": F.coalesce("turn", F.lit(_NO_TURN)), "head": F.substring("text", 1, 32), "digest": F.unhex(F.md5(told.cast("binary")))}


_ORDER = ("at", "role", "head", "digest")


def _keys(rows: DataFrame) -> DataFrame:
    """What decides about each row, without its text."""
    kept = F.rtrim("text", F.lit(SPACE))
    last = F.substring(kept, -1, 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", _S).when(initial == "u", _U).when(initial == "a", _A).otherwise(3)
    found = rows.withColumns(_ordering() | {"kind": kind, "blank": kept == "", "cut": ~last.isin(".", "!", "?"), "dated": F.col("turn").isNotNull()})
    return found.select("conv", *_ORDER, "kind", "blank", "cut", "dated", "copies")


def _starts(ids: pa.Array, before: object, first: bool) -> np.ndarray:
    """Where a run of equal ids starts; before: the last id of the previous batch."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    out = np.append(True, codes[1:] != codes[:-1])
    out[0] = first or ids[0].as_py() != before
    return out


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[_S, _U, _A], [_U, _A, _U]] = True


class _Open:
    """The conversation whose rows are coming in."""

    def __init__(self, conv: object):
        self.conv, self.state, self.parts, self.size = conv, None, [], 0
        self.low = self.high = self.turn = self.kind = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def told(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal


_FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_grammars: dict[int, Grammar] = {}


def _judge(segment: int):
    """Faults, cost and audit of each conversation, whose rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = _grammars.setdefault(0, Grammar())
        now, before, done, size, kind_of_id = None, None, [], 0, None

        def solved() -> pa.RecordBatch:
            short = [c for c in done if c.state is None]
            found = dict(zip(map(id, short), grammar.solve([b"".join(c.parts) for c in short]), strict=True))
            for c in done:
                if c.state is not None:
                    rest = grammar.compressed([b"".join(c.parts)])[0]
                    found[id(c)] = grammar.finish(grammar.advance(c.state, rest))
            told = [(*c.told(), *found[id(c)]) for c in done]
            kinds = [kind_of_id, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*told, strict=True), kinds, strict=True)], names=["conv", *_FAULTS, "cost", "audit"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, digests = W.column(batch, "conv"), W.column(batch, "digest")
            kind_of_id = ids.type
            at, kind, blank, cut, dated, copies = (W.column(batch, c).to_numpy(zero_copy_only=False) for c in ("at", "kind", "blank", "cut", "dated", "copies"))
            earliest = W.column(batch, "earliest").fill_null(_NO_TURN).to_numpy(zero_copy_only=False)
            starts = _starts(ids, before and before[0], now is None)
            codes = digests.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            again = np.append(False, (codes[1:] == codes[:-1]) & (at[1:] == at[:-1])) & ~starts
            again[0] = not starts[0] and before[1:] == (int(at[0]), digests[0].as_py())
            before = (ids[-1].as_py(), int(at[-1]), digests[-1].as_py())
            seen = (at > earliest) | again
            of = np.repeat(np.arange(len(at)), copies)
            seen = seen[of] | np.append(False, of[1:] == of[:-1])[: len(of)]
            at, kind, blank, cut, dated = at[of], kind[of], blank[of], cut[of], dated[of]
            seen &= ~blank
            cut = cut & ~blank & ~seen
            symbols = np.where(blank | seen, 0, 1 + 2 * kind + cut).astype(np.uint8)
            new_turn = dated & np.append(True, (at[1:] != at[:-1]) | ~dated[:-1])[: len(of)]
            illegal = np.append(False, ~_LEGAL[kind[:-1], kind[1:]])[: len(of)]
            sums = [np.append(0, np.cumsum(x)).tolist() for x in (blank, seen, cut, dated, new_turn, illegal)]
            rows = np.flatnonzero(np.append(True, starts[1:]))
            edges = np.append(np.searchsorted(of, rows), len(of)).tolist()
            for n, row in enumerate(rows.tolist()):
                if starts[row]:
                    if now is not None:
                        done.append(now)
                    now = _Open(ids[row].as_py())
                x, y = edges[n], edges[n + 1]
                if x == y:
                    continue
                blanks, dups, cuts, with_turn, turns, faulty = (s[y] - s[x] for s in sums)
                faulty -= illegal[x]
                if now.kind is not None:
                    faulty += int(not _LEGAL[now.kind, kind[x]])
                if with_turn:
                    first = y - with_turn  # rows without a turn come first
                    turns += int(not new_turn[first]) - int(now.turn == at[first])
                    now.low = int(at[first]) if now.low is None else now.low
                    now.high = now.turn = int(at[y - 1])
                now.turns += int(turns)
                now.blank, now.duplicate, now.truncated, now.illegal = now.blank + int(blanks), now.duplicate + int(dups), now.truncated + int(cuts), now.illegal + int(faulty)
                now.kind = int(kind[y - 1])
                now.parts.append(symbols[x:y].tobytes())
                now.size, size = now.size + y - x, size + y - x
                if now.size >= segment:
                    part = grammar.compressed([b"".join(now.parts)])[0]
                    now.state, now.parts, now.size = grammar.advance(now.state or START, part), [], 0
            if done and (size >= segment or len(done) >= 10_000):
                yield solved()
                done, size = [], 0
        if now is not None:
            done.append(now)
            yield solved()

    return run


def judged(rows: DataFrame, scratch: Scratch, segment: int = SEGMENT) -> DataFrame:
    """Of rows in the form of damaged(): conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each
    conversation."""
    keys = scratch.write(_keys(rows), "conversation-keys")
    firsts = keys.where("copies > 0").groupBy("conv", "digest").agg(F.min("at").alias("earliest"))
    firsts = firsts.select(F.col("conv").alias("__conv"), F.col("digest").alias("__digest"), "earliest")
    marked = keys.join(firsts, keys.conv.eqNullSafe(F.col("__conv")) & (keys.digest == F.col("__digest")), "left").drop("__conv", "__digest")
    ordered = marked.repartition("conv").sortWithinPartitions("conv", *_ORDER).drop("role", "head")
    schema = f"conv {dict(keys.dtypes)['conv']}, {', '.join(f'{c} long' for c in _FAULTS)}, cost long, audit string"
    return ordered.mapInArrow(_judge(segment), schema)


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that edits leave, in order; before the rows of each conversation comes its audit."""
    state, place, audit, to = 0, 0, "", 0
    for batch in batches:
        convs, places, roles, texts, insert = [], [], [], [], []
        given = zip(W.column(batch, "audit").to_pylist(), W.column(batch, "role").to_pylist(), W.column(batch, "copies").to_pylist(), strict=True)
        for i, (found, role, copies) in enumerate(given):
            if found is not None:
                state, place, audit, to, copies = 0, 0, found, 0, 1
            for _ in range(copies):
                edit = ""
                if found is None:
                    edit, to = audit[to], to + 1
                    if edit in "KR":
                        role = role if edit == "K" else _NEXT[state]
                        convs.append(i), places.append(place), roles.append(role), texts.append(i)
                        place += 1
                        state = _STEPS[state, "sua".index(role[0])]
                while to < len(audit) and audit[to] == "I":  # what is inserted before the next row
                    made = _NEXT[state]
                    convs.append(i), places.append(place), roles.append(made), texts.append(None)
                    place, to = place + 1, to + 1
                    state = _STEPS[state, _U if made == "user" else _A]
        if convs:
            told = W.column(batch, "text").take(pa.array(texts, pa.int64())).fill_null("")
            yield pa.RecordBatch.from_arrays([W.column(batch, "conv").take(pa.array(convs, pa.int64())), pa.array(places, pa.int64()), pa.array(roles, pa.string()), told.cast(pa.string())], names=["conv", "place", "role", "text"])


def mended(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, place (from 0), role and text of the repaired conversations. Within a partition the rows of a conversation
    are together and in order, as digests() needs them."""
    told = audits.select("conv", F.lit(-1).alias("copies"), "audit", *[F.lit(None).cast(k).alias(c) for c, k in (("at", "long"), ("role", "string"), ("text", "string"), ("head", "string"), ("digest", "binary"))])
    own = rows.where("copies > 0").withColumns(_ordering() | {"audit": F.lit(None).cast("string")})
    both = told.unionByName(own.select("conv", "copies", "audit", "at", "role", "text", "head", "digest"))
    ordered = both.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *_ORDER)
    kind = dict(rows.dtypes)["conv"]
    return ordered.select("conv", "copies", "audit", "role", "text").mapInArrow(_mend, f"conv {kind}, place long, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, kind = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, done = W.column(batch, "conv"), []
        kind = ids.type
        starts = _starts(ids, conv, digest is None).tolist()
        for i, (start, role, text) in enumerate(zip(starts, W.column(batch, "role").to_pylist(), W.column(batch, "text").to_pylist(), strict=True)):
            if start:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = ids[i].as_py(), hashlib.sha256(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["conv", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv and sha256 of `role:text` of the rows that mended() gave, joined by line feeds."""
    return repaired.mapInArrow(_digest, f"conv {dict(repaired.dtypes)['conv']}, sha256 string")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; the contract's columns."""
    scratch = Scratch(spark)
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    told = scratch.write(judged(rows, scratch), "conversation-audits")
    found = digests(mended(rows, told)).select(F.col("conv").alias("__conv"), "sha256")
    out = told.join(found, told.conv.eqNullSafe(F.col("__conv")), "left")
    out = out.select(F.col("conv").alias("conv_id"), *_FAULTS, "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return scratch.result(out, "repaired-conversations")
