"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base spans (offsets in code points, end exclusive) are the leftmost non-overlapping matches of each kind's pattern
that pass its check: e-mail addresses, dotted IPv4 addresses, card numbers (Luhn), phone numbers with a country code.

The field labels tokens (runs of characters other than ASCII white space) with B- and I-kind or O. A token without a
digit or `@` can only be O; so the chain falls apart at such tokens, and each run of other tokens between them is
decoded alone, exactly as it would be within the whole text. Features are word shapes of the token and its neighbours,
hashed into a fixed number of rows. Weights and transitions are fitted on the driver to the small labelled table by
penalised maximum likelihood (forward-backward in numpy, Adam), and decoded by Viterbi over many runs at once. A
decoded span counts if it has its kind's make-up (for a card the Luhn check, for a phone 7 to 15 digits, ...) and
overlaps no base span.

A text without a digit or `@`, which is found on its bytes, is not looked at further. One pass, no shuffle.

Nulls and edge cases: a null or empty text has no spans; repeated rows are searched each; patterns run in linear time
on texts of any length; an empty table gives no rows; extra columns are dropped, or kept as they are by masked().
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import keyed_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
ROWS = 1 << 12
_MARK = np.zeros(256, bool)
_MARK[[0x40, *range(0x30, 0x3A)]] = True

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is only tried from its start: what fails there fails within it too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            done = m.end()
            yield a, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() >= 16 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------------------------


class _Letters(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        return s


_LETTERS = _Letters()


def shape(token: str) -> str:
    """Letters as X and x, digits as d, of the whole token."""
    return token.translate(_LETTERS)


_REPEATED = re.compile(r"(.)\1+")


def _features(before: str, token: str, after: str) -> array:
    s = shape(token)
    short = _REPEATED.sub(r"\1", s)
    n = s.count("d")
    names = (
        "1", f"s{s}", f"q{short}", f"n{min(n, 20)}", f"a{s[:1]}", f"z{s[-1:]}", f"@{token.count('@')}", f".{min(token.count('.'), 4)}", f":{min(token.count(':'), 3)}",
        f"p{_REPEATED.sub(r'\1', shape(before))}", f"f{_REPEATED.sub(r'\1', shape(after))}", f"pd{min(shape(before).count('d'), 6)}|{n}", f"fd{min(shape(after).count('d'), 6)}|{n}",
    )
    return array("H", [zlib.crc32(x.encode("utf-8", "surrogatepass")) % ROWS for x in names])


def runs_of(text: str) -> list[list[tuple[int, int, array]]]:
    """Runs of neighbouring tokens with a digit or `@`: (start, end, features) of each token."""
    out: list[list[tuple[int, int, array]]] = []
    held: list[tuple[int, int, str]] = []
    before = ""

    def close(after: str) -> None:
        names = [before, *(x[2] for x in held), after]
        out.append([(a, b, _features(names[i], t, names[i + 2])) for i, (a, b, t) in enumerate(held)])
        held.clear()

    last = ""
    for m in _TOKEN.finditer(text):
        t = m[0]
        if "@" in t or _DIGIT.search(t):
            if not held:
                before = last
            held.append((m.start(), m.end(), t))
        elif held:
            close(t)
        last = t
    if held:
        close("")
    return out


def _padded(runs: list[list[array | list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    n, width = max(map(len, runs)), len(runs[0][0])
    x = np.zeros((len(runs), n, width), np.uint16)
    for i, r in enumerate(runs):
        x[i, : len(r)] = np.frombuffer(b"".join(r), np.uint16).reshape(len(r), width) if isinstance(r[0], array) else r
    return x, np.array([len(r) for r in runs])


@dataclass
class Field:
    weights: np.ndarray  # (ROWS, labels)
    moves: np.ndarray  # (labels, labels); from and to O at a run's ends

    @classmethod
    def fit(cls, table: list[tuple[list[array], list[int]]], steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Field:
        """table: for each run the features and labels of its tokens."""
        x, size = _padded([r for r, _ in table])
        n, t, _ = x.shape
        k = len(LABELS)
        y = np.zeros((n, t), np.int64)
        for i, (_, labels) in enumerate(table):
            y[i, : len(labels)] = labels
        live = np.arange(t)[None, :] < size[:, None]
        params = [np.zeros((ROWS, k)), np.zeros((k, k))]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        flat = x[live]
        gold = np.zeros((live.sum(), k))
        gold[np.arange(len(gold)), y[live]] = 1
        rows = np.arange(n)
        gold_moves = np.zeros((k, k))
        np.add.at(gold_moves, (0, y[:, 0]), 1)
        np.add.at(gold_moves, (y[rows, size - 1], 0), 1)
        for j in range(1, t):
            on = live[:, j]
            np.add.at(gold_moves, (y[on, j - 1], y[on, j]), 1)
        for step in range(1, steps + 1):
            w, m = params
            e = np.zeros((n, t, k))
            e[live] = w[flat].sum(axis=1)
            alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
            alpha[:, 0] = e[:, 0] + m[0]
            for j in range(1, t):
                v = alpha[:, j - 1, :, None] + m
                top = v.max(axis=1)
                alpha[:, j] = np.where(live[:, j, None], e[:, j] + top + np.log(np.exp(v - top[:, None]).sum(axis=1)), alpha[:, j - 1])
            end = alpha[:, -1] + m[:, 0]
            top = end.max(axis=1)
            total = top + np.log(np.exp(end - top[:, None]).sum(axis=1))
            beta[rows, size - 1] = m[:, 0]
            for j in range(t - 2, -1, -1):
                v = m[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :]
                top = v.max(axis=2)
                beta[:, j] = np.where((j < size - 1)[:, None], top + np.log(np.exp(v - top[:, :, None]).sum(axis=2)), beta[:, j])
            p = np.exp(alpha + beta - total[:, None, None])[live]
            exp_moves = np.zeros((k, k))
            exp_moves[0] += np.exp(alpha[:, 0] + beta[:, 0] - total[:, None]).sum(axis=0)
            exp_moves[:, 0] += np.exp(end - total[:, None]).sum(axis=0)
            for j in range(1, t):
                on = live[:, j]
                exp_moves += np.exp(alpha[on, j - 1, :, None] + m + (e[on, j] + beta[on, j])[:, None, :] - total[on, None, None]).sum(axis=0)
            g_w = penalty * w
            np.add.at(g_w, flat, ((p - gold) / n)[:, None, :])
            g_m = penalty * m + (exp_moves - gold_moves) / n
            for i, g in enumerate((g_w, g_m)):
                a, b = state[i]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                params[i] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return cls(*params)

    def viterbi(self, runs: list[list[array]], most: int = 200_000, step: int = 20_000) -> list[list[int]]:
        """Best labels of each run. Runs of like length are decoded together, about `most` tokens at once (or one longer
        run); scores are made for `step` tokens at a time, and of the tokens before only a byte for each label is kept."""
        out: list[list[int]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at) * len(runs[order[to]]) < most and len(runs[order[to]]) <= 2 * len(runs[order[at]]) + 4:
                to += 1
            part = order[at:to]
            x, size = _padded([runs[i] for i in part])
            n, t, k = len(part), x.shape[1], len(LABELS)
            rows, block = np.arange(n), max(1, step // n)
            best, last, back = np.zeros((n, k)), np.zeros((n, k)), np.zeros((t, n, k), np.int8)
            for j in range(t):
                if j % block == 0:
                    e = self.weights[x[:, j : j + block]].sum(axis=2)
                if j == 0:
                    best = e[:, 0] + self.moves[0]
                else:
                    v = best[:, :, None] + self.moves
                    back[j] = v.argmax(axis=1)
                    best = v.max(axis=1) + e[:, j % block]
                ends = size == j + 1
                if ends.any():
                    last[ends] = best[ends]
            final = (last + self.moves[:, 0]).argmax(axis=1)
            label, path = final, np.zeros((n, t), np.int8)
            for j in range(t - 1, -1, -1):
                label = np.where(j == size - 1, final, label)
                path[:, j] = label
                label = np.where(j <= size - 1, back[j, rows, label], label)
            for row, i in enumerate(part):
                out[i] = path[row, : size[row]].tolist()
            at = to
        return out


# ---- the small labelled table ----------------------------------------------------------------------------------

# Sentences with places for values of a kind, {o:...} for values that are none.
SENTENCES = """write to {email} today
mail {email} or {email}
contact: {email}, thanks
<{email}>
the host {ip} answered
from {ip} to {ip} again
server {ip}, port {o:small}
card {card} was charged
paid with {card}.
number {card} valid until {o:date}
call {phone} now
phone: {phone}
ring {phone} or {phone}
fax ({phone})
tel {phone}, ask for details
{phone} {card}
{ip} {email}
{email} {phone}
{card}, {phone}
version {o:version} is out
in {o:year} it was {o:small}
license {o:version}
costs {o:price} each
on {o:date} at {o:time}
key {o:hex} stored
password={o:hex}
isbn {o:isbn} of {o:year}
pages {o:small} {o:small} {o:small}
sum {o:big} of {o:big}
id {o:code} and {o:code}
chapter {o:small}. section {o:small}.
room {o:small} floor {o:small}
follow {o:handle} there
error {o:code} in line {o:small}
order {o:big}""".split("\n")


def _value(kind: str, r: random.Random) -> str:
    def d(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def name(low: int = 3, high: int = 8) -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high)))

    if kind == "email":
        user = r.choice([name(), f"{name()}.{d(2)}", f"{name()}_{name()}", f"{name()}+{name()}"])
        return f"{user}@{r.choice([f'mail{d(1)}.example.com', f'{name()}.org', f'{name()}.co.uk', 'localhost', name()])}"
    if kind == "ip":
        if r.random() < 0.25:
            return ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8))
        return ".".join(str(r.randrange(256)) for _ in range(4))
    if kind == "card":
        n = "4" + d(14)
        n += next(c for c in "0123456789" if luhn(n + c))
        sep = r.choice(["", "", " ", "-", ".", "/"])
        return sep.join(n[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {a} {b}{c}", f"00{d(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}"])
    return {
        "small": d(r.randint(1, 3)), "version": f"{d(1)}.{d(1)}{r.choice(['', '.', '.' + d(1), '.' + d(2) + '.'])}", "year": "20" + d(2), "price": f"${d(2)}.{d(2)}", "date": r.choice([f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"1{d(1)}/0{r.randint(1, 9)}/20{d(2)}", f"0{d(1)}.1{d(1)}.20{d(2)}"]),
        "time": f"1{d(1)}:{r.randint(10, 59)}", "hex": "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40]))), "isbn": f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", "big": d(r.randint(4, 9)), "code": name(1, 3).upper() + d(r.randint(2, 12)), "handle": "@" + name(),
    }[kind]


def labelled(copies: int = 12, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: texts and their spans, SENTENCES with `copies` sets of values."""
    r, out = random.Random(seed), []
    for _ in range(copies):
        for s in SENTENCES:
            text, spans = "", []
            for part in re.split(r"(\{[^}]+\})", s):
                if part[:1] != "{":
                    text += part
                    continue
                kind = part[1:-1]
                value = _value(kind.removeprefix("o:"), r)
                if kind in KINDS:
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value
            out.append((text, spans))
    return out


def train(table: list[tuple[str, list[tuple[str, int, int]]]] | None = None) -> Field:
    rows = []
    for text, spans in labelled() if table is None else table:
        for run in runs_of(text):
            labels = []
            for a, b, _ in run:
                on = next(((k, s) for k, s, e in spans if s < b and a < e), None)
                labels.append(0 if on is None else LABELS.index(f"{'B' if a <= on[1] else 'I'}-{on[0]}"))
            rows.append(([x[2] for x in run], labels))
    return Field.fit(rows)


_HEX_GROUPS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")


def _made_up(kind: str, s: str) -> bool:
    """Whether a span can be of its kind."""
    d = _digits(s)
    if kind == "email":
        user, at, host = s.partition("@")
        return bool(user and at and host) and "@" not in host and any(map(str.isalnum, host))
    if kind == "ip":
        return bool(_HEX_GROUPS.fullmatch(s)) and len(d) >= 2 and s.count(":") >= 3
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and set(s) <= set("0123456789 -./")
    return 7 <= len(d) <= 15 and set(s) <= set("0123456789 ()+-./") and len(s) > len(d)


def added_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text and what has the make-up of its kind."""
    runs = [runs_of(t) for t in texts]
    paths = iter(field.viterbi([[x[2] for x in run] for rs in runs for run in rs]))
    out = []
    for text, rs in zip(texts, runs, strict=True):
        found: list[tuple[str, int, int]] = []
        for run in rs:
            open_: list | None = None
            for (a, b, _), y in [*zip(run, next(paths), strict=True), ((0, 0, []), 0)]:
                kind = LABELS[y][2:]
                if open_ and LABELS[y][0] == "I" and kind == open_[0]:
                    open_[2] = b
                    continue
                if open_:
                    found.append(tuple(open_))
                open_ = [kind, a, b] if y else None
        kept = []
        for kind, a, b in found:
            while a < b and text[a] in "\"'<[{,;:" or a < b and text[a] == "(" and ")" not in text[a:b]:
                a += 1
            while a < b and text[b - 1] in "\"'>]},;:!?." or a < b and text[b - 1] == ")" and "(" not in text[a:b]:
                b -= 1
            if a < b and _made_up(kind, text[a:b]):
                kept.append((kind, a, b))
        out.append(kept)
    return out


def spans_of(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text, both by kind as in KINDS, then start."""
    out = []
    for text, more in zip(texts, added_spans(texts, field), strict=True):
        base = base_spans(text)
        taken: list[list[int]] = []  # what base spans cover, as disjoint ascending spans
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a <= taken[-1][1]:
                taken[-1][1] = max(b, taken[-1][1])
            else:
                taken.append([a, b])
        ends = [b for _, b in taken]
        new = [x for x in more if (i := bisect_right(ends, x[1])) == len(taken) or taken[i][0] >= x[2]]
        out.append((base, sorted({*base, *new}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def _marked(part: pa.RecordBatch, name: str) -> list[int]:
    raw, offsets = W.texts(W.column(part, name))
    return np.unique(np.searchsorted(offsets, np.flatnonzero(_MARK[raw]), "right") - 1).tolist()


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans (arrays of kind, start, end) of every row."""
    mine, field = keyed_text(docs, id_col, text_col), train() if field is None else field
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                rows = _marked(part, "__text")
                found = spans_of(W.column(part, "__text").take(pa.array(rows, pa.int64())).to_pylist(), field)
                base, spans = [[]] * part.num_rows, [[]] * part.num_rows
                for i, (b, s) in zip(rows, found, strict=True):
                    base[i], spans[i] = ([{"kind": k, "start": x, "end": y} for k, x, y in z] for z in (b, s))
                yield pa.RecordBatch.from_arrays([W.column(part, "__id"), pa.array(base, kind), pa.array(spans, kind)], names=["__id", "base", "spans"])

    spans = "array<struct<kind string, start bigint, end bigint>>"
    out = mine.mapInArrow(run, f"__id {dict(mine.dtypes)['__id']}, base {spans}, spans {spans}")
    return out.withColumnRenamed("__id", id_col)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, as <KIND> of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs with all spans masked; other columns as they are, a null text stays null."""
    field = train() if field is None else field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                rows = _marked(part, text_col)
                texts = W.column(part, text_col).to_pylist()
                found = spans_of([texts[i] for i in rows], field)
                for i, (_, spans) in zip(rows, found, strict=True):
                    texts[i] = mask(texts[i], spans)
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _listed(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns. The counts are those of the base spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def n(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
